"""Schemas of the corpus tables, and the version they are stamped with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 3

DISCOVERED = "path string, name string, ext string, dir string, drive string, size long, mtime double"
FILES = (
    "id long, path string, drive string, dir string, name string, ext string, size long, mtime double, lang string, method string, ocr_used int,"
    " pages long, chars long, sha1 string, indexed_at double, attempts long, last_attempt_at double, elapsed_ms long"
)
DOCUMENTS = "file_id long, name string, path string, content string, tokens string, n_tokens int"
CHUNKS = "id long, file_id long, chunk_index int, content string, embedding array<float>, dimensions int, model string, page_start int, page_end int"
VISION = "file_id long, caption string, tags array<struct<tag:string,score:float>>, objects array<struct<label:string,count:int,confidence:float>>, phash string, exif map<string,string>, quality struct<blur:double,luma:double,dark:double,bright:double>, mode string, faces_model string"
FACES = "file_id long, face_index int, x int, y int, w int, h int, quality float, embedding array<float>, model string, frame int"
META = "key string, value string"
JOBS = "id string, status string, envelope_json string, updated_at double"
POSTINGS = "term string, file_id long, tf int, length int"
TABLES = {"files": FILES, "documents": DOCUMENTS, "chunks": CHUNKS, "vision": VISION, "faces": FACES, "postings": POSTINGS}


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the schema's columns: missing ones are null, others are left out."""
    have, schema = set(df.columns), T.StructType.fromDDL(ddl)
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def check_version(found: int | None) -> None:
    """A corpus newer than this engine is refused; none yet means a new corpus."""
    if found is not None and found > SCHEMA_VERSION:
        raise ValueError(f"the corpus has schema version {found}, this engine knows {SCHEMA_VERSION}")
