"""Building and maintaining a corpus from file trees."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.functions import stemming, text
from lamplight.operators import embedding, resume, sinks, vision
from lamplight.operators.corpus import Corpus
from lamplight.operators.chunking import paged_windows
from lamplight.operators.vector_search import VectorIndex
from lamplight.settings import Settings, include_paths
from lamplight.sources import extract, lexicons
from lamplight.sources.walk import walk


@dataclass
class IndexStats:
    discovered: int = 0
    files: int = 0
    bytes: int = 0
    ocr_files: int = 0
    errors: int = 0
    encrypted: int = 0
    incomplete: int = 0
    chunks: int = 0
    skipped: int = 0
    capped: int = 0
    hashed: int = 0
    hash_failed: int = 0
    vision_files: int = 0
    faces: int = 0
    kept: int = 0
    removed: int = 0
    cancelled: bool = False


def processed(extracted: DataFrame, walked: DataFrame, model: embedding.Embedder, s: Settings) -> DataFrame:
    """Extraction results as rows that a corpus stores: language, tokens, chunks and vectors."""
    words = lexicons.dictionary(os.path.join(s.lexicons, "dict", "en_US.dic")) if s.lexicons else set()
    vi = (lexicons.dictionary(os.path.join(s.lexicons, "dict", "vi_VN.dic")) | set(lexicons.lines(os.path.join(s.lexicons, "dict", "vi_words.txt")))) if s.lexicons else set()
    short = lexicons.abbreviations(*(os.path.join(s.lexicons, f"abbreviations_{x}.txt") for x in ("en", "vi"))) if s.lexicons else {}
    r = extracted.join(walked, "path").withColumn("content", text.nfc(text.fallback_content("text", "name", "dir")))
    r = r.withColumn("lang", text.detect_lang("content", words or None, vi or None))
    tokens = text.words(text.token_source("content", "name", "path"))
    r = r.withColumn("tokens", stemming.enrich(tokens, F.col("lang"), vi, short))
    # pages come as one text with form feeds, so that windows know them
    paged = F.when(F.size("segments") > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.array_max(F.transform("segments", lambda p: p["page"]))), lambda k: F.coalesce(F.try_element_at(F.transform(F.filter("segments", lambda p: p["page"] == k), lambda p: p["text"]), F.lit(1)), F.lit(""))), "\f"))
    failed = F.col("method").startswith("error:") | F.col("method").startswith("excluded:")
    body = r.filter(~failed).select("path", F.coalesce(paged, F.translate("content", "\f", " ")).alias("body"), (F.size("segments") > 0).alias("has_pages"))
    w = paged_windows(body, "path", "body").join(body.select("path", "has_pages"), "path")
    page = lambda c: F.when(F.col("has_pages"), F.col(c)).cast("int").alias(c)
    w = w.select("path", F.struct("chunk_index", "content", embedding.passages(F.col("content"), model).alias("embedding"), F.lit(model.name).alias("model"), page("page_start"), page("page_end")).alias("c"))
    chunks = w.groupBy("path").agg(F.array_sort(F.collect_list("c"), lambda a, b: a["chunk_index"] - b["chunk_index"]).alias("chunks"))
    none = F.array().cast("array<struct<chunk_index:int,content:string,embedding:array<float>,model:string,page_start:int,page_end:int>>")
    return r.join(chunks, "path", "left").withColumn("chunks", F.coalesce("chunks", none)).select("path", "drive", "dir", "name", "ext", "size", "mtime", "lang", "method", "ocr_used", "pages", "sha1", "elapsed_ms", "content", "tokens", "chunks")


@dataclass
class Progress:
    """processed of total files are done with; worked of them were extracted, the others only hashed."""

    processed: int = 0
    worked: int = 0
    total: int = 0
    errors: int = 0


def index(
    spark: SparkSession, roots: list[str], out: str, model: embedding.Embedder | None = None, settings: Settings | None = None, do_resume: bool = True, overwrite: bool = False, tools: dict | None = None,
    cancelled: Callable[[], bool] = lambda: False, include: list[str] | None = None, progress: Callable[[Progress], None] = lambda p: None,
) -> IndexStats:
    """Walk, take what is new or changed, extract, embed, store in committed batches, prune.

    Files are taken in batches of about settings.commit_batch; a cancelled run keeps the batches it
    committed. include: files relative to a root that alone are taken; what is pruned is still all that
    the walk of the roots did not see. tools: functions for images, media and vision.
    """
    s, model, n, tools = settings or Settings(), model or embedding.HashingEmbedder(), IndexStats(), tools or {}
    roots, only = [os.path.realpath(r) for r in roots], include_paths(roots, include)
    corpus = Corpus(spark, out)
    with corpus.staged() as staged:
        walk(spark, roots, s).dropDuplicates(["path"]).write.parquet(f"{staged}/walk")
        walked = spark.read.parquet(f"{staged}/walk")
        n.discovered = walked.count()
        if overwrite and corpus.exists():
            corpus.remove(corpus.table("files").select("path"))
        meta = corpus.meta()
        other_model = bool(meta.get("embed_model")) and meta["embed_model"] != model.name
        moved = bool(meta.get("extractor_revision")) and meta["extractor_revision"] != extract.revision()
        sees = "vision" in tools
        existing = resume.upgrades(corpus.with_flags(), corpus.table("vision") if sees else None, s.exhaustive, s.vision, s.faces_model)
        mine = walked if only is None else walked.join(F.broadcast(spark.createDataFrame([(p,) for p in only], "path string")), "path", "left_semi")  # named by the caller
        verdict = resume.decide(mine, existing, F.col("upgrade") | F.lit(other_model), uncapped=moved or s.retry_errors)
        (verdict if do_resume else verdict.withColumn("decision", F.lit("process"))).write.parquet(f"{staged}/decision")
        verdict = spark.read.parquet(f"{staged}/decision")
        counts = {r.decision: r.n for r in verdict.groupBy("decision").agg(F.count("*").alias("n")).collect()}
        owed = counts.get("hash-only", 0) if s.hash_backfill else 0
        n.skipped, n.capped = counts.get("skip", 0) + counts.get("hash-only", 0) - owed, counts.get("capped", 0)
        corpus.set_meta(last_job_started_at=repr(time.time()), last_discovered_files=str(n.discovered))
        todo = walked.join(verdict.filter("decision IN ('new', 'process')").select("path"), "path", "left_semi")
        total = counts.get("new", 0) + counts.get("process", 0)
        at = Progress(total=total + owed)
        if owed and not cancelled():
            extract.hash_files(verdict.filter("decision = 'hash-only'")).write.parquet(f"{staged}/hashes")
            hashes = spark.read.parquet(f"{staged}/hashes")
            n.hashed = hashes.filter("sha1 IS NOT NULL").count()
            n.hash_failed = owed - n.hashed
            corpus.set_sha1(hashes)
            at.processed += owed
            progress(at)
        batches = max(1, -(-total // max(1, s.commit_batch))) if total else 0
        for k in range(batches):
            if cancelled():
                n.cancelled = True
                break
            _batch(corpus, todo.filter(F.pmod(F.xxhash64("path"), F.lit(batches)) == k), f"{staged}/batch-{k}", model, s, tools, n)
            at.processed, at.worked, at.errors = owed + n.files + n.kept, n.files + n.kept, n.errors
            progress(at)
        if not n.cancelled:
            if do_resume and n.discovered:
                n.removed = corpus.remove(resume.missing(corpus.table("files"), walked, roots))
            values = {"last_job_finished_at": repr(time.time()), "extractor_revision": extract.revision()}
            if resume.may_record_model(n.errors == 0, n.kept) or not meta.get("embed_model"):
                values["embed_model"] = model.name
            corpus.set_meta(**values)
    VectorIndex(spark, f"{out}/vectors").follow(corpus.table("chunks"), corpus.meta().get("last_job_started_at"))
    return n


def _batch(corpus: Corpus, part: DataFrame, staged: str, model: embedding.Embedder, s: Settings, tools: dict, n: IndexStats) -> None:
    """Extract and store one batch; counts go to n."""
    spark = corpus.spark
    extract.extract_files(part.repartition(spark.sparkContext.defaultParallelism), s, tools).write.parquet(f"{staged}/extracted")
    got = spark.read.parquet(f"{staged}/extracted")
    rows = processed(got, part, model, s)
    if s.vision != "off" and "vision" in tools:
        seen = vision.analysed(part.filter(F.col("ext").isin(*resume.VISION_EXTS)), tools["vision"], s.vision, s.faces_model)
        rows = rows.join(seen, "path", "left")
    resume.keep_old_on_error(rows, corpus.with_flags()).write.parquet(f"{staged}/rows")
    good = spark.read.parquet(f"{staged}/rows")
    n.kept += got.count() - good.count()
    corpus.upsert(good, time.time())
    corpus.compact()
    for name, value in resume.counters(good).first().asDict().items():
        setattr(n, name, getattr(n, name) + value)


def reports(corpus: Corpus, folder: str, sidecar: str = "none") -> dict:
    """Manifest, catalogue, sidecars and reports of the current snapshot, below a folder."""
    files, docs = corpus.table("files"), corpus.table("documents")
    sinks.write_manifest(files, docs, f"{folder}/manifest", "overwrite")
    sinks.write_catalogue(files, f"{folder}/catalogue", "overwrite")
    sinks.write_report(files, folder)
    n = sinks.write_sidecars(files.select("path", "method").join(docs.select("path", "content"), "path"), f"{folder}/text", sidecar)
    return {"sidecars": n} | sinks.report(files)


def summary(n: IndexStats) -> dict:
    return asdict(n)
