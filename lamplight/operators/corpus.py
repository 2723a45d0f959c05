"""A corpus in a folder: tables of immutable parts, committed by one small file.

A commit writes what a batch brings: a part of new rows a table, and a part of the file ids whose
older rows are gone. A snapshot names the parts of all tables; readers see whole snapshots, and a
failed run leaves folders nobody names. So a batch writes in proportion to itself, however large
the corpus is. compact() merges parts of one size class, expire() deletes what no kept snapshot
names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.functions.methods import changed, complete, next_attempts
from lamplight.operators import search
from lamplight.operators.chunking import number_chunks
from lamplight.session import any_of, read_text, write_text
from lamplight.schemas import SCHEMA_VERSION, TABLES, check_version, conform

#: Parts of one size class that are merged into one of the next.
FAN = 8
#: Which list of gone ids a table's rows answer to, and its id column.
GONE = {"files": "files", "documents": "texts", "chunks": "texts", "postings": "texts", "vision": "vision", "faces": "faces"}
_BATCH = "_batch"


def _id(table: str) -> str:
    return "id" if table == "files" else "file_id"


@dataclass
class Change:
    """New rows of a table, or (under a name of GONE's values) file ids whose older rows are gone."""

    rows: dict[str, DataFrame]
    gone: dict[str, DataFrame]


class Corpus:
    """Tables files, documents, chunks, vision, faces and postings, and a small map of meta values."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        check_version(int(self.meta().get("schema_version", SCHEMA_VERSION)))

    # ---- snapshots

    def _path(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self) -> list[str]:
        fs, p = self._path("commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _snapshot(self, name: str | None = None) -> dict:
        names = [name] if name else self._names()
        if not names:
            return {"number": 0, "parts": {}, "gone": {}, "meta": {}}
        found = json.loads(read_text(self.spark, f"{self.root}/commits/{names[-1]}"))
        if "tables" in found:  # schema version 2: whole tables, every row of the snapshot's number
            found |= {"parts": {t: [{"path": at, "number": 0, "level": 0, "bare": True}] for t, at in found["tables"].items()}, "gone": {}}
        return found

    def exists(self) -> bool:
        return self._snapshot()["number"] > 0

    def meta(self) -> dict[str, str]:
        return self._snapshot()["meta"]

    def _read(self, snapshot: dict, name: str, only: list[dict] | None = None) -> DataFrame:
        """Rows of a table's parts with their batch, gone ones left out."""
        parts = snapshot["parts"].get(name, []) if only is None else only
        ddl = f"{TABLES[name]}, {_BATCH} long"
        if not parts:
            return self.spark.createDataFrame([], ddl)
        df = self.spark.read.schema(ddl).parquet(*(p["path"] for p in parts))
        if any(p.get("bare") for p in parts):
            df = df.withColumn(_BATCH, F.coalesce(_BATCH, F.lit(0).cast("long")))
        oldest = min(p["least"] if "least" in p else p["number"] for p in parts)
        lists = [g["path"] for g in snapshot["gone"].get(GONE[name], []) if g["number"] > oldest]
        if lists:
            gone = self.spark.read.schema("file_id long, _gone long").parquet(*lists).groupBy("file_id").agg(F.max("_gone").alias("_gone"))
            df = df.join(gone.withColumnRenamed("file_id", _id(name)), _id(name), "left").filter(F.col("_gone").isNull() | (F.col(_BATCH) >= F.col("_gone"))).drop("_gone")
        return df

    def table(self, name: str) -> DataFrame:
        """A table of the current snapshot, with the schema of this version; empty where there is none yet."""
        return conform(self._read(self._snapshot(), name), TABLES[name])

    def _put(self, snapshot: dict) -> int:
        """Name a snapshot's parts in a new commit; fails where another writer was faster."""
        number = snapshot["number"]
        write_text(self.spark, f"{self.root}/commits/{number:012d}.json", json.dumps({k: snapshot[k] for k in ("number", "parts", "gone", "meta")}))
        return number

    def _write(self, name: str, df: DataFrame) -> str:
        at = f"{self.root}/tables/{name}-{uuid.uuid4().hex}"
        if name == "postings":
            search.write_postings(df, at)
        else:
            df.write.parquet(at)
        return at

    def commit(self, change: Change | None = None, meta: dict[str, str] | None = None) -> int:
        """Write a change's parts, then name them beside the old ones in a new snapshot; its number."""
        now, change = self._snapshot(), change or Change({}, {})
        number = now["number"] + 1
        parts, gone = ({k: list(v) for k, v in now[x].items()} for x in ("parts", "gone"))
        for name, df in change.rows.items():
            rows = conform(df, TABLES[name]).withColumn(_BATCH, F.lit(number).cast("long"))
            parts.setdefault(name, []).append({"path": self._write(name, rows), "number": number, "level": 0})
        for name, df in change.gone.items():
            ids = df.select("file_id").distinct().withColumn("_gone", F.lit(number).cast("long"))
            gone.setdefault(name, []).append({"path": self._write(f"gone-{name}", ids), "number": number, "level": 0})
        values = now["meta"] | {"schema_version": str(SCHEMA_VERSION)} | (meta or {})
        return self._put({"number": number, "parts": parts, "gone": gone, "meta": values})

    def set_meta(self, **values: str) -> None:
        self.commit(None, values)

    def compact(self, everything: bool = False) -> int:
        """Merge FAN parts of one size class into one of the next, gone rows left out; parts merged.

        A row is rewritten once a class, so all merges of n batches write in proportion to n log n.
        everything: merge each table into one part, and forget the gone ids.
        """
        now, merged = self._snapshot(), 0
        parts, gone = ({k: list(v) for k, v in now[x].items()} for x in ("parts", "gone"))
        for name in list(parts):
            while True:
                level = min((p["level"] for p in parts[name] if sum(q["level"] == p["level"] for q in parts[name]) >= FAN), default=None)
                pick = parts[name] if everything else [] if level is None else [p for p in parts[name] if p["level"] == level]
                if len(pick) < 2 and not (everything and gone.get(GONE[name])):
                    break
                at = self._write(name, self._read(now, name, pick))
                one = {"path": at, "number": max(p["number"] for p in pick), "least": min(p.get("least", p["number"]) for p in pick), "level": max(p["level"] for p in pick) + 1}
                parts[name] = [p for p in parts[name] if p not in pick] + [one]
                merged += len(pick)
                if everything:
                    break
        for name in list(gone):
            pick = [g for g in gone[name] if g["level"] == 0]
            if everything:
                gone[name] = []
            elif len(pick) >= FAN:
                ids = self.spark.read.schema("file_id long, _gone long").parquet(*(g["path"] for g in pick)).groupBy("file_id").agg(F.max("_gone").alias("_gone"))
                rest = [g for g in gone[name] if g not in pick]
                gone[name] = [*rest, {"path": self._write(f"gone-{name}", ids), "number": max(g["number"] for g in pick), "level": 1}]
        if merged:
            self._put({"number": now["number"] + 1, "parts": parts, "gone": gone, "meta": now["meta"]})
        return merged

    def expire(self, keep: int = 2) -> int:
        """Delete all but the newest snapshots, and every folder that none of those names; folders deleted.

        Only while no other run writes to the corpus: folders of an unfinished one would go too.
        """
        names = self._names()
        named = {p["path"].rsplit("/", 1)[-1] for n in names[-keep:] for s in [self._snapshot(n)] for x in ("parts", "gone") for ps in s[x].values() for p in ps}
        for n in names[:-keep]:
            fs, p = self._path("commits", n)
            fs.delete(p, False)
        deleted = 0
        for folder in ("tables", "staged"):
            fs, p = self._path(folder)
            for s in fs.listStatus(p) if fs.exists(p) else ():
                if s.getPath().getName() not in named:
                    fs.delete(s.getPath(), True)
                    deleted += 1
        return deleted

    @contextmanager
    def staged(self) -> Iterator[str]:
        """A folder for what a change is computed from, removed once the change is committed or failed."""
        name = uuid.uuid4().hex
        try:
            yield f"{self.root}/staged/{name}"
        finally:
            fs, p = self._path("staged", name)
            fs.delete(p, True)

    # ---- content

    def with_flags(self) -> DataFrame:
        """files with has_chunks and anchored."""
        from lamplight.operators.resume import with_chunks

        return with_chunks(self.table("files"), self.table("chunks"))

    def upsert(self, results: DataFrame, now: float, meta: dict[str, str] | None = None) -> int:
        """Store processed files with their children, replacing what was stored of their paths.

        results: file columns without id and attempts, content, tokens (array), and
        chunks (array of chunk_index, content, embedding, model, page_start, page_end), one row a
        path; optionally vision (struct) and faces (array). A null vision or faces keeps the stored
        rows of unchanged bytes and drops those of changed ones. An id belongs to its path for good.
        Reads the narrow columns of files and writes rows of the batch alone.
        """
        files, have = self.table("files"), self.meta()
        old = files.select("path", F.col("id").alias("old_id"), F.col("size").alias("s0"), F.col("mtime").alias("m0"), F.col("attempts").alias("a0"))
        top = {t: int(have[f"top_{t}"]) if f"top_{t}" in have else self.table(t).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for t in ("files", "chunks")}
        both = results.join(old, "path", "left").withColumn("moved", changed(F.col("size"), F.col("mtime"), F.col("s0"), F.col("m0")))
        fresh = number_chunks(both.filter("old_id IS NULL").select("path"), ["path"], top["files"])
        done = complete(F.col("method"), F.size("chunks") > 0)
        both = both.join(fresh.withColumnRenamed("id", "new_id"), "path", "left").withColumn("id", F.coalesce("old_id", "new_id"))
        both = both.withColumn("attempts", next_attempts(done, F.coalesce("moved", F.lit(True)), F.col("a0")).cast("long")).withColumn("indexed_at", F.lit(now)).withColumn("last_attempt_at", F.lit(now)).withColumn("chars", F.length("content").cast("long"))
        with self.staged() as staged:
            both.write.parquet(f"{staged}/rows")
            new = self.spark.read.parquet(f"{staged}/rows")
            known = new.filter("old_id IS NOT NULL").select(F.col("id").alias("file_id"))
            docs = new.withColumn("file_id", F.col("id")).withColumn("tokens", F.array_join("tokens", " "))
            # the index terms first: the documents carry how many they are
            terms = f"{staged}/terms"
            search.postings_of(docs.select(F.col("file_id").alias("id"), *search.SEARCHED)).write.parquet(terms)
            postings = self.spark.read.schema(TABLES["postings"]).parquet(terms)
            counts = postings.groupBy("file_id").agg(F.first("length").alias("n_tokens"))
            docs = docs.join(counts, "file_id", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
            made = new.select("path", F.col("id").alias("file_id"), F.explode("chunks").alias("c")).select("path", "file_id", "c.*").withColumn("dimensions", F.size("embedding"))
            change = Change({"files": new, "documents": docs, "chunks": number_chunks(made, ["path", "chunk_index"], top["chunks"]), "postings": postings}, {"files": known, "texts": known})
            stale = new.filter(F.coalesce("moved", F.lit(False))).select(F.col("id").alias("file_id"))
            for name in ("vision", "faces"):
                change.gone[name] = stale
                if name in new.columns:
                    replaced = new.filter(F.col(name).isNotNull())
                    change.gone[name] = stale.unionByName(replaced.select(F.col("id").alias("file_id")))
                    rows = replaced.select(F.col("id").alias("file_id"), F.col("vision.*") if name == "vision" else F.explode("faces").alias("f"))
                    change.rows[name] = rows if name == "vision" else rows.select("file_id", "f.*")
            n, fewer = new.agg(F.count("*"), F.count("old_id"), F.max("id")).first(), self._lengths(known)
            size = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
            chunks = made.count()
            values = {
                "top_files": str(max(top["files"], n[2] or 0)), "top_chunks": str(top["chunks"] + chunks),
                "fts_documents": str(int(have.get("fts_documents", 0)) + n[0] - n[1]), "fts_tokens": str(int(have.get("fts_tokens", 0)) + size - fewer),
            }
            return self.commit(change, values | (meta or {}))

    def _lengths(self, ids: DataFrame) -> int:
        """Tokens of the stored documents of some files."""
        return self.table("documents").select("file_id", "n_tokens").join(ids, "file_id", "left_semi").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]

    def remove(self, paths: DataFrame) -> int:
        """Drop files by path with their children; the number of files."""
        with self.staged() as staged:
            self.table("files").join(paths.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("file_id")).write.parquet(staged)
            gone = self.spark.read.schema("file_id long").parquet(staged)
            n, have = gone.count(), self.meta()
            if n:
                values = {"fts_documents": str(int(have.get("fts_documents", 0)) - n), "fts_tokens": str(int(have.get("fts_tokens", 0)) - self._lengths(gone))}
                self.commit(Change({}, dict.fromkeys(("files", "texts", "vision", "faces"), gone)), values)
        return n

    def _rewrite(self, rows: DataFrame) -> int:
        """Replace stored files by rows of the same ids."""
        with self.staged() as staged:
            conform(rows, TABLES["files"]).write.parquet(staged)
            new = self.spark.read.parquet(staged)
            return self.commit(Change({"files": new}, {"files": new.select(F.col("id").alias("file_id"))}))

    def set_sha1(self, hashes: DataFrame) -> int:
        """(path, sha1) for stored files; a null hash changes nothing."""
        h = hashes.filter("sha1 IS NOT NULL").select("path", F.col("sha1").alias("h"))
        return self._rewrite(self.table("files").join(h, "path").withColumn("sha1", F.col("h")))

    def record_failed(self, attempts: DataFrame, now: float) -> int:
        """(path, elapsed_ms) of attempts that stored nothing: count and times only."""
        a = attempts.select("path", F.col("elapsed_ms").alias("ms"))
        f = self.table("files").join(a, "path")
        return self._rewrite(f.withColumn("attempts", F.col("attempts") + 1).withColumn("last_attempt_at", F.lit(now)).withColumn("elapsed_ms", F.col("ms").cast("long")))

    def text(self, file_id: int) -> str | None:
        row = self.table("documents").filter(any_of("file_id", [file_id])).select("content").first()
        return row[0] if row else None

    # ---- search

    def searchable(self) -> DataFrame:
        """Documents as full-text search wants them: id, name, path, dir, content, tokens."""
        return self.table("documents").select(F.col("file_id").alias("id"), "name", "path", "content", "tokens").join(self.table("files").select("id", "dir"), "id")

    def statistics(self) -> tuple[int, int]:
        """Documents and index terms of the stored index."""
        m = self.meta()
        return int(m.get("fts_documents", 0)), int(m.get("fts_tokens", 0))

    def hits(self, queries: list[tuple[str, list[str]]], k: int = 20) -> DataFrame:
        """(query, id, score, rank) from the stored index; reads the queries' terms only."""
        return search.search_postings(self.table("postings"), *self.statistics(), queries, k)

    def search(self, query: str, k: int = 20, fuzzy: bool = False, abbreviations: dict | None = None) -> DataFrame:
        """(id, score, snippet) of a text query, 1 to 100 of them; as search.search over searchable()."""
        k, terms = search.clamp_limit(k), search.match_terms(query, abbreviations)
        hits = self.hits([("q", terms)], k).select("id", "score")
        if fuzzy and not hits.take(1):
            return search.fuzzy_hits(self.table("files").select("id", "name"), query, k)
        found = hits.collect()  # at most 100 rows
        text = self.table("documents").filter(any_of("file_id", [r.id for r in found])).select(F.col("file_id").alias("id"), "content")
        text = text.join(F.broadcast(self.spark.createDataFrame(found, "id long, score double")), "id")
        return text.select("id", "score", search.snippet("content", terms).alias("snippet")).orderBy(F.desc("score"), "id")

    def top_folders(self, query: str, k: int = 10, abbreviations: dict | None = None) -> DataFrame:
        """(dir, n): folders of the matching files, from the stored index."""
        return search.folders_of(self.table("postings"), self.table("files"), search.match_terms(query, abbreviations), k=search.clamp_limit(k))
