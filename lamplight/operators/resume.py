"""What a resumed run does with each walked file, and what it prunes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions.methods import HASH_LIMIT, changed, complete, incomplete, needs_reprocess, tier_rank

# Methods whose chunks can know their pages, and extensions that vision looks at.
ANCHORED = ("pdf-text", "pdf-exhaustive-text", "pdf-exhaustive-ocr")
VISION_EXTS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp", ".gif", ".heic", ".mkv", ".mp4", ".mov", ".m4v", ".avi", ".webm")


def with_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """files with has_chunks and anchored (some chunk knows its page)."""
    per = chunks.groupBy("file_id").agg(F.max(F.col("page_start").isNotNull()).alias("anchored"))
    joined = files.join(per.withColumnRenamed("file_id", "id").withColumn("has", F.lit(True)), "id", "left")
    return joined.select(*files.columns, F.coalesce("has", F.lit(False)).alias("has_chunks"), F.coalesce("anchored", F.lit(False)).alias("anchored"))


def upgrades(existing: DataFrame, vision: DataFrame | None = None, exhaustive: bool = False, mode: str = "off", faces_model: str | None = None) -> DataFrame:
    """existing (with_chunks) with upgrade: an intact row is reopened because a better one can be had.

    A PDF when everything is to be recognised and was not; a PDF whose chunks know no page though its
    method could; an image or video when a higher vision mode, or another face model, is asked for than
    is recorded. A lower mode, or none, reopens nothing. vision: (file_id, mode, faces_model).
    """
    m = F.coalesce("method", F.lit(""))
    reopened = (m.isin(*ANCHORED) & F.col("has_chunks") & ~F.col("anchored")) | (F.lit(exhaustive) & (F.col("ext") == ".pdf") & ~m.startswith("pdf-exhaustive"))
    if vision is None or (mode == "off" and faces_model is None):
        return existing.withColumn("upgrade", F.coalesce(reopened, F.lit(False)))
    seen = vision.groupBy(F.col("file_id").alias("id")).agg(F.max(tier_rank(F.col("mode"))).alias("tier"), F.max("faces_model").alias("faces"))
    both = existing.join(seen, "id", "left")
    sees = F.col("ext").isin(*VISION_EXTS)
    higher = sees & (tier_rank(F.lit(mode)) > F.coalesce("tier", F.lit(0)))
    other = F.lit(False) if faces_model is None else sees & ~F.col("faces").eqNullSafe(F.lit(faces_model))
    return both.select(*existing.columns, F.coalesce(reopened | higher | other, F.lit(False)).alias("upgrade"))


def decide(walked: DataFrame, existing: DataFrame, upgrade: Column | None = None, uncapped: bool = False) -> DataFrame:
    """walked with its decision: new, process, capped, hash-only or skip.

    walked: (path, size, mtime), one row a path. existing: one row a path with has_chunks. A path
    that is not in existing is new. upgrade: condition over existing columns that reopens a file.
    """
    old = existing.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), "method", "attempts", "sha1", "has_chunks", (F.lit(False) if upgrade is None else F.coalesce(upgrade, F.lit(False))).alias("upgrade"))
    both = walked.select("path", "size", "mtime").join(old, "path", "left")
    done = F.coalesce(complete(F.col("method"), F.col("has_chunks")), F.lit(False))
    moved = changed(F.col("size"), F.col("mtime"), F.col("old_size"), F.col("old_mtime"))
    again = needs_reprocess(moved, F.col("upgrade"), done, F.lit(uncapped), F.coalesce("attempts", F.lit(0)))
    verdict = (
        F.when(F.col("has_chunks").isNull(), "new")
        .when(again, "process")
        .when(~done, "capped")
        .when(F.col("sha1").isNull() & (F.col("size") < HASH_LIMIT), "hash-only")
        .otherwise("skip")
    )
    return both.select("path", verdict.alias("decision"))


def unanchored(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids of files with chunks of which none knows its page."""
    return chunks.groupBy("file_id").agg(F.max("page_start").alias("page")).filter(F.col("page").isNull()).join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("file_id")


def below(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of the roots or below one."""
    return F.lit(False) if not roots else F.greatest(*(((path == r.rstrip("/")) | path.startswith(r.rstrip("/") + "/")).cast("int") for r in roots), F.lit(0)) == 1


def missing(files: DataFrame, walked: DataFrame, roots: list[str]) -> DataFrame:
    """Files below the roots that the walk did not see; none where the walk was empty."""
    if not walked.take(1):
        return files.limit(0)
    return files.filter(below(F.col("path"), roots)).join(walked.select("path"), "path", "left_anti")


def keep_old_on_error(results: DataFrame, existing: DataFrame) -> DataFrame:
    """Results without failures of files whose unchanged, complete row is already stored."""
    good = existing.filter(complete(F.col("method"), F.col("has_chunks"))).select("path", F.col("size").alias("s0"), F.col("mtime").alias("m0"))
    failed = F.col("r.method").startswith("error:")
    same = (F.col("r.path") == F.col("o.path")) & failed & ~changed(F.col("r.size"), F.col("r.mtime"), F.col("o.s0"), F.col("o.m0"))
    return results.alias("r").join(good.alias("o"), same, "left_anti")


def may_record_model(clean: bool, kept: int) -> bool:
    return clean and kept == 0


def counters(results: DataFrame) -> DataFrame:
    """One row of run counters over stored results (method, size, ocr_used, chunks)."""
    m = F.col("method")
    return results.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("ocr_used") == 1).alias("ocr_files"), F.count_if(m.startswith("error:")).alias("errors"),
        F.count_if(m == "error:encrypted").alias("encrypted"), F.count_if(incomplete(m)).alias("incomplete"),
        *([F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("chunks")] if "chunks" in results.columns else []),
        *([F.count("vision").alias("vision_files")] if "vision" in results.columns else []), *([F.coalesce(F.sum(F.when(F.col("faces").isNotNull(), F.size("faces"))), F.lit(0)).alias("faces")] if "faces" in results.columns else []),
    )
