"""Corpus statistics, status and the tree listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMITS = {"ext": 30, "lang": 10, "method": 20, "dir": 20}


def grouped(files: DataFrame, column: str, limit: int) -> DataFrame:
    """(value, n): most frequent values, ties by value, null last among equals."""
    return files.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(limit)


def breakdown(files: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(dimension, value, n) of all dimensions in one shuffle, each cut to its limit."""
    from pyspark.sql import Window

    limits = limits or LIMITS
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in limits))).alias("p")
    counts = files.select(pairs).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc_nulls_last("value")))
    most: Column = F.element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col("dimension"))
    return counts.withColumn("k", rank).filter(F.col("k") <= most).select("dimension", "value", "n")


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.col("ocr_used").cast("long")), F.lit(0)).alias("ocr_files"))


def status(files: DataFrame, chunks: DataFrame | None, discovered: int) -> DataFrame:
    """One row: indexed and pending files, characters, bytes, scanned files, embedded chunks, languages and methods."""
    f = files.agg(
        F.count("*").alias("indexed_files"), F.coalesce(F.sum("chars"), F.lit(0)).alias("total_characters"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.col("ocr_used").cast("long")), F.lit(0)).alias("ocr_files"), F.countDistinct("lang").alias("languages"), F.countDistinct("method").alias("methods"),
    )
    n = chunks.filter(F.col("embedding").isNotNull()).agg(F.count("*").alias("embedded_chunks")) if chunks is not None else files.sparkSession.range(1).select(F.lit(0).cast("long").alias("embedded_chunks"))
    both = f.withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k").drop("k")  # a row each
    return both.withColumn("pending_files", F.greatest(F.lit(discovered) - F.col("indexed_files"), F.lit(0)))


def tree(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Every listed path with what the corpus knows of it, folders before files, then by name.

    listing: (path, name, dir, is_dir), one row a path; files: newest row a path.
    """
    known = files.select("path", F.col("id").alias("file_id"), "lang", "method", F.lit(True).alias("indexed"))
    rows = listing.join(known, "path", "left").withColumn("indexed", F.coalesce("indexed", F.lit(False)))
    return rows.orderBy("dir", F.desc("is_dir"), "name", "path")
