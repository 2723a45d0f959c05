"""Overlapping windows of texts, with the pages they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions.text import trim_white
from lamplight.functions.vectors import chunk_starts

SIZE, STRIDE = 1200, 1000


def windows(df: DataFrame, key: str, text: str, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """(key, chunk_index, start, content): windows in code points; blank ones are left out before
    they are numbered. Null and empty texts have none. Rows of one text never leave their task."""
    blank = lambda w: F.length(trim_white(w["content"])) == 0
    cut = F.transform(chunk_starts(F.col(text), size, stride), lambda s: F.struct(s.alias("start"), F.substring(F.col(text), s + 1, F.lit(size)).alias("content")))
    kept = F.filter(cut, lambda w: ~blank(w))
    return df.filter(F.length(text) > 0).select(key, F.posexplode(kept).alias("chunk_index", "w")).select(key, "chunk_index", "w.start", "w.content")


def pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, text): parts between form feeds, counted from 1; blank pages count but are left out."""
    p = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\f")).alias("k", "text"))
    return p.filter(F.length(trim_white("text")) > 0).select(key, (F.col("k") + 1).alias("page"), "text")


def paged_windows(df: DataFrame, key: str, text: str, size: int = SIZE, stride: int = STRIDE) -> DataFrame:
    """(key, chunk_index, start, content, page_start, page_end) over the pages' texts, joined without
    a separator. Pages and windows of a text stay in its row, so there is no shuffle."""
    cut = F.transform(F.split(text, "\f"), lambda t, k: F.struct((k + 1).alias("page"), t.alias("text")))
    full = F.filter(cut, lambda p: F.length(trim_white(p["text"])) > 0)
    d = df.filter(F.col(text).isNotNull()).select(key, full.alias("p")).withColumn("whole", F.array_join(F.transform("p", lambda x: x["text"]), ""))
    # a page is its number and where it starts and stops; the texts stay behind when windows are made
    ends = F.aggregate("p", F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(x["text"]))))
    spans = F.zip_with("p", ends, lambda p, e: F.struct(p["page"].alias("page"), e.alias("stop"), (e - F.length(p["text"])).alias("at")))
    d = d.select(key, "whole", spans.alias("spans"))
    made = F.transform(chunk_starts(F.col("whole"), size, stride), lambda s: F.struct(s.alias("start"), F.substring(F.col("whole"), s + 1, F.lit(size)).alias("content")))
    kept = F.filter(made, lambda w: F.length(trim_white(w["content"])) > 0)

    def within(w: Column) -> Column:
        stop = w["start"] + F.length(w["content"])
        hit = F.transform(F.filter("spans", lambda x: (x["stop"] > w["start"]) & (x["at"] < stop)), lambda x: x["page"])
        return F.struct(w["start"].alias("start"), w["content"].alias("content"), F.array_min(hit).alias("page_start"), F.array_max(hit).alias("page_end"))

    return d.select(key, F.posexplode(F.transform(kept, within)).alias("chunk_index", "w")).select(key, "chunk_index", "w.start", "w.content", "w.page_start", "w.page_end")


def number_chunks(chunks: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """chunks with a stable id in the given order, above start; through range partitions and their
    counts, so that no single task numbers all rows."""
    spread = chunks.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id())
    sizes = spread.groupBy("part").agg(F.count("*").alias("size"), F.min("n").alias("least"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", "least", before.alias("before"))  # a row a partition
    return spread.join(F.broadcast(offsets), "part").withColumn("id", F.col("n") - F.col("least") + F.col("before") + start + 1).drop("part", "n", "least", "before")
