"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lamplight")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores: for heavy work on a table of few files.
    A table that already has as many partitions, as any large one, is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class NoSharedFolder(RuntimeError):
    """A cluster session that names no folder its executors share."""


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from spark.checkpoint.dir.

    Only a local session (tests, a single machine) may name none: a temporary folder is made, set,
    and removed when the interpreter ends. On a cluster a folder of one machine would lose data
    without an error, so a session without the setting is refused there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise NoSharedFolder(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="lamplight-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        found = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders written by cut() and not yet removed, newest last; by application.
_WRITTEN: dict[str, list[str]] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later stages survive lost executors
    and the work before runs once, however often the result is used. free() and scratch() remove it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lamplight-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._lamplight_path = path
    return read


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    mine = _WRITTEN.get(spark.sparkContext.applicationId, [])
    if path in mine:
        mine.remove(path)


def free(*dfs: DataFrame) -> None:
    """Remove what cut() wrote for these frames: only once all that reads them is itself written."""
    for df in dfs:
        if path := getattr(df, "_lamplight_path", None):
            _remove(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end whatever cut() wrote within: for callers that use a result up inside."""
    mine = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(mine)
    try:
        yield
    finally:
        for path in mine[before:]:
            _remove(spark, path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, read without a job; None where there is no file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """Write a small file; without overwrite it fails where the file is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


def any_of(column: str, values: list[int], ranges: int = 16) -> Column:
    """column is one of a few whole numbers. The spans between the widest gaps are pushed to the parquet
    reader, which skips pages by them; the exact set is tested after."""
    from pyspark.sql import functions as F

    if not values:
        return F.lit(False)
    v = sorted(set(values))
    gaps = sorted(sorted(range(1, len(v)), key=lambda i: v[i - 1] - v[i])[: ranges - 1])
    spans = F.lit(False)
    for a, b in zip([0, *gaps], [*gaps, len(v)], strict=True):
        spans = spans | F.col(column).between(v[a], v[b - 1])
    return spans & F.col(column).isin(v)


#: Keys a side may have at most to be broadcast (16 MB of BIGINT); beyond it the join shuffles.
BROADCAST_KEYS = 2_000_000


def _by_keys(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    from pyspark.sql import functions as F

    keys = keys.select(on).distinct()
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, how)


def semi_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose key is among keys: broadcast behind a count of the keys, else a shuffle.

    keys has a column named on; repeated and null keys do no harm.
    """
    return _by_keys(df, keys, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose key is not among keys, null keys too; as semi_join otherwise."""
    return _by_keys(df, keys, on, "left_anti")
