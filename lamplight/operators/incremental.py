"""Taking exactly the new or changed inputs since the last successful run.

A listing (what a walk saw) is anti-joined with a manifest (what earlier runs stored, with
size and checksum). A run writes its output under the identifier of its batch and commits
the manifest last; a run that fails in between leaves only an uncommitted folder, which is
never read and which the repeated run overwrites.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.session import read_text, write_text


def newest_per_key(df: DataFrame, key: str, by: str, values: list[str]) -> DataFrame:
    """One row per non-null key: the values of the row with the greatest by.

    Null by counts as the least; ties go to the greatest values in order, so the result does
    not depend on the order of rows. Partial maxima keep a hot key from one task.
    """
    best = F.max(F.struct(by, *values)).alias("__best")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *(F.col(f"__best.{c}").alias(c) for c in (by, *values)))


def content_differs(a: str, b: str) -> Column:
    """Another checksum; where either has none, another size or whole second of mtime."""
    col = F.col
    seconds = ~F.floor(col(f"{a}.mtime")).eqNullSafe(F.floor(col(f"{b}.mtime")))
    weak = ~col(f"{a}.size").eqNullSafe(col(f"{b}.size")) | seconds
    return F.when(col(f"{a}.sha1").isNull() | col(f"{b}.sha1").isNull(), weak).otherwise(col(f"{a}.sha1") != col(f"{b}.sha1"))


def stored_last(files: DataFrame) -> DataFrame:
    """Manifest from a files table: rows without indexed_at were not stored."""
    return newest_per_key(files.filter(F.col("indexed_at").isNotNull()), "path", "indexed_at", ["sha1", "size", "mtime"])


def new_or_changed(discovered: DataFrame, manifest: DataFrame) -> DataFrame:
    """Newest listing row (path, seen_at, sha1, size, mtime) of each path to be processed.

    A path is in it once, however often it was listed; rows of null path stay out; with an
    empty manifest every path is in it. manifest has one row per path.
    """
    seen = newest_per_key(discovered, "path", "seen_at", ["sha1", "size", "mtime"])
    same = (F.col("n.path") == F.col("m.path")) & ~content_differs("n", "m")
    return seen.alias("n").join(manifest.select("path", "sha1", "size", "mtime").alias("m"), same, "left_anti")


#: Committed batches after which their manifests are folded into one.
FOLD = 16
MANIFEST = "path string, seen_at double, sha1 string, size long, mtime double"


@dataclass
class IncrementalStore:
    """Batches and manifest below one folder that all executors reach.

    out/batch=<id> holds output, manifest/batch=<id> what was processed. commits/<number> is the file
    that commits a batch and names it; of two runs that want one number the slower fails, and what it
    worked on is still to be processed. folded/<number> is the manifest of all batches up to that number.
    """

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self.root = self.root.rstrip("/")

    def _fs(self, *parts: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, folder: str) -> list[int]:
        fs, path = self._fs(folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def committed(self, after: int = 0) -> list[str]:
        """Identifiers of the batches, in the order of their commits."""
        return [read_text(self.spark, f"{self.root}/commits/{n:09d}") for n in self._numbers("commits") if n > after]

    def manifest(self) -> DataFrame:
        """Newest processed row of each path: the last folded manifest and the batches since."""
        whole = [n for n in self._numbers("folded") if self._fs(f"folded/{n:09d}/_SUCCESS")[0].exists(self._fs(f"folded/{n:09d}/_SUCCESS")[1])]
        last = max(whole, default=0)
        paths = [f"{self.root}/folded/{last:09d}"] * bool(last) + [f"{self.root}/manifest/batch={b}" for b in self.committed(last)]
        if not paths:
            return self.spark.createDataFrame([], MANIFEST)
        found = self.spark.read.schema(MANIFEST).parquet(*paths)
        return newest_per_key(found, "path", "seen_at", ["sha1", "size", "mtime"])

    def output(self) -> DataFrame | None:
        """Output of all committed batches, null before the first."""
        paths = [f"{self.root}/out/batch={b}" for b in self.committed()]
        return self.spark.read.parquet(*paths) if paths else None

    def run(self, discovered: DataFrame, process: Callable[[DataFrame], DataFrame]) -> str | None:
        """Process what is new or changed and commit it; the batch identifier, None if nothing was.

        The identifier is a hash of the batch's members and the number of the commit, so a repeated
        attempt over the same members writes the same folders.
        """
        number = max(self._numbers("commits"), default=0) + 1
        todo = new_or_changed(discovered, self.manifest())
        member = F.xxhash64("path", "seen_at", "sha1", "size", "mtime").cast("decimal(38,0)")
        staged = uuid.uuid4().hex  # of this run alone
        try:
            todo.write.parquet(f"{self.root}/staged/{staged}")
            todo = self.spark.read.parquet(f"{self.root}/staged/{staged}")
            n, total = todo.agg(F.count("*"), F.sum(member)).first()
            if not n:
                return None
            batch = f"{n}-{int(total) & (1 << 64) - 1:016x}-{number}"
            process(todo).write.mode("overwrite").parquet(f"{self.root}/out/batch={batch}")
            todo.write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch}")
            write_text(self.spark, f"{self.root}/commits/{number:09d}", batch)
        finally:
            fs, path = self._fs("staged", staged)
            fs.delete(path, True)
        if number % FOLD == 0:
            self.manifest().write.mode("overwrite").parquet(f"{self.root}/folded/{number:09d}")
        return batch
