"""Walking file trees as a Spark data source, pruned before descent."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lamplight.functions.text import glob_pattern
from lamplight.settings import Settings

_SCHEMA = "path string, name string, ext string, dir string, drive string, size long, mtime double"


#: Folders from which a walk is split no further, and levels it is split by at most.
ENOUGH, LEVELS = 64, 4


class Pruner:
    """Which folders and files a walk leaves out."""

    def __init__(self, dirs: list[str], paths: list[str], exts: list[str]):
        self.dirs, self.exts = {d.lower() for d in dirs}, {e.lower() for e in exts}
        self.paths = [re.compile(glob_pattern(p)) for p in paths]

    def folder(self, path: str) -> bool:
        return os.path.basename(path).lower() in self.dirs or any(p.match(path) for p in self.paths)

    def file(self, name: str) -> bool:
        return os.path.splitext(name)[1].lower() in self.exts


def first_part(path: str) -> str:
    m = re.match(r"^([A-Za-z]:|[/\\]?[^/\\]*)", path)
    return m.group(1) if m else ""


def record(path: str, stat: os.stat_result) -> tuple:
    name = os.path.basename(path)
    return path, name, os.path.splitext(name)[1].lower(), os.path.dirname(path), first_part(path), stat.st_size, stat.st_mtime


def descend(root: str, prune: Pruner, follow: bool, deep: bool = True) -> Iterator[tuple]:
    """Files below root; folders that cannot be read, and links unless followed, are skipped."""
    todo, seen = [root], set()
    while todo:
        folder = todo.pop()
        real = os.path.realpath(folder)
        if real in seen:
            continue
        seen.add(real)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            try:
                if e.is_symlink() and not follow:
                    continue
                if e.is_dir():
                    if deep and not prune.folder(e.path):
                        todo.append(e.path)
                elif e.is_file() and not prune.file(e.name):
                    yield record(e.path, e.stat())
            except OSError:
                continue


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [os.path.realpath(r) for r in json.loads(options["roots"])]
        self.skip = [json.loads(options.get(k, "[]")) for k in ("skip_dirs", "skip_paths", "skip_exts")]
        self.follow = options.get("follow", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        """Folders to descend from, split level by level until there are enough for many tasks: a split
        folder is a partition for its own files, and each folder below it another. Only folders that are
        split are listed here."""
        prune, out, level = Pruner(*self.skip), [], []
        for root in self.roots:
            (out.append(InputPartition(("file", root))) if os.path.isfile(root) else level.append(root))
        for _ in range(LEVELS):
            below = []
            for folder in level:
                out.append(InputPartition(("flat", folder)))
                try:
                    below += sorted(e.path for e in os.scandir(folder) if e.is_dir() and (self.follow or not e.is_symlink()) and not prune.folder(e.path))
                except OSError:
                    continue
            level = below
            if len(level) >= ENOUGH:
                break
        out += [InputPartition(("deep", p)) for p in level]
        return out or [InputPartition(("none", ""))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        kind, path = partition.value
        if kind == "file":
            yield record(path, os.stat(path))
        elif kind != "none":
            yield from descend(path, Pruner(*self.skip), self.follow, kind == "deep")


class TreeSource(DataSource):
    """format("tree"): one row a file below the roots, which every executor must see."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def walk(spark: SparkSession, roots: list[str], settings: Settings | None = None) -> DataFrame:
    """(path, name, ext, dir, drive, size, mtime) of all files below the roots; roots that do not exist have none."""
    s = settings or Settings()
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("roots", json.dumps(roots)).option("follow", str(s.follow_symlinks).lower())
    for key in ("skip_dirs", "skip_paths", "skip_exts"):
        reader = reader.option(key, json.dumps(list(getattr(s, key))))
    return reader.load()
