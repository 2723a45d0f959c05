"""Predicates over the method column, the state of a file's processing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ATTEMPTS = 3
#: Bytes up to which a finished file without checksum is hashed again.
HASH_LIMIT = 1 << 30


def incomplete(method: Column) -> Column:
    return (method == "name-only") | method.startswith("error:") | method.endswith("-partial")


def complete(method: Column, has_chunks: Column) -> Column:
    return method.startswith("excluded:") | (has_chunks & ~incomplete(method))


def changed(size: Column, mtime: Column, old_size: Column, old_mtime: Column) -> Column:
    """Other size or other whole second, as seconds are cut, not rounded."""
    return (size != old_size) | (mtime.cast("long") != old_mtime.cast("long"))


def needs_reprocess(is_changed: Column, upgrade: Column, is_complete: Column, uncapped: Column, attempts: Column) -> Column:
    return is_changed | upgrade | (~is_complete & (uncapped | (attempts < MAX_ATTEMPTS)))


def next_attempts(is_complete: Column, is_changed: Column, before: Column) -> Column:
    """0 when complete; one more for unchanged bytes; else the first."""
    return F.when(is_complete, 0).when(before.isNotNull() & ~is_changed, before + 1).otherwise(1)


def tier_rank(mode: Column) -> Column:
    return F.when(mode == "captions", 3).when(mode == "tags", 2).when(mode == "meta", 1).otherwise(0)
