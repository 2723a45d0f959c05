"""Embedding of passages and queries through a pluggable model."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    """A model of a name and width; it is created once a worker."""

    name: str
    width: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashing of words and word pairs, for tests and where no model is at hand."""

    def __init__(self, width: int = 64):
        self.name, self.width = f"hashing-{width}", width

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for row, t in zip(out, texts, strict=True):
            w = re.findall(r"[^\W_]+", t.lower())
            for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]:
                h = xxhash.xxh32_intdigest(g)
                row[h % self.width] += 1.0 if h & 0x80000000 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def passages(text: Column, model: Embedder) -> Column:
    """Vectors of texts as passages; null for null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            v = model.embed([f"passage: {t}" for t in s.fillna("")])
            yield pd.Series([None if t is None else row for t, row in zip(s, v, strict=True)])

    return run(text)


def query_vector(text: str, model: Embedder) -> list[float]:
    return [float(x) for x in model.embed([f"query: {text}"])[0]]


class LazyEmbedder:
    """Loads a model at its first use; a failed load is tried again."""

    def __init__(self, load):
        self.load, self.model, self.state, self.error = load, None, "cold", None

    def get(self) -> Embedder:
        if self.model is None:
            self.state = "loading"
            try:
                self.model, self.state = self.load(), "ready"
            except Exception as e:
                self.state, self.error = "failed", str(e)
                raise
        return self.model
