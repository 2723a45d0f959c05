"""Cutting long documents at natural boundaries, by pointer doubling.

Every token start that is also a character start is a boundary with a rank: paragraph, line,
sentence, word, other. Each boundary is joined with its farthest legal successor: the last
boundary of the highest rank in the second half of what a piece may still hold, else the
last word boundary anywhere in it, else the last boundary. Squaring the successor table
log2(n) times marks all cuts reached from the start, without walking piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.tokenizer import default_path, slices, worker_encoder

LIMIT = 1024
OVERLAP = 64
RANKS = ("other", "word", "sentence", "line", "paragraph")


def boundaries(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """Rank of each token start (byte offsets, the last is the end); -1 within a character."""
    b = np.frombuffer(b"\n" + raw + b"\n", np.uint8)  # b[i + 1] is the byte at i
    at = starts + 1
    here, before = b[at], b[at - 1]
    before2, before3 = b[np.maximum(at - 2, 0)], b[np.maximum(at - 3, 0)]
    space = np.isin(here, np.frombuffer(b" \t\r\n\f\v", np.uint8))
    rank = np.zeros(len(starts), np.int64)
    rank[space | np.isin(before, np.frombuffer(b" \t\r\n\f\v", np.uint8))] = 1
    rank[space & np.isin(before, np.frombuffer(b".!?", np.uint8))] = 2
    rank[before == 10] = 3
    rank[((before == 10) & ((before2 == 10) | ((before2 == 13) & (before3 == 10)))) | (before == 12)] = 4
    rank[(here & 0xC0) == 0x80] = -1
    return rank


def successors(rank: np.ndarray, n: int, limit: int, overlap: int) -> np.ndarray:
    """Farthest legal cut after each token position, n at the end and from n itself."""
    at = np.arange(n + 1)
    stop = np.maximum(at - overlap, 0) + limit
    middle = at + (stop - at) // 2
    to = np.full(n + 1, -1)
    for least, low in ((4, middle), (3, middle), (2, middle), (1, middle), (1, at), (0, at)):
        where = np.flatnonzero(rank == least) if low is middle else np.flatnonzero(rank >= least)
        if len(where):
            k = np.searchsorted(where, stop, side="right") - 1
            found = where[np.maximum(k, 0)]
            to = np.where((to < 0) & (k >= 0) & (found > low), found, to)
    to = np.where(to < 0, np.minimum(stop, n), to)
    return np.where(stop >= n, n, to)


def cuts(successor: np.ndarray) -> np.ndarray:
    """All positions reached from 0, in order; the last is the end."""
    n = len(successor) - 1
    reached = np.zeros(n + 1, bool)
    reached[0] = True
    steps = 1
    while steps <= n:
        reached[successor[reached]] = True
        successor = successor[successor]
        steps *= 2
    return np.flatnonzero(reached)


def split_documents(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, path: str | None = None) -> DataFrame:
    """Pieces of the documents above limit tokens; others, null and empty ones have none.

    Columns: key, piece_no, first_token, new_token, end_token, cut (rank of the boundary at the
    end), ids, new_text, text. ids are the document's tokens first_token..end_token; each piece
    but the first begins with the last overlap tokens of the one before. new_text without the
    overlap joins to the whole document; text begins at the first whole character of ids.
    Repeated rows are cut each for itself; a null key stays null. No shuffle.
    """
    path = path or default_path()
    schema = f"{key} {df.schema[key].dataType.simpleString()}, piece_no int, first_token int, new_token int, end_token int, cut string, ids array<int>, new_text string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(path)
        size_of = np.zeros(max(enc.vocab.bytes_of) + 1, np.int64)
        for i, x in enc.vocab.bytes_of.items():
            size_of[i] = len(x)
        names = [x.split()[0] for x in schema.split(", ")]
        for whole in batches:
            for b in slices(whole, 64):
                keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                flat, per = enc.encode(texts)
                rows: list[tuple] = []
                for k, t, ids in zip(keys, texts, np.split(flat, np.cumsum(per)[:-1]), strict=True):
                    n = len(ids)
                    if n <= limit:
                        continue
                    raw = t.encode()
                    off = np.concatenate([[0], np.cumsum(size_of[ids])])
                    rank = boundaries(raw, off)
                    c = cuts(successors(rank, n, limit, overlap)).tolist()
                    for p, (s, e) in enumerate(zip(c[:-1], c[1:], strict=True)):
                        first = max(0, s - overlap) if p else 0
                        begin = int(off[first])
                        while begin < off[s] and (raw[begin] & 0xC0) == 0x80:
                            begin += 1
                        new = raw[off[s] : off[e]].decode()
                        rows.append((k, p, first, s, e, "end" if e == n else RANKS[rank[e]], ids[first:e], new, raw[begin : off[s]].decode() + new))
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                types = [b.schema.field(0).type, *[pa.int32()] * 4, pa.string(), pa.list_(pa.int32()), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, types, strict=True)], names=names)

    # A token has at least one byte, so a shorter text cannot exceed the limit.
    return df.filter(F.octet_length(text) > limit).select(key, text).mapInArrow(run, schema)
