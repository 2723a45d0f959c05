"""Corpus encoding with a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash finds whole pre-tokens that are vocabulary entries; a
pre-token that is none is merged by a heap over its linked bytes. A worker takes each distinct
pre-token through the tiers once; its ids sit in a flat pool that numpy gathers from.

Null and empty texts have an empty list. No special tokens exist: their strings in a text
are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pre-token pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct stretches a worker remembers before it starts anew; bounds its memory only.
POOL_TOKENS = 400_000
VOCABULARY = "byte_bpe_50k.tiktoken"


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PerfectHash:
    """Minimal perfect hash (compress, hash and displace) from n byte strings to 0..n-1.

    Buckets of several keys store a displacement; buckets of one key store the slot itself
    as -slot-1, which is what makes the table minimal without a long search.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        b = self._bucket(h)
        order = np.argsort(b, kind="stable")
        bounds = np.searchsorted(b[order], np.arange(self.buckets + 1))
        groups = [order[bounds[i] : bounds[i + 1]] for i in range(self.buckets)]
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        slot = np.zeros(n, dtype=np.int64)
        for i in sorted(range(self.buckets), key=lambda i: -len(groups[i])):
            own = groups[i]
            if len(own) < 2:
                break
            step = 64
            at = 0
            while True:
                d = np.arange(at, at + step, dtype=np.int64)
                where = self._place(h[own][None, :], d[:, None])
                fits = free[where].all(axis=1)
                s = np.sort(where, axis=1)
                fits &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                hit = np.flatnonzero(fits)
                if len(hit):
                    self.shift[i] = d[hit[0]]
                    slot[own] = where[hit[0]]
                    free[where[hit[0]]] = False
                    break
                at, step = at + step, min(step * 2, 4096)
                if at > 1 << 26:
                    raise ValueError("no displacement found")
        rest = iter(np.flatnonzero(free))
        for i in range(self.buckets):
            if len(groups[i]) == 1:
                s = int(next(rest))
                self.shift[i] = -s - 1
                slot[groups[i]] = s
        self.slots = slot

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(self.buckets)).astype(np.int64)

    def _place(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = h + (d.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(24)) % np.uint64(self.n)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of hashed keys; a key outside the set gets some slot, to be verified."""
        d = self.shift[self._bucket(h)]
        return np.where(d < 0, -d - 1, self._place(h, np.maximum(d, 0)))


class Vocabulary:
    """Ranks of byte strings with both tiers; small (a few MB) and of fixed size."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        keys = [base64.b64decode(a) for a, _ in pairs]
        ids = [int(b) for _, b in pairs]
        self.ranks = dict(zip(keys, ids, strict=True))
        self.bytes_of = dict(zip(ids, keys, strict=True))
        self.hash = PerfectHash(keys)
        self.key_at: list[bytes] = [b""] * len(keys)
        self.id_at = np.zeros(len(keys), dtype=np.int32)
        for s, k, i in zip(self.hash.slots.tolist(), keys, ids, strict=True):
            self.key_at[s], self.id_at[s] = k, i

    def whole(self, token: bytes) -> int:
        """The id of a pre-token that is a vocabulary entry, else -1."""
        s = int(self.hash.find(np.array([xxhash.xxh3_64_intdigest(token)], dtype=np.uint64))[0])
        return int(self.id_at[s]) if self.key_at[s] == token else -1

    def encode_distinct(self, tokens: list[bytes]) -> list[list[int]]:
        h = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], dtype=np.uint64)
        slots = self.hash.find(h).tolist() if len(tokens) else []
        return [[int(self.id_at[s])] if self.key_at[s] == t else self.merge(t) for s, t in zip(slots, tokens, strict=True)]

    def merge(self, token: bytes) -> list[int]:
        """Byte pairs joined lowest rank first, leftmost on ties; n log n in the length."""
        n = len(token)
        if n == 0:
            return []
        ranks = self.ranks
        end = list(range(1, n + 1))  # end of the piece that starts here; 0 once merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(token[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = before[i]
            if p >= 0 and (r := ranks.get(token[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : end[i]]])
            i = end[i]
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder(dict):
    """Stretch (a run of pre-tokens cut before single spaces) to its place in the pool.

    A stretch seen first is cut into pre-tokens, and these go through the two tiers. No
    pre-token reaches over a space that stands between two stretches, except within longer
    white space; such texts are cut into pre-tokens as a whole.
    """

    def __init__(self, vocab: Vocabulary):
        import regex

        self.vocab, self.split = vocab, regex.compile(PATTERN).findall
        self.wide = re.compile(r" (?=\s)(?<=\s )").search  # a space within white space
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.known: dict[str, list[int]] = {}
        self.pending: list[str] = []
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def __missing__(self, token: str) -> int:
        self[token] = at = len(self)
        self.pending.append(token)
        return at

    def _settle(self) -> None:
        if self.pending:
            parts = [self.split(t) for t in self.pending]
            fresh = {p: None for ps in parts for p in ps if p not in self.known}
            self.known.update(zip(fresh, self.vocab.encode_distinct([p.encode() for p in fresh]), strict=True))
            new = [[i for p in ps for i in self.known[p]] for ps in parts]
            lens = np.array([len(x) for x in new], np.int64)
            starts = len(self.pool) + np.cumsum(lens) - lens
            self.pool = np.concatenate([self.pool, np.array([i for x in new for i in x], np.int32)])
            self.starts, self.lens = np.concatenate([self.starts, starts]), np.concatenate([self.lens, lens])
            self.pending = []

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pool places of all stretches, and how many each text has."""
        if len(self) > POOL_TOKENS:
            self.reset()
        flat: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        look, split, wide = self.__getitem__, self.split, self.wide
        for k, text in enumerate(texts):
            if text:
                before = len(flat)
                if text[-1] == " " or wide(text):
                    flat.extend(map(look, split(text)))
                else:
                    first, *rest = text.split(" ")
                    flat.append(look(first))
                    flat.extend(map(look, map(" ".__add__, rest)))
                counts[k] = len(flat) - before
        self._settle()
        return np.array(flat, np.int64), counts

    def counts(self, texts: list[str | None]) -> np.ndarray:
        places, counts = self.places(texts)
        total = np.concatenate([[0], np.cumsum(self.lens[places])])
        stops = np.cumsum(counts)
        return total[stops] - total[stops - counts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and, for each text, its number of ids."""
        places, counts = self.places(texts)
        lens = self.lens[places]
        stop = np.cumsum(lens)
        total = int(stop[-1]) if len(stop) else 0
        at = np.arange(total) - np.repeat(stop - lens, lens) + np.repeat(self.starts[places], lens)
        ends = np.concatenate([[0], stop])
        per = ends[np.cumsum(counts)] - ends[np.cumsum(counts) - counts]
        return self.pool[at], per


_WORKER: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    """One encoder a Python worker; it reads the vocabulary file once."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(vocabulary(path))
    return _WORKER[path]


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _added(df: DataFrame, text: str, out: str, kind: T.DataType, make, path: str) -> DataFrame:
    kept = [c for c in df.columns if c != out]
    source = df.select(*kept, df[text].alias("__text"))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, kind, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(path)
        for whole in batches:
            for b in slices(whole):
                made = make(enc, b.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*kept, out])

    return source.mapInArrow(run, schema)


def _lists(enc: Encoder, texts: list[str | None]) -> pa.Array:
    ids, per = enc.encode(texts)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(ids, pa.int32()))


def with_token_ids(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """df with the list of token ids of column text.

    No shuffle; rows, repeated ones too, stay as they are. Null and empty texts have an empty
    list, an empty table stays empty. An existing column named out is replaced.
    """
    return _added(df, text, out, T.ArrayType(T.IntegerType(), False), _lists, path or default_path())


def with_token_count(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """As with_token_ids, but only the number of ids (0 for null and empty texts)."""
    return _added(df, text, out, T.IntegerType(), lambda enc, texts: pa.array(enc.counts(texts).astype(np.int32)), path or default_path())
