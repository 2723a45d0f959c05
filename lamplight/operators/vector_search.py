"""Exact and quantised vector search, and the quantised index with its proof of freshness."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.operators.search import clamp_limit
from lamplight.session import any_of, read_text, write_text
from lamplight.functions.vectors import bit_codes, cosine_to, int8_codes, literal

#: Results beyond the limit that a coarse ranking hands on, so that rounding cannot lose a tie.
MARGIN = 100


def pool_size(limit: int) -> int:
    """Candidates of a quantised search that are ranked again exactly."""
    return max(limit, min(10 * limit, 200))


def rankable(chunks: DataFrame, model: str | None, width: int) -> DataFrame:
    """Vectors of the query's model and width; others must not be compared."""
    own = F.lit(True) if model is None else F.col("model") == model
    return chunks.filter(own & (F.size("embedding") == width))


def scan_statistics(chunks: DataFrame, model: str, width: int) -> DataFrame:
    """One row: vectors compared and skipped, and up to four other models, by name."""
    own = (F.col("model") == model) & (F.size("embedding") == width)
    other = F.when(F.col("model") != model, F.col("model"))
    return chunks.filter(F.col("embedding").isNotNull()).agg(
        F.count_if(own).alias("compared"), F.count_if(~F.coalesce(own, F.lit(False))).alias("skipped"), F.slice(F.array_sort(F.collect_set(other)), 1, 4).alias("other_models")
    )


def nominate(vectors: DataFrame, query: list[float], k: int, id: str, embedding: str) -> DataFrame:
    """(id): the k best of each task by a vectorised kernel; a superset of the k best of all."""
    q = np.asarray(query, np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sims = np.zeros(0, np.int64), np.zeros(0, np.float32)
        for b in batches:
            if not b.num_rows:
                continue
            x = _rows(b.column(1))
            with np.errstate(all="ignore"):
                s = (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
            ids, sims = np.concatenate([ids, b.column(0).to_numpy()]), np.concatenate([sims, np.where(np.isfinite(s), s, -1).astype(np.float32)])
            if len(ids) > 8 * k:
                keep = np.argpartition(-sims, k - 1)[:k]
                ids, sims = ids[keep], sims[keep]
        keep = np.argsort(-sims, kind="stable")[:k]
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(sims[keep].astype(float))], names=["id", "sim"])

    return vectors.select(F.col(id).alias("id"), F.col(embedding).alias("e")).mapInArrow(run, "id long, sim double")


def exact_search(vectors: DataFrame, query: list[float], k: int, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id, score) of the k vectors of highest single-precision cosine; ties to the lower id.

    vectors: one width, not null. The kernel nominates k and a margin; only those are scored
    bit for bit as a sequential loop would. Vectors of no length or not finite score -1.
    """
    near = [r.id for r in nominate(vectors, query, k + MARGIN, id, embedding).orderBy(F.desc("sim"), "id").limit(k + MARGIN).select("id").collect()]
    mine = vectors.filter(any_of(id, near)).select(F.col(id).alias("id"), F.col(embedding).alias("e"))  # k + MARGIN rows
    return mine.select("id", cosine_to(query, F.col("e")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def centre(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(dim, mean): not finite elements count in the number of rows but not in the sum."""
    e = vectors.select(F.posexplode(embedding).alias("dim", "x"))
    fine = F.when(~F.isnan("x") & (F.abs("x") < F.lit(float("inf"))), F.col("x").cast("double")).otherwise(0.0)
    return e.groupBy("dim").agg((F.sum(fine) / F.count("*")).alias("mean"))


def centre_vector(vectors: DataFrame, embedding: str = "embedding") -> list[float]:
    return [r.mean for r in centre(vectors, embedding).orderBy("dim").collect()]  # a row a dimension


def codes(vectors: DataFrame, tier: str, middle: list[float] | None = None, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id, code) of tier float, int8 or bit (against the centre), as arrays in the JVM."""
    e = F.col(embedding)
    made = {"float": lambda: e, "int8": lambda: int8_codes(e), "bit": lambda: bit_codes(e, literal(middle or []))}[tier]()
    return vectors.select(F.col(id).alias("id"), made.alias("code"))


def pack(x: np.ndarray, tier: str, middle: np.ndarray | None = None) -> np.ndarray:
    """Rows of vectors as rows of bytes: four an element, one, or one bit; as codes() otherwise."""
    if tier == "float":
        return np.ascontiguousarray(x, np.float32).view(np.uint8)
    with np.errstate(all="ignore"):
        if tier == "bit":
            return np.packbits(x.astype(np.float64) > middle, axis=1, bitorder="little")
        fine = np.isfinite(x)
        top = np.where(fine, np.abs(x), 0).max(axis=1, keepdims=True, initial=0)
        p = (x * (np.float32(127) / top)).astype(np.float32)
        whole = np.sign(p) * np.floor(np.abs(p).astype(np.float64) + 0.5)
        return np.where(fine & (top > 0), np.clip(whole, -127, 127), 0).astype(np.int8).view(np.uint8)


def packed_codes(vectors: DataFrame, tier: str, middle: list[float] | None = None, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id, code binary) of vectors of one width, not null: what an index stores."""
    c = None if middle is None else np.asarray(middle, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pack(_rows(b.column(1)), tier, c) if b.num_rows else np.zeros((0, 1), np.uint8)
            data, n = pa.py_buffer(np.ascontiguousarray(rows)), rows.shape[1]
            stops = pa.py_buffer(np.arange(0, (len(rows) + 1) * n, max(n, 1), dtype=np.int32)[: len(rows) + 1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.binary(), len(rows), [None, stops, data])], names=["id", "code"])

    return vectors.select(F.col(id).cast("long").alias("id"), F.col(embedding).alias("e")).mapInArrow(run, "id long, code binary")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1)


def _codes(column: pa.Array, n: int) -> np.ndarray:
    """Rows of the bytes of codes of one length, without a copy."""
    wide = pa.types.is_large_binary(column.type)
    start = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * n].reshape(-1, n)


def coarse_distances(x: np.ndarray, q: np.ndarray, tier: str) -> np.ndarray:
    """Of rows of codes from a query's code: differing bits, or one minus the cosine (2 without a direction)."""
    if tier == "bit":
        return np.bitwise_count(x ^ q).sum(axis=1, dtype=np.int64).astype(np.float64)
    kind = np.int8 if tier == "int8" else np.float32
    a, b = x.view(kind).astype(np.float32), q.view(kind).astype(np.float32)
    with np.errstate(all="ignore"):
        s = (a @ b).astype(np.float64) / (np.sqrt(np.einsum("ij,ij->i", a, a).astype(np.float64)) * np.sqrt(float(b @ b)))
    return np.where(np.isfinite(s), 1 - s, 2.0)


def nearest_codes(index: DataFrame, query: np.ndarray, tier: str, k: int) -> DataFrame:
    """(id, d): of (id, code) the k nearest of each task, a superset of the k nearest of all; ties to the lower id."""
    q = np.asarray(query, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ds = np.zeros(0, np.int64), np.zeros(0)
        for b in batches:
            if b.num_rows:
                ids, ds = np.concatenate([ids, b.column(0).to_numpy()]), np.concatenate([ds, coarse_distances(_codes(b.column(1), len(q)), q, tier)])
                if len(ids) > 8 * k:
                    keep = np.lexsort((ids, ds))[:k]
                    ids, ds = ids[keep], ds[keep]
        keep = np.lexsort((ids, ds))[:k]
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(ds[keep], pa.float64())], names=["id", "d"])

    return index.select("id", "code").mapInArrow(run, "id long, d double")


def fast_search(vectors: DataFrame, index: DataFrame, query: list[float], k: int, tier: str, middle: list[float] | None = None, pool: int | None = None, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """(id, score): the pool nearest by quantised codes, ranked again by exact cosine.

    index: (id, code) as made by packed_codes(). The query is encoded in the same way. A float index
    holds the vectors themselves, so its pool is the limit and a margin for rounding.
    """
    q = pack(np.asarray([query], np.float32), tier, None if middle is None else np.asarray(middle, np.float64))[0]
    size = pool or (k + MARGIN if tier == "float" else pool_size(k))
    near = [r.id for r in nearest_codes(index, q, tier, size).orderBy("d", "id").limit(size).select("id").collect()]  # pool rows
    mine = vectors.filter(any_of(id, near)).select(F.col(id).alias("id"), F.col(embedding).alias("e"))
    return mine.select("id", cosine_to(query, F.col("e")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hydrate(hits: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Winners with path, name, place and content, read for them alone; chunks of no file vanish."""
    c = chunks.select("id", "file_id", "chunk_index", "content", "page_start", "page_end").join(F.broadcast(hits), "id")
    f = files.select(F.col("id").alias("file_id"), "path", "name")
    return c.join(f, "file_id").select("path", "name", "chunk_index", "score", "content", "page_start", "page_end", "id").orderBy(F.desc("score"), "id")


def recall(found: DataFrame, true: DataFrame, key: str = "q", id: str = "id") -> DataFrame:
    """(key, recall): share of the true results that were found."""
    t = true.select(key, id).distinct()
    hit = t.join(found.select(key, id).distinct().withColumn("hit", F.lit(1)), [key, id], "left")
    return hit.groupBy(key).agg((F.count("hit") / F.count("*")).alias("recall"))


@dataclass
class IndexState:
    """What an index was built from; kept beside it and compared before it is used."""

    model: str
    dimensions: int
    tier: str
    vectors: int
    chunks: int
    job: str | None = None
    centre: list[float] = field(default_factory=list)
    #: Folders of codes and of ids that left, with their numbers.
    parts: list[list] = field(default_factory=list)
    gone: list[list] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str | None) -> IndexState | None:
        """None for a missing or corrupt marker."""
        try:
            return IndexState(**json.loads(text)) if text else None
        except (ValueError, TypeError):
            return None


def usable(state: IndexState | None, tier: str, model: str, width: int, chunks: int, job: str | None, has_table: bool = True) -> tuple[str, str]:
    """('ready' | 'absent' | 'declined', reason): an index is used only if it is proven fresh."""
    if not has_table or state is None:
        return "absent", "no index" if not has_table else "no readable marker"
    checks = [
        (state.tier == tier, f"the index has tier {state.tier}"),
        (state.model == model, f"the index is of model {state.model}"),
        (state.dimensions == width, f"the index has {state.dimensions} dimensions"),
        (state.vectors > 0, "the index is empty"),
        (tier != "bit" or len(state.centre) == width, "the index has no centre of its width"),
        (state.job == job, "a later run changed the corpus"),
        (state.chunks == chunks, f"the index was built from {state.chunks} chunks, there are {chunks}"),
    ]
    bad = next((why for ok, why in checks if not ok), None)
    return ("declined", bad) if bad else ("ready", "")


#: An index keeps the vectors and one quantised tier side by side.
SLOTS = {"float": "float", "int8": "quantised", "bit": "quantised"}


class VectorIndex:
    """Indexes of a corpus in a folder, one a slot: codes as parquet, the marker written last.

    A change appends codes and the ids that left; the marker names the folders.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def build(self, chunks: DataFrame, model: str, width: int, tier: str, job: str | None = None) -> IndexState:
        """Replace what the tier's slot holds."""
        slot = SLOTS[tier]
        self.drop(slot)
        mine = rankable(chunks, model, width)
        state = IndexState(model, width, tier, 0, 0, job, centre_vector(mine) if tier == "bit" else [])
        return self._append(slot, state, mine, None, chunks.count())

    def _append(self, slot: str, state: IndexState, added: DataFrame, left: DataFrame | None, chunks: int) -> IndexState:
        n = max([0, *(p[1] for p in state.parts)]) + 1
        at = f"{slot}/codes-{n}"
        packed_codes(added, state.tier, state.centre or None).withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{self.path}/{at}")
        state.parts.append([at, n])
        if left is not None:
            left.select("id").withColumn("left", F.lit(n)).write.mode("overwrite").parquet(f"{self.path}/{slot}/gone-{n}")
            state.gone.append([f"{slot}/gone-{n}", n])
        state.vectors, state.chunks = self._codes(state).count(), chunks
        write_text(self.spark, f"{self.path}/{slot}/marker", state.to_json(), overwrite=True)
        return state

    def follow(self, chunks: DataFrame, job: str | None = None) -> dict[str, tuple[int, int]]:
        """Bring every slot to the chunks: codes of new ids are appended, ids no longer there leave.

        A chunk id stands for one vector for good. Writes in proportion to the change; (added, left) by slot.
        """
        out = {}
        for slot in dict.fromkeys(SLOTS.values()):
            if (state := self.state(slot)) is None:
                continue
            mine = rankable(chunks, state.model, state.dimensions)
            have = self._codes(state).select("id")
            added, left = mine.join(have, "id", "left_anti"), have.join(mine.select("id"), "id", "left_anti")
            out[slot], state.job = (added.count(), left.count()), job
            self._append(slot, state, added, left, chunks.count())
        return out

    def state(self, slot: str = "quantised") -> IndexState | None:
        return IndexState.from_json(read_text(self.spark, f"{self.path}/{slot}/marker"))

    def _codes(self, state: IndexState) -> DataFrame:
        df = self.spark.read.schema("id long, code binary, n int").parquet(*(f"{self.path}/{at}" for at, _ in state.parts))
        if state.gone:
            left = self.spark.read.schema("id long, left int").parquet(*(f"{self.path}/{at}" for at, _ in state.gone)).groupBy("id").agg(F.max("left").alias("left"))
            df = df.join(left, "id", "left").filter(F.col("left").isNull() | (F.col("n") >= F.col("left")))
        return df.select("id", "code")

    def codes(self, slot: str = "quantised") -> DataFrame:
        return self._codes(self.state(slot))

    def drop(self, slot: str | None = None) -> None:
        """Markers first, so that no reader trusts what is left."""
        for s in [slot] if slot else dict.fromkeys(SLOTS.values()):
            for name in (f"{s}/marker", s):
                fs, p = self._fs(name)
                fs.delete(p, True)

    def describe(self) -> dict:
        """What each slot holds, for a status report; folders and centres aside."""
        found = {s: self.state(s) for s in dict.fromkeys(SLOTS.values())}
        return {s: None if x is None else {"tier": x.tier, "model": x.model, "dimensions": x.dimensions, "vectors": x.vectors, "chunks": x.chunks, "job": x.job} for s, x in found.items()}

    def search(self, chunks: DataFrame, query: list[float], k: int, model: str, job: str | None = None, exact: bool = False) -> tuple[DataFrame, dict]:
        """Hits and how they were found: by an index that is proven fresh, the quantised one first, else by a scan.

        exact: no quantised index.
        """
        k, n = clamp_limit(k), chunks.count()
        mine, notes = rankable(chunks, model, len(query)), []
        for slot in ["float"] if exact else ["quantised", "float"]:
            state = self.state(slot)
            verdict, why = usable(state, state.tier if state else "", model, len(query), n, job)
            if verdict == "ready":
                hits = fast_search(mine, self._codes(state), query, k, state.tier, state.centre or None)
                return hits, {"path": state.tier, "exact": state.tier == "float", "note": None} | ({} if state.tier == "float" else {"candidates": pool_size(k)})
            notes += [why] if verdict == "declined" else []
        return exact_search(mine, query, k), {"path": "scan", "exact": True, "note": notes[0] if notes else None}


def corpus_dimensions(chunks: DataFrame) -> DataFrame:
    """(model, dimensions, n) of the stored vectors, most first."""
    v = chunks.filter(F.col("embedding").isNotNull())
    return v.groupBy("model", F.size("embedding").alias("dimensions")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model", "dimensions")


def latency_summary(times: DataFrame, group: str, seconds: str) -> DataFrame:
    """(group, n, best, median, worst); the median of an even number is the upper of the two."""
    s = F.array_sort(F.collect_list(seconds))  # a row a measured query
    per = times.filter(F.col(seconds).isNotNull()).groupBy(group).agg(s.alias("s"))
    return per.select(group, F.size("s").alias("n"), F.element_at("s", 1).alias("best"), F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int")).alias("median"), F.element_at("s", -1).alias("worst"))
