"""The most similar vectors of every vector, by navigable small-world graphs per shard.

Vectors of one model and width spread over cells around centroids; a cell of many vectors is
salted into several shards. Each shard's hierarchical graph is built once and stored as flat
neighbour arrays, one row a shard. Queries go to the shards of their nearest cells, in
blocks of bounded size, and the shards' results are merged and scored again exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamplight.session import cut, free

#: Vectors a cell holds on average, and a shard at most; queries a block holds at most.
CELL, SHARD, BLOCK = 4000, 8000, 20_000
#: Cells of a model from which they are fitted and found in two levels.
FLAT = 256
#: Sampled vectors a centroid is fitted on, and vectors one fit takes at most (every vector is indexed).
PER_CENTROID, SAMPLE = 64, 100_000
#: Coarse cells whose fine ones are looked at, at least.
COARSE = 16
#: Nearest cells a query visits and width of the beam, for the k most similar and for near pairs;
#: links of a node.
PROBES, BEAM, PAIR_PROBES, PAIR_BEAM, LINKS = 16, 48, 3, 20, 20
#: Where there are more cells than PROBES: share of the true k most similar that the visited cells
#: hold, and queries it is measured with, by exact search of all rows.
REACHED, TRIALS = 0.98, 256
#: Cosines in shards come from half-precision copies; candidates this close below count.
SLACK = 0.004


def usable(chunks: DataFrame, id: str = "id", embedding: str = "embedding", dimensions: str = "dimensions", model: str = "model") -> DataFrame:
    """(id, model, width, vector): as many elements as dimensions says, all finite, not all zero.

    A null model is a model of its own (empty string); null ids and vectors stay out.
    """
    v = F.col(embedding)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(3.4028235e38)))
    some = F.exists(v, lambda x: x != 0)
    keep = F.col(id).isNotNull() & v.isNotNull() & (F.size(v) == F.col(dimensions)) & (F.size(v) > 0) & fine & some
    return chunks.filter(keep).select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(model), F.lit("")).alias("model"), F.size(v).alias("width"), v.cast("array<float>").alias("vector"))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-38)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _packed(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(x, dtype=np.float16)]


def _unpacked(codes: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.float16).reshape(-1, width).astype(np.float32)


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 8192] @ c.T).argmax(axis=1) for i in range(0, len(x), 8192)])
        order = np.argsort(own, kind="stable")
        at = np.searchsorted(own[order], np.arange(len(c) + 1))
        some = np.flatnonzero(at[1:] > at[:-1])
        c[some] = np.add.reduceat(x[order], at[some], axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


@dataclass
class Cells:
    """Centroids of the cells, those of one coarse cell together; start: first of each coarse one, and the end."""

    fine: np.ndarray
    coarse: np.ndarray
    start: np.ndarray

    @staticmethod
    def flat(fine: np.ndarray) -> Cells:
        return Cells(fine, fine[:1], np.array([0, len(fine)]))

    def nearest(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m nearest cells of each row, nearest first; -1 where fewer were looked at."""
        m = min(m, len(self.fine))
        if len(self.coarse) == 1:
            return _top(x @ self.fine.T, m)[0]
        looked = min(len(self.coarse), max(COARSE, math.ceil(2 * m * len(self.coarse) / len(self.fine))))
        own = _top(x @ self.coarse.T, looked)[0]
        ids, sims = np.full((len(x), looked, m), -1, np.int64), np.full((len(x), looked, m), -2, np.float32)
        row, place = np.divmod(np.argsort(own, axis=None, kind="stable"), looked)
        at = np.searchsorted(own[row, place], np.arange(len(self.coarse) + 1))
        for c in np.flatnonzero(at[1:] > at[:-1]):
            r, j, a, b = row[at[c] : at[c + 1]], place[at[c] : at[c + 1]], self.start[c], self.start[c + 1]
            if b > a:
                top, sim = _top(x[r] @ self.fine[a:b].T, min(m, b - a))
                ids[r, j, : top.shape[1]], sims[r, j, : top.shape[1]] = top + a, sim
        best, sim = _top(sims.reshape(len(x), -1), m)
        return np.where(sim > -2, np.take_along_axis(ids.reshape(len(x), -1), best, 1), -1)


def _top(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the m largest of each row, largest first, and their values."""
    top = np.argpartition(-s, m - 1, axis=1)[:, :m]
    v = np.take_along_axis(s, top, 1)
    by = np.argsort(-v, axis=1, kind="stable")
    return np.take_along_axis(top, by, 1), np.take_along_axis(v, by, 1)


def _links(x: np.ndarray, m: int) -> np.ndarray:
    """Neighbours of each row among the rows: diverse near ones and those they are near to, -1 padded."""
    n = len(x)
    if n <= m + 1:
        all_ = np.tile(np.arange(n), (n, 1))
        return np.concatenate([np.where(all_ == np.arange(n)[:, None], -1, all_), np.full((n, max(0, m - n)), -1)], axis=1)[:, : max(m, n)].astype(np.int32)
    k = min(n - 1, m + m // 2)
    near, sims = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    for i in range(0, n, 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        v = np.take_along_axis(s, top, axis=1)
        by = np.argsort(-v, axis=1, kind="stable")
        near[i : i + 512], sims[i : i + 512] = np.take_along_axis(top, by, axis=1), np.take_along_axis(v, by, axis=1)
    keep = np.ones((n, k), bool)
    for i in range(0, n, 512):  # a candidate nearer to a kept one than to the row is reached through that
        c = x[near[i : i + 512]]
        between = np.einsum("nid,njd->nij", c, c, optimize=True)
        kept = keep[i : i + 512]
        for j in range(1, k):
            kept[:, j] = ~((between[:, j, :j] > sims[i : i + 512, j, None]) & kept[:, :j]).any(axis=1)
    half = (np.cumsum(keep, axis=1) <= m) & keep
    half |= (np.cumsum(~half, axis=1) <= np.maximum(m // 2 - half.sum(axis=1), 0)[:, None]) & ~half
    src = np.repeat(np.arange(n, dtype=np.int32), half.sum(axis=1))
    dst, w = near[half], sims[half]
    a, b, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])
    by = np.lexsort((b, -w, a))
    a, b = a[by], b[by]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b = a[first], b[first]
    start = np.searchsorted(a, np.arange(n))
    rank = np.arange(len(a)) - start[a]
    out = np.full((n, m), -1, np.int32)
    ok = rank < m
    out[a[ok], rank[ok]] = b[ok]
    return out


class Graph:
    """Layers of a hierarchical graph over unit vectors, as flat neighbour arrays."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.layers = x, layers

    @staticmethod
    def build(x: np.ndarray, links: int = LINKS, seed: int = 3) -> Graph:
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(x))) / math.log(links)).astype(int)
        layers = []
        for h in range(int(level.max(initial=0)) + 1):
            nodes = np.flatnonzero(level >= h).astype(np.int32)
            layers.append((nodes, _links(x[nodes], links if h else links + links // 4)))
            if len(nodes) <= links:
                break
        return Graph(x, layers)

    def flat(self) -> tuple[bytes, list[int]]:
        """The arrays behind each other, and the shape of each layer."""
        parts, shape = [], []
        for nodes, near in self.layers:
            parts += [nodes.tobytes(), np.ascontiguousarray(near).tobytes()]
            shape += [len(nodes), near.shape[1]]
        return b"".join(parts), shape

    @staticmethod
    def of(x: np.ndarray, flat: bytes, shape: list[int]) -> Graph:
        a, at, layers = np.frombuffer(flat, np.int32), 0, []
        for n, m in zip(shape[::2], shape[1::2], strict=True):
            layers.append((a[at : at + n], a[at + n : at + n + n * m].reshape(n, m)))
            at += n + n * m
        return Graph(x, layers)

    def search(self, q: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k best found for each query, -1 padded; all queries step together."""
        top_nodes, _ = self.layers[-1]
        at = top_nodes[(q @ self.x[top_nodes].T).argmax(axis=1)] if len(top_nodes) else np.zeros(len(q), np.int64)
        for nodes, near in self.layers[-2:0:-1]:
            at = self._descend(q, at, nodes, near)
        return self._beam(q, at, self.layers[0][1], k, max(beam, k))

    def _descend(self, q: np.ndarray, at: np.ndarray, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
        place = np.full(len(self.x), -1, np.int32)
        place[nodes] = np.arange(len(nodes))
        at = at.copy()
        best = np.einsum("qd,qd->q", q, self.x[at])
        live = np.arange(len(q))
        while len(live):
            c = near[place[at[live]]]
            s = np.matmul(self.x[nodes[np.maximum(c, 0)]], q[live][:, :, None])[:, :, 0]
            s[c < 0] = -2
            j = s.argmax(axis=1)
            up = s[np.arange(len(live)), j] > best[live]
            live, j, c, s = live[up], j[up], c[up], s[up]
            best[live] = s[np.arange(len(live)), j]
            at[live] = nodes[c[np.arange(len(live)), j]]
        return at

    def _beam(self, q: np.ndarray, at: np.ndarray, near: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(q), near.shape[1]
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -2, np.float32)
        fresh = np.zeros((n, beam), bool)
        ids[:, 0], sims[:, 0], fresh[:, 0] = at, np.einsum("qd,qd->q", q, self.x[at]), True
        seen = np.zeros((n, (len(self.x) + 7) // 8 * 8), bool) if n * len(self.x) <= 1 << 26 else None
        if seen is None:  # bounded memory: in halves
            h = n // 2
            a, b = self._beam(q[:h], at[:h], near, k, beam), self._beam(q[h:], at[h:], near, k, beam)
            return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        seen[np.arange(n), at] = True
        live = np.arange(n)
        take = 2
        while len(live):
            # the two best candidates not yet expanded
            s = np.where(fresh[live], sims[live], -3)
            pick = np.argpartition(-s, take - 1, axis=1)[:, :take] if beam > take else np.argsort(-s, axis=1)[:, :take]
            good = np.take_along_axis(s, pick, axis=1) > -2.5
            some = good.any(axis=1)
            live, pick, good = live[some], pick[some], good[some]
            if not len(live):
                break
            fresh[live[:, None], pick] &= ~good
            src = np.where(good, ids[live[:, None], pick], -1)
            c = np.where(src[:, :, None] >= 0, near[np.maximum(src, 0)], -1).reshape(len(live), take * width)
            new = (c >= 0) & ~seen[live[:, None], np.maximum(c, 0)]
            row, col = np.nonzero(new)
            node = c[row, col]
            seen[live[row], node] = True
            v = np.einsum("pd,pd->p", self.x[node], q[live[row]])
            # only those that beat the worst of the beam are merged
            win = v > sims[live[row], beam - 1]
            row, node, v = row[win], node[win], v[win]
            if not len(row):
                continue
            many = np.bincount(row, minlength=len(live))
            most = int(many.max())
            rank = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            add = np.full((len(live), most), -1, np.int32)
            sv = np.full((len(live), most), -2, np.float32)
            add[row, rank], sv[row, rank] = node, v
            touched = np.flatnonzero(many)
            t = live[touched]
            i2, s2 = np.concatenate([ids[t], add[touched]], axis=1), np.concatenate([sims[t], sv[touched]], axis=1)
            f2 = np.concatenate([fresh[t], add[touched] >= 0], axis=1)
            # a node that both expanded candidates lead to counts once
            by = np.argsort(-s2, axis=1, kind="stable")
            i2, s2, f2 = np.take_along_axis(i2, by, 1), np.take_along_axis(s2, by, 1), np.take_along_axis(f2, by, 1)
            twin = np.zeros(i2.shape, bool)
            twin[:, 1:] = (i2[:, 1:] == i2[:, :-1]) & (i2[:, 1:] >= 0)
            if twin.any():
                s2[twin], f2[twin], i2[twin] = -2, False, -1
                by = np.argsort(-s2, axis=1, kind="stable")
                i2, s2, f2 = np.take_along_axis(i2, by, 1), np.take_along_axis(s2, by, 1), np.take_along_axis(f2, by, 1)
            ids[t], sims[t], fresh[t] = i2[:, :beam], s2[:, :beam], f2[:, :beam]
        return ids[:, :k], sims[:, :k]


def _prepared(vectors: DataFrame) -> DataFrame:
    """(id, model, width, copy, code): a hash of the exact vector and its half-precision unit form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = b.column(2).to_numpy()
            flat = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            stop = np.cumsum(width)
            codes: list[bytes] = [b""] * b.num_rows
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                x = unit(flat[(stop[rows] - w)[:, None] + np.arange(w)[None, :]])
                for r, c in zip(rows, _packed(x), strict=True):
                    codes[r] = c
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(codes, pa.binary())], names=["id", "model", "width", "copy", "code"])

    copy = F.unhex(F.md5(F.concat_ws(",", F.col("vector").cast("array<string>")))).alias("copy")
    return vectors.select("id", "model", "width", "vector", copy).mapInArrow(run, "id long, model string, width int, copy binary, code binary")


def _fit(base: DataFrame, n: int, cell: int, flat: int) -> Cells | None:
    """Cells of the n rows of one model and width; None where one cell is enough.

    Few centroids are fitted on the driver from PER_CENTROID sampled rows each. Beyond flat of them the
    driver fits only the square root of their number, as coarse cells, and executors fit the fine ones
    of each coarse cell from its part of the sample.
    """
    k = max(1, round(n / cell))
    if k == 1:
        return None
    roots = k if k <= flat else math.ceil(math.sqrt(k))
    width = base.select("width").first()[0]
    some = lambda rows: base.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n // max(rows, 4096)))) == 0)
    x = _unpacked([r.code for r in some(PER_CENTROID * roots).orderBy("id").select("code").collect()], width)
    top = centroids(x, roots) if len(x) >= roots else x
    if k <= flat:
        return Cells.flat(top)
    shared = base.sparkSession.sparkContext.broadcast(top)  # square root of the number of cells

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = (_unpacked(b.column(1).to_pylist(), width) @ shared.value.T).argmax(axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32())], names=["id", "code", "coarse"])

    homed = cut(some(PER_CENTROID * k).select("id", "code").mapInArrow(home, "id long, code binary, coarse int"))
    sizes = {r.coarse: r.n for r in homed.groupBy("coarse").agg(F.count("*").alias("n")).collect()}  # a row a coarse cell
    share = max(1, n // (PER_CENTROID * k))  # rows that a sampled one stands for
    thin = F.element_at(F.create_map(*(F.lit(v) for c, m in sizes.items() for v in (c, max(1, math.ceil(m / SAMPLE))))), F.col("coarse"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = _unpacked(pdf.sort_values("id")["code"].tolist(), width)
        want = max(1, min(round(sizes[key[0]] * share / cell), 1 + len(y) // 16))
        return pd.DataFrame({"coarse": np.full(1, key[0], np.int32), "fine": [centroids(y, want).astype(np.float32).tobytes()]})

    fine = {r.coarse: np.frombuffer(r.fine, np.float32).reshape(-1, width) for r in homed.filter(F.pmod(F.xxhash64("id", F.lit(7)), thin) == 0).groupBy("coarse").applyInPandas(fit, "coarse int, fine binary").collect()}
    free(homed)
    parts = [fine.get(c, top[c : c + 1]) for c in range(len(top))]
    return Cells(np.concatenate(parts), top, np.cumsum([0, *map(len, parts)]))


def _measured(homed: DataFrame, queries: DataFrame, cells: Cells, k: int, probes: int) -> int:
    """Nearest cells that hold REACHED of the true k most similar of TRIALS queries; at least probes.

    homed and queries: rows of one model and width. The true ones are found exactly, among all rows.
    """
    some = queries.orderBy(F.xxhash64("id"), "id").limit(TRIALS).select("id", "code").collect()
    if not some:
        return probes
    width = cells.fine.shape[1]
    q, who = _unpacked([r.code for r in some], width), np.array([r.id for r in some])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sims, cells = np.full((len(q), k), -2, np.float32), np.full((len(q), k), -1, np.int32)
        for b in batches:
            ids, codes, own = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_numpy()
            for i in range(0, len(ids), 4096):
                s = q @ _unpacked(codes[i : i + 4096], width).T
                s[who[:, None] == ids[None, i : i + 4096]] = -2
                s = np.concatenate([sims, s], axis=1)
                x = np.concatenate([cells, np.broadcast_to(own[i : i + 4096], (len(q), s.shape[1] - k))], axis=1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                sims, cells = np.take_along_axis(s, top, 1), np.take_along_axis(x, top, 1)
        row, col = np.nonzero(sims > -2)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(sims[row, col], pa.float32()), pa.array(cells[row, col], pa.int32())], names=["q", "sim", "cell"])

    found = homed.select("id", "code", "cell").mapInArrow(best, "q int, sim float, cell int")  # TRIALS times k a task
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "cell")
    true = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "cell").collect()  # TRIALS times k
    place = [{int(c): i for i, c in enumerate(row)} for row in cells.nearest(q, len(cells.fine))]
    ranks = np.sort([place[r.q].get(r.cell, len(cells.fine)) for r in true])
    return max(probes, int(ranks[math.ceil(REACHED * len(ranks)) - 1]) + 1) if len(ranks) else probes


def _cells(base: DataFrame, queries: DataFrame, cell: int, probes: int, measured: int = 0, flat: int = FLAT) -> tuple[DataFrame, DataFrame]:
    """base with cell; queries with the array of the cells they visit, nearest first.

    measured: where there are more cells than probes, visit as many as that number of most similar needs.
    """
    spark = base.sparkSession
    sizes = {(r.model, r.width): r.n for r in base.groupBy("model", "width").agg(F.count("*").alias("n")).collect()}  # a row a model
    fitted = {}
    for (model, width), n in sizes.items():
        if (found := _fit(base.filter((F.col("model") == model) & (F.col("width") == width)), n, cell, flat)) is not None:
            fitted[model, width] = found
    shared = spark.sparkContext.broadcast(fitted)  # n / CELL centroids, a 4000th of the vectors

    def assign(many: dict[tuple, int], least: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                models, width, codes = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
                out: list[list[int]] = [[0]] * b.num_rows
                groups: dict[tuple, list[int]] = {}
                for k, key in enumerate(zip(models, width, strict=True)):
                    groups.setdefault(key, []).append(k)
                for key, rows in groups.items():
                    c = shared.value.get(key)
                    if c is None:
                        continue
                    for i in range(0, len(rows), 4096):
                        part = rows[i : i + 4096]
                        top = c.nearest(_unpacked([codes[k] for k in part], key[1]), many.get(key, least))
                        for k, t in zip(part, top.tolist(), strict=True):
                            out[k] = [x for x in t if x >= 0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=["id", "model", "width", "code", "cells"])

        return run

    schema = "id long, model string, width int, code binary, cells array<int>"
    of = lambda df, many, least: df.select("id", "model", "width", "code").mapInArrow(assign(many, least), schema)
    homed = cut(of(base, {}, 1).withColumn("cell", F.element_at("cells", 1)).drop("cells"))
    many = {}
    for (model, width), c in fitted.items():
        if measured and len(c.fine) > probes:
            one = (F.col("model") == model) & (F.col("width") == width)
            many[model, width] = _measured(homed.filter(one), queries.filter(one), c, measured, probes)
    return homed, of(queries, many, probes)


def _graphs(base: DataFrame) -> DataFrame:
    """One row a shard: its ids, codes, and graph as flat neighbour arrays."""
    counts = base.groupBy("model", "width", "cell").agg(F.count("*").alias("n"))
    salts = counts.select("model", "width", "cell", F.ceil(F.col("n") / SHARD).cast("int").alias("salts"))
    salted = base.join(salts, ["model", "width", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = _unpacked(pdf["code"].tolist(), int(pdf["width"].iloc[0]))
        flat, shape = Graph.build(x).flat()
        one = pdf.iloc[0]
        return pd.DataFrame({"model": [one["model"]], "width": [one["width"]], "cell": [one["cell"]], "salt": [one["salt"]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "codes": [b"".join(pdf["code"])], "graph": [flat], "shape": [shape]})

    schema = "model string, width int, cell int, salt int, ids binary, codes binary, graph binary, shape array<int>"
    return salted.select("model", "width", "cell", "salt", "id", "code").groupBy("model", "width", "cell", "salt").applyInPandas(build, schema)


def candidates(base: DataFrame, queries: DataFrame, k: int, probes: int = PROBES, least: float = -2.0, cell: int = CELL, beam: int = BEAM, measured: bool = False, flat: int = FLAT) -> tuple[DataFrame, list[DataFrame]]:
    """(q, b, sim): up to k results of each query in each shard it visits, at least least; never itself.

    base and queries: (id, model, width, code), one row an id. measured: probes is the least, and
    follows the cells as far as the k most similar of some queries lie (REACHED). The second result
    is what can be freed once the first is written.
    """
    homed, asked = _cells(base, queries, cell, probes, k if measured else 0, flat)
    graphs = cut(_graphs(homed))
    visits = cut(asked.select("id", "model", "width", "code", F.explode("cells").alias("cell")))
    key = ["model", "width", "cell"]
    free(homed)
    load = visits.groupBy(key).agg(F.count("*").alias("n")).select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    asked = visits.join(load, key).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    places = graphs.select(*key, "salt").join(load, key)
    asked = asked.join(places.select(*key, "salt"), key).select(*key, (F.col("salt") + 0).alias("salt"), "block", "id", "code")
    shards = graphs.join(load, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, "salt", "block", "ids", "codes", "graph", "shape")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "sim": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        g, width = left.iloc[0], int(left["width"].iloc[0])
        ids = np.frombuffer(g["ids"], np.int64)
        x = np.frombuffer(g["codes"], np.float16).reshape(-1, width).astype(np.float32)
        graph = Graph.of(x, g["graph"], list(g["shape"]))
        parts = []
        for i in range(0, len(right), 2048):
            part = right.iloc[i : i + 2048]
            who = part["id"].to_numpy(np.int64)
            near, sims = graph.search(_unpacked(part["code"].tolist(), width), k + 1, beam)
            row, col = np.nonzero((near >= 0) & (sims >= least))
            b = ids[near[row, col]]
            other = b != who[row]
            parts.append(pd.DataFrame({"q": who[row][other], "b": b[other], "sim": sims[row, col][other].astype(float)}))
        return pd.concat(parts)

    groups = [*key, "salt", "block"]
    return shards.groupBy(groups).cogroup(asked.groupBy(groups)).applyInPandas(search, "q long, b long, sim double"), [graphs, visits]


def _exact(pairs: DataFrame, vectors: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with cosine, in double precision from the vectors as stored."""
    pick = lambda c, v: vectors.select(F.col("id").alias(c), F.col("vector").alias(v))
    x = lambda v: F.transform(v, lambda e: e.cast("double"))
    dot = lambda u, v: F.aggregate(F.zip_with(x(u), x(v), lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    both = pairs.join(pick(a, "va"), a).join(pick(b, "vb"), b)
    return both.withColumn("cosine", dot("va", "vb") / (F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb")))).drop("va", "vb")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int = PROBES, beam: int = BEAM, cell: int = CELL, flat: int = FLAT) -> DataFrame:
    """(id, rank, neighbour, cosine): the k most similar vectors of each query id, ties to the lower id.

    vectors as of usable(), queries a frame of ids among them; repeated query ids count once. Fewer
    than k others of the model and width give fewer rows. A query visits at least probes cells.
    """
    codes = cut(_prepared(vectors))
    asked = codes.join(queries.select("id").distinct(), "id", "left_semi")
    found, used = candidates(codes, asked, k, probes, cell=cell, beam=beam, measured=True, flat=flat)
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "b")
    some = cut(found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 5).select("q", "b"))
    free(codes, *used)
    exact = _exact(some, vectors, "q", "b")
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "b")
    return exact.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("q").alias("id"), "rank", F.col("b").alias("neighbour"), "cosine")


def similar_pairs(vectors: DataFrame, least: float = 0.9, k: int = 10, probes: int = PAIR_PROBES, cell: int = CELL, beam: int = PAIR_BEAM) -> DataFrame:
    """(a, b, cosine; a < b): pairs of at least the cosine where one is among the k most similar of the other.

    Equal vectors are searched once, as their lowest id, and ties go to the lower id; so a group of
    copies gives at most k pairs a copy, not all pairs, and every copy is linked to others.
    """
    codes = cut(_prepared(vectors))
    copies = codes.groupBy("model", "width", "copy").agg(F.min("id").alias("id"), F.min("code").alias("code"), F.count("*").alias("n"))
    copies = cut(copies)
    reps = copies.select("id", "model", "width", "code")
    found, used = candidates(reps, reps, k, probes, least - SLACK, cell, beam)
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "b")
    near = cut(found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("q", "b", "sim"))
    free(*used)
    # up to k + 1 lowest ids of each group of copies that has several or is in a pair
    touched = near.select(F.col("q").alias("rep")).unionByName(near.select(F.col("b").alias("rep"))).unionByName(copies.filter("n > 1").select(F.col("id").alias("rep"))).distinct()
    member = codes.join(copies.select(F.col("id").alias("rep"), "model", "width", "copy"), ["model", "width", "copy"]).join(touched, "rep", "left_semi").select("rep", "id")
    first = _lowest(member, k + 1)
    own = near.unionByName(touched.select(F.col("rep").alias("q"), F.col("rep").alias("b"), F.lit(2.0).alias("sim")))
    options = own.join(first.withColumnRenamed("rep", "b"), "b").select("q", "sim", F.explode("ids").alias("other"))
    per = options.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "other"))), 1, k + 1).alias("top"))
    pairs = member.withColumnRenamed("rep", "q").join(per, "q").select("id", F.explode(F.slice(F.filter("top", lambda t: t["other"] != F.col("id")), 1, k)).alias("t")).select("id", F.col("t.other").alias("other"))
    pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return _exact(pairs, vectors, "a", "b").filter(F.col("cosine") >= least)


def _lowest(member: DataFrame, k: int) -> DataFrame:
    """(rep, ids): the k lowest ids of each rep, cut down in salted groups before the last merge."""
    low = lambda c: F.slice(F.array_sort(c), 1, k)
    part = member.groupBy("rep", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(low(F.collect_list("id")).alias("ids"))
    return part.groupBy("rep").agg(low(F.flatten(F.collect_list("ids"))).alias("ids"))
