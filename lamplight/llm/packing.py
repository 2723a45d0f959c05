"""Filling containers of fixed capacity by multiway differencing.

Documents spread over shards by a hash of their id; a shard holds about ITEMS_PER_SHARD
items whatever the corpus size, so no task grows with the corpus. Within a shard
Karmarkar-Karp differencing merges partial partitions, the largest window of one with the
smallest of the other, until one partition of near-equal windows is left. Windows that then
exceed the capacity exchange items with emptier ones. The number of windows starts at the
least possible one and rises until none exceeds the capacity.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.session import cut

CAPACITY = 2048
#: Items a shard holds on average: more fill windows a little better, fewer cost less.
ITEMS_PER_SHARD = 512


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0..k-1) of each size, by largest differencing over k windows."""
    n = len(sizes)
    window = np.zeros(n, dtype=np.int64)
    if k <= 1 or n == 0:
        return window
    left, right = np.full(2 * n * 2, -1, np.int64), np.full(2 * n * 2, -1, np.int64)
    made = n  # nodes below n are items
    # A partial partition keeps only its windows that hold anything, by falling sum.
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, sa, na = heapq.heappop(heap)
        _, _, sb, nb = heapq.heappop(heap)
        if len(sa) < len(sb):
            sa, na, sb, nb = sb, nb, sa, na
        both = max(0, len(sa) + len(sb) - k)  # windows of a that must take one of b: its smallest get b's largest
        sums, nodes = sa.copy(), na.copy()
        if both:
            sums[len(sa) - both :] += sb[:both]
            new = np.arange(made, made + both)
            left[new], right[new] = na[len(sa) - both :], nb[:both]
            nodes[len(sa) - both :] = new
            made += both
        if both < len(sb):
            sums, nodes = np.concatenate([sums, sb[both:]]), np.concatenate([nodes, nb[both:]])
        by = np.argsort(-sums, kind="stable")
        sums, nodes = sums[by], nodes[by]
        least = int(sums[-1]) if len(sums) == k else 0
        if made + k > len(left):
            left, right = np.concatenate([left, np.full(len(left), -1)]), np.concatenate([right, np.full(len(right), -1)])
        heapq.heappush(heap, (-(int(sums[0]) - least), order, sums, nodes))
        order += 1
    top = np.full(made, -1, np.int64)
    nodes = heap[0][3]
    top[nodes] = np.arange(len(nodes))
    for node in range(made - 1, n - 1, -1):  # a node is younger than its children
        top[left[node]] = top[right[node]] = top[node]
    return top[:n]


def relieve(sizes: np.ndarray, own: np.ndarray, k: int, capacity: int) -> np.ndarray | None:
    """Exchange items between a window above the capacity and others until none is; None if stuck.

    Each step takes the fullest window and makes the move or exchange that lowers it most without
    putting the other window above the capacity.
    """
    own, load = own.copy(), np.bincount(own, sizes, k).astype(np.int64)
    for _ in range(len(sizes)):
        w = int(load.argmax())
        if load[w] <= capacity:
            return own
        mine, rest = np.flatnonzero(own == w), np.flatnonzero(own != w)
        room = capacity - load
        shift = sizes[mine][:, None] - np.concatenate([sizes[rest], np.zeros(k, np.int64)])[None, :]
        to = np.concatenate([own[rest], np.arange(k)])
        fits = (shift > 0) & (shift <= room[to][None, :]) & (to != w)[None, :]
        if not fits.any():
            return None
        enough = fits & (shift >= load[w] - capacity)
        score = np.where(enough, -shift, -(1 << 40)) if enough.any() else np.where(fits, shift, -1)
        i, j = np.unravel_index(int(score.argmax()), score.shape)
        d, v = int(shift[i, j]), int(to[j])
        own[mine[i]] = v
        if j < len(rest):
            own[rest[j]] = w
        load[w] -= d
        load[v] += d
    return None


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size (all within the capacity), in as few windows as differencing finds."""
    if len(sizes) == 0:
        return np.zeros(0, np.int64)
    k = max(int(-(-int(sizes.sum()) // capacity)), int((sizes * 2 > capacity).sum()))
    while True:
        own = relieve(sizes, difference(sizes, k), k, capacity)
        if own is not None:
            return own
        k += max(1, k // 200)


def pack(df: DataFrame, key: str, size: str, capacity: int = CAPACITY, items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """One row per piece: key, piece, container, place, size.

    Rows of null key or of null, zero or negative size stay out. An item above the capacity
    is cut into full pieces, each alone in its container, and a rest that is packed like any
    item; nothing else is cut. Repeated keys are packed as items of their own. piece counts
    from 0 within the item, place from 0 within the container.
    """
    items = cut(df.filter((F.col(size) > 0) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(size).cast("long").alias("size")))
    shards = max(1, round(items.count() / items_per_shard))
    # a key of more rows than a shard holds spreads over as many shards as its rows fill
    hot = items.groupBy("key").agg(F.ceil(F.count("*") / items_per_shard).alias("parts")).filter("parts > 1")
    spot = F.lit(0)
    if hot.take(1):
        items = items.join(hot, "key", "left")
        spot = F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1)))
    placed = items.withColumn("shard", F.pmod(F.xxhash64("key", spot), F.lit(shards))).select("key", "size", "shard")
    placed = cut(placed) if hot.take(1) else placed

    def fill(shard: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        keys, sizes = pdf["key"].to_numpy(), pdf["size"].to_numpy()
        full, rest = sizes // capacity, sizes % capacity
        who = np.repeat(np.arange(len(keys)), full)
        piece = np.arange(len(who)) - np.repeat(np.cumsum(full) - full, full)
        some = np.flatnonzero(rest)
        own = windows(rest[some], capacity)
        _, own = np.unique(own, return_inverse=True)
        out = pd.DataFrame({
            "key": np.concatenate([keys[who], keys[some]]),
            "piece": np.concatenate([piece, full[some]]).astype(np.int32),
            "container": np.concatenate([np.arange(len(who)), len(who) + own]),
            "size": np.concatenate([np.full(len(who), capacity), rest[some]]).astype(np.int32),
        })
        out["place"] = out.groupby("container").cumcount().astype(np.int32)
        out["container"] += int(shard[0]) << 32
        return out[["key", "piece", "container", "place", "size"]]

    # a stated number of partitions is not coalesced: the shards keep all cores busy
    return (
        placed.repartition(min(shards, 4 * df.sparkSession.sparkContext.defaultParallelism), "shard")
        .groupBy("shard")
        .applyInPandas(fill, "key long, piece int, container long, place int, size int")
        .withColumnRenamed("key", key)
    )
