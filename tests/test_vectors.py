import numpy as np
import pytest
from pyspark.sql import functions as F

from lamplight.functions import vectors
from lamplight.operators import vector_search as vs


def lcg(seed, n):
    out, x = np.empty(n), seed
    for i in range(n):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        out[i] = (x >> 8) / (1 << 23) - 0.5
    return out


@pytest.fixture(scope="module")
def clustered(spark):
    """40 clusters of 25 vectors of 384 elements around a common hub."""
    raw = lcg(20_260_726, 384 * (1 + 40 + 1000)).reshape(-1, 384)
    hub, topic, jitter = raw[0], raw[1:41], raw[41:]
    x = hub * 2.0 + np.repeat(topic, 25, axis=0) + 0.15 * jitter
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").cache()
    return x, df


def sequential(a, b):
    def dot(p, q):
        s = np.float32(0)
        for x, y in zip(p, q, strict=True):
            s = np.float32(s + np.float32(x * y))
        return s

    return np.float32(dot(a, b) / np.float32(np.float32(np.sqrt(dot(a, a))) * np.float32(np.sqrt(dot(b, b)))))


def test_exact_search_is_bit_exact(clustered):
    x, df = clustered
    hits = vs.exact_search(df, x[7].tolist(), 5).collect()
    true = sorted(((-sequential(v, x[7]), i) for i, v in enumerate(x)))[:5]
    assert [(r.id, np.float32(r.score)) for r in hits] == [(i, np.float32(-s)) for s, i in true]


def test_quantised_recall(clustered):
    x, df = clustered
    middle = vs.centre_vector(df)
    found = {"int8": [], "bit": []}
    index = {t: vs.packed_codes(df, t, middle).cache() for t in found}
    for q in (3, 260, 511, 777):
        true = set(np.argsort(-(x @ x[q]), kind="stable")[:10].tolist())
        for tier in found:
            got = {r.id for r in vs.fast_search(df, index[tier], x[q].tolist(), 10, tier, middle).collect()}
            found[tier].append(len(got & true) / 10)
    assert np.mean(found["int8"]) >= 0.95 and np.mean(found["bit"]) >= 0.5


def test_planted_winners_and_ties(spark):
    rows = [(i, [0.0, 1.0, 0.0]) for i in range(1, 3000)]
    for i, s in ((1, 0.6), (1500, 1.0), (1501, 0.3), (2800, 1.0), (2900, 0.8)):
        rows[i - 1] = (i, [s, (1 - s * s) ** 0.5, 0.0])
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    assert [r.id for r in vs.exact_search(df, [1.0, 0.0, 0.0], 4).collect()] == [1500, 2800, 2900, 1]


def test_degenerate_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [1.0, 1.0]), (4, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {r.id: r.score for r in vs.exact_search(df, [1.0, 1.0], 4).collect()}
    assert got[1] == got[2] == got[4] == -1.0 and got[3] == pytest.approx(1.0)
    codes = {r.id: r.code for r in vs.codes(df, "int8").collect()}
    assert codes[1] == [0, 0] and codes[2] == [0, 127] and codes[4] == [0, 0]
    bits = {r.id: r.code for r in vs.codes(df, "bit", [0.5, 0.5]).collect()}
    assert bits[3] == [3] and bits[2] == [2]
    assert spark.createDataFrame([(2.5,), (-2.5,)], "x float").select(F.round("x")).collect()[0][0] == 3.0


def test_index_freshness(spark, tmp_path):
    rows = [(i, 1, i, "m", [float(i), 1.0]) for i in range(1, 20)]
    chunks = spark.createDataFrame(rows, "id long, file_id long, chunk_index int, model string, embedding array<float>")
    index = vs.VectorIndex(spark, f"file://{tmp_path}/v")
    assert index.search(chunks, [1.0, 0.0], 3, "m")[1]["path"] == "scan"
    index.build(chunks, "m", 2, "int8", "job1")
    hits, how = index.search(chunks, [1.0, 0.0], 3, "m", "job1")
    assert how["path"] == "int8" and [r.id for r in hits.collect()] == [19, 18, 17]
    for args, word in ((("x", "job1"), "model"), (("m", "job2"), "later run")):
        assert word in index.search(chunks, [1.0, 0.0], 3, *args)[1]["note"]
    assert "chunks" in index.search(chunks.filter("id > 1"), [1.0, 0.0], 3, "m", "job1")[1]["note"]
    index.drop()
    assert index.state() is None
    assert vs.IndexState.from_json("{broken") is None


def test_hashes_and_quality():
    y, x = np.mgrid[0:128, 0:128]
    k = np.arange(1, 9)
    wave = lcg(3, 64).reshape(8, 8)
    picture = 128 + 60 * np.cos(np.pi * (np.arange(128) + 0.5)[:, None] * k[None] / 128) @ wave @ np.cos(np.pi * (np.arange(128) + 0.5)[:, None] * k[None] / 128).T
    half = picture.reshape(64, 2, 64, 2).mean(axis=(1, 3))
    a, b = vectors.perceptual_hash(picture), vectors.perceptual_hash(half)
    assert len(a) == 16 and bin(int(a, 16) ^ int(b, 16)).count("1") <= 3
    flat, board = vectors.quality(np.full((32, 32), 10)), vectors.quality((x // 8 + y // 8) % 2 * 255)
    assert flat["blurred"] and flat["underexposed"] and not board["blurred"]
    boxes = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [30, 30, 5, 5]], float)
    assert vectors.suppress(boxes, np.array([0.9, 0.95, 0.5])) == [1, 2]


def test_phash_columns(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "0000000000000000"), ("xyz", "0000000000000000"), (None, "00")], "a string, b string")
    assert [r[0] for r in df.select(vectors.phash_distance(F.col("a"), F.col("b"))).collect()] == [64, None, None]


def test_packed_codes_are_those_of_the_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=70).astype(np.float32).tolist()) for i in range(50)]
    rows += [(90, [0.0] * 70), (91, [float("nan")] * 2 + [1.0] * 68), (92, [float("inf")] + [-2.0] * 69), (93, [0.5, 1.5, -2.5, 127.0] + [0.0] * 66)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    middle = [0.1] * 70
    mine = {t: {r.id: bytes(r.code) for r in vs.packed_codes(df, t, middle).collect()} for t in ("int8", "bit", "float")}
    for r in vs.codes(df, "int8").collect():
        assert np.frombuffer(mine["int8"][r.id], np.int8).tolist() == r.code
    for r in vs.codes(df, "bit", middle).collect():
        words = np.frombuffer(mine["bit"][r.id].ljust(12, b"\0"), "<u4").astype(int).tolist()
        assert words == r.code
    assert {k: len(next(iter(v.values()))) for k, v in mine.items()} == {"int8": 70, "bit": 9, "float": 280}
    assert vs.packed_codes(df.limit(0), "int8").count() == 0


def test_index_slots_and_upkeep(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 16))
    df = spark.createDataFrame([(i, "m", v.tolist()) for i, v in enumerate(x)], "id long, model string, embedding array<float>")
    first = df.filter("id < 40")
    index = vs.VectorIndex(spark, f"file://{tmp_path}/v")
    index.build(first, "m", 16, "float", "j")
    index.build(first, "m", 16, "bit", "j")
    q = x[5].tolist()
    true = [r.id for r in vs.exact_search(first, q, 5).collect()]
    for exact, path in ((True, "float"), (False, "bit")):
        hits, how = index.search(first, q, 5, "m", "j", exact)
        assert how["path"] == path and how["exact"] == exact and (not exact or [r.id for r in hits.collect()] == true)
    later = df.filter("id >= 10 and id != 20")
    assert "chunks" in index.search(later, q, 5, "m", "j")[1]["note"]
    assert index.follow(later, "k") == {"float": (20, 11), "quantised": (20, 11)}
    hits, how = index.search(later, q, 5, "m", "k", exact=True)
    assert how["path"] == "float" and [r.id for r in hits.collect()] == [r.id for r in vs.exact_search(later, q, 5).collect()]
    assert index.describe()["quantised"]["vectors"] == 49 and index.follow(later, "k") == {"float": (0, 0), "quantised": (0, 0)}
    index.drop("quantised")
    assert index.state() is None and index.search(later, q, 5, "m", "k")[1]["path"] == "float"
    assert [tuple(r) for r in vs.corpus_dimensions(later).collect()] == [("m", 16, 49)]


def test_near_hashes_equal_brute_force(spark):
    from lamplight.operators import vision

    rng = np.random.default_rng(6)
    base = [int(v) for v in rng.integers(0, 1 << 63, 40)]
    values = base + [b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base] + [b ^ 0b1111 for b in base[:9]] + base[:5] + [0, (1 << 64) - 1, (1 << 64) - 8]
    rows = [(i, f"{v:016x}") for i, v in enumerate(values)] + [(900, None), (901, "zz")]
    got = {(r.id_a, r.id_b, r.distance) for r in vision.near_hashes(spark.createDataFrame(rows, "id long, phash string")).collect()}
    first: dict[int, int] = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = {(min(a, b), max(a, b), bin(u ^ v).count("1")) for u, a in first.items() for v, b in first.items() if a < b and bin(u ^ v).count("1") <= 3}
    assert got == want | {(first[v], i, 0) for i, v in enumerate(values) if first[v] != i}
