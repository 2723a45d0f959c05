import numpy as np
import pytest

from lamplight.llm import neighbours as nb
from lamplight.llm import scans
from lamplight.llm.boosting import Trees


def test_graph_recall_and_flat_form():
    x = nb.unit(np.random.default_rng(0).normal(size=(3000, 32)))
    g = nb.Graph.build(x)
    flat, shape = g.flat()
    g = nb.Graph.of(x, flat, shape)
    q = x[:300] + 0.05 * np.random.default_rng(1).normal(size=(300, 32)).astype(np.float32)
    near, sims = g.search(q, 10, 48)
    true = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near.tolist(), true.tolist(), strict=True)]) > 0.9
    assert (np.diff(sims, axis=1) <= 1e-6).all() and all(len(set(r)) == 10 for r in near.tolist())
    for n in (1, 2, 5, 30):
        small = nb.Graph.build(x[:n])
        got, _ = small.search(q[:3], 10)
        assert all(set(r) - {-1} == set(range(min(n, 10))) or n > 10 for r in got.tolist())


ROWS = "id long, embedding array<float>, dimensions int, model string, extra int"


def brute(rows, k, least):
    out = set()
    for a in rows:
        s = sorted(((-float(np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1])), b[0]) for b in rows if b[0] != a[0] and b[3] == a[3]))[:k]
        out |= {(min(a[0], i), max(a[0], i)) for c, i in s if -c >= least}
    return out


def test_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(240, 16))
    rows = [(i, (base[i] * rng.uniform(0.1, 9)).tolist(), 16, "m" if i % 5 else "n", 1) for i in range(240)]
    rows += [(300 + i, (base[i] + 0.05 * rng.normal(size=16)).tolist(), 16, rows[i][3], 1) for i in range(60)]
    bad = [(900, None, 16, "m", 1), (901, [0.0] * 16, 16, "m", 1), (902, [float("nan")] * 16, 16, "m", 1), (903, [1.0] * 16, 99, "m", 1), (904, [float("inf")] + [1.0] * 15, 16, "m", 1), (None, [1.0] * 16, 16, "m", 1), (905, [], 0, "m", 1)]
    v = nb.usable(spark.createDataFrame(rows + bad, ROWS))
    assert v.count() == 300
    got = {(r.a, r.b) for r in nb.similar_pairs(v, cell=60).collect()}
    assert got == brute(rows, 10, 0.9) and len(got) >= 55
    near = nb.nearest(v, v.filter("id < 20"), k=3, cell=60).collect()
    assert len(near) == 60 and min(r["rank"] for r in near) == 1
    assert nb.similar_pairs(v.limit(0)).count() == 0


@pytest.mark.parametrize("flat", [256, 16])
def test_recall_holds_where_cells_far_exceed_probes(spark, flat):
    """A fixed number of probes searches a smaller share the more cells there are; in one and two levels of cells."""
    x = np.random.default_rng(6).normal(size=(3000, 12))
    v = nb.usable(spark.createDataFrame([(i, r.tolist(), 12, "m", 1) for i, r in enumerate(x)], ROWS))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[:100] @ u.T
    s[np.arange(100), np.arange(100)] = -2
    true = {(q, int(b)) for q, near in enumerate(np.argsort(-s, axis=1)[:, :10]) for b in near}
    got = {(r.id, r.neighbour) for r in nb.nearest(v, v.filter("id < 100"), cell=20, flat=flat).collect()}
    assert len(got & true) / len(true) > 0.95


def test_cells_in_two_levels_are_those_of_one():
    """Looked at in full, two levels find the nearest centroids; by a few coarse cells, nearly all."""
    rng = np.random.default_rng(2)
    top = nb.unit(rng.normal(size=(60, 16)))
    parts = [nb.unit(t + 0.2 * rng.normal(size=(int(rng.integers(1, 40)), 16))) for t in top]
    cells = nb.Cells(np.concatenate(parts), top, np.cumsum([0, *map(len, parts)]))
    x = nb.unit(rng.normal(size=(300, 16)))
    true = np.argsort(-(x @ cells.fine.T), axis=1)
    assert (cells.nearest(x, len(cells.fine)) == true).mean() > 0.999
    got = cells.nearest(x, 5)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(got.tolist(), true[:, :5].tolist(), strict=True)]) > 0.9
    assert nb.Cells.flat(cells.fine).nearest(x[:0], 5).shape[0] == 0


def test_copies_give_few_pairs(spark):
    """A third of all rows are copies of one vector: linked, but not in all pairs."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist(), 8, None, 1) for i in range(200)] + [(1000 + i, [1.0] * 8, 8, None, 1) for i in range(100)]
    got = [(r.a, r.b) for r in nb.similar_pairs(nb.usable(spark.createDataFrame(rows, ROWS))).collect()]
    own = {p for p in got if p[0] >= 1000}
    assert {x for p in own for x in p} == set(range(1000, 1100)) and len(own) <= 1000


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = Trees().fit(x[:400], y[:400])
    assert ((t.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.93
    assert (Trees().fit(x[:50], np.zeros(50)).predict(x) < 0.1).all()


TEXT = (
    "The outstanding balance of the account does not match the quarterly report of the office. Please check whether the settlement letter was forwarded by the records unit before the monthly deadline. "
    "We could not open the transaction report with the missing number, so it was reviewed again by the compliance desk."
)


@pytest.fixture(scope="module")
def repaired(spark):
    page = lambda head, no, *lines: "\n".join([head, "", *lines, "", f"- {no} -"])
    pages = [
        (1, 1, 0, page("Client File    Kalo Ltd", 3, "The outstanding balance of the account does", "not match the quarter1y report of the of-", "fice. Please check whether the settlemcnt", "letter was forwarded by the rec­")),
        (2, 1, 1, page("C1ient File    Kalo Ltd", 4, "ords unit before the monthly deadline. We –", "could not open the transaction report.", "", "59,958", "3,005.78", "", "It was reviewed again.")),
        (2, 1, 1, page("C1ient File    Kalo Ltd", 4, "ords unit before the monthly deadline. We –", "could not open the transaction report.", "", "59,958", "3,005.78", "", "It was reviewed again.")),
        (3, 2, 0, None), (4, 2, 1, ""), (5, 3, 0, "word " * 30_000),
    ]
    p = spark.createDataFrame(pages, "chunk_id long, file_id long, page int, content string")
    clean = spark.createDataFrame([(TEXT,)] * 8 + [(None,), ("",)], "content string")
    samples = spark.createDataFrame([(i, t) for i, t in enumerate([TEXT] + [f"{x.rstrip(chr(46))}." for x in TEXT.split(". ")] * 5)], "sample_id long, text string")
    return scans.repair(p, clean, samples), p, clean, samples


def test_scanned_pages(repaired):
    found = {(r.chunk_id, r.line_no, r.kind) for r in repaired[0].found().collect()}
    assert {x for x in found if x[2] == "furniture"} == {(1, 1, "furniture"), (1, 8, "furniture"), (2, 1, "furniture"), (2, 11, "furniture")}
    assert {x for x in found if x[2] == "hyphen"} == {(1, 4, "hyphen"), (1, 6, "hyphen")}
    assert {x for x in found if x[2] == "char"} == {(1, 4, "char"), (1, 5, "char")}
    text = {r.chunk_id: r.text for r in repaired[0].paragraphs().collect()}
    assert text[1] == "The outstanding balance of the account does not match the quarterly report of the office. Please check whether the settlement letter was forwarded by the rec"
    assert "59,958" in text[2] and "Client" not in text[2] and text[4] == ""


def test_scans_of_nothing(repaired):
    _, p, clean, samples = repaired
    assert scans.repair(p.limit(0), clean, samples).found().count() == 0


@pytest.mark.parametrize("word", ["pcrfcct", "perfxct"])
def test_candidates_of_damaged_rare_grams_and_unlisted_misreadings(spark, word):
    """The damaged grams are rarer than the one that is left; x for e is in no table."""
    yes = Trees().fit(np.random.default_rng(0).normal(size=(50, 16)), np.ones(50))
    known = ["pcrfalongword", "longxrfccqword", "yacctzlongword", "fact", "pact", "tact", "perfect"]
    known = spark.createDataFrame([(w, 5) for w in known], "word string, n long")
    words = spark.createDataFrame([(1, 1, -1, 0, word)], "chunk_id long, line_no long, next_no long, cut int, word string")
    assert [tuple(r) for r in scans.corrections(words, known, scans.Model(yes, yes, yes)).collect()] == [(word, "perfect")]


def test_misreadings():
    assert scans.misreadings("rep0rt", "report") == 1 and scans.misreadings("tliiis", "thus") == 2 and scans.misreadings("report", "repost") == 0
    assert scans.fold("Gekrun0r Ho1ding") == scans.fold("Gekrunor Holding")


def test_short_words_meet_known_words_within_two_edits(spark):
    """Brute force: no known word within the deletions' distance is missed, though no q-gram is left."""
    import itertools

    from pyspark.sql import functions as F

    known = ["in", "and", "den", "rue", "casa", "hier", "nicht", "mit", "ohne"]
    asked = ["1n", "xnd", "d3n", "rxx", "c4s4", "h1er", "n1cht", "rnit", "0hn3", "zz"]
    k = spark.createDataFrame([(w, 5) for w in known], "word string, n long")
    got = {(r.word, r.cand) for r in scans.candidates(spark.createDataFrame([(w, w, 1) for w in asked], "word string, low string, here long"), k).collect()}
    near = spark.createDataFrame(list(itertools.product(asked, known)), "a string, b string").withColumn("d", F.levenshtein("a", "b"))
    want = {(r.a, r.b) for r in near.filter("d <= 2 and d * 2 <= length(a) + 1").collect()}
    assert want <= got and ("1n", "in") in want and ("rnit", "mit") in want


def test_misreadings_in_no_table_are_corrected(spark):
    """The ranking learned from half of the table corrects misreadings of the other half, and leaves rare right words."""
    import os

    from pyspark.sql import functions as F

    at = "/root/testdata/sf0.01"
    if not os.path.exists(at):
        pytest.skip("no tables")
    known = scans.cut(scans.clean_words(spark.read.parquet(f"{at}/documents.parquet").select(F.col("text").alias("content")), "content"))
    half, other = tuple(scans.MISREAD[::2]), tuple(scans.MISREAD[1::2])
    assert not set(half) & set(other)
    model = scans.learn(spark.read.parquet(f"{at}/lang_samples.parquet"), known, half)
    digits = tuple(x for x in other if any(c in "0123456789|@†" for c in x[1]))
    words, seen = {r.word for r in known.filter("n >= 5 and length(word) >= 5").collect()}, {r.word for r in known.collect()}
    rng, wrong = np.random.default_rng(4), {}
    for w in sorted(words)[:1500]:
        if (hit := scans.damage(w, rng, digits)) and hit not in seen:
            wrong[hit] = w
    rows = spark.createDataFrame([(1, 1, -1, 0, w) for w in wrong], "chunk_id long, line_no long, next_no long, cut int, word string")
    got = {r.word: r.right for r in scans.corrections(rows, known, model).collect()}
    assert len(wrong) > 300 and sum(got.get(w) == t for w, t in wrong.items()) / len(wrong) > 0.8
    assert got.get("\u2020he") != "ahe"
