import pytest

from lamplight.operators import incremental, resume
from lamplight.operators.jobs import JobQueue, QueueFull, keep_newest, sweep_interrupted

SEEN = "path string, seen_at double, sha1 string, size long, mtime double, job_id string"
FILES = "id long, path string, indexed_at double, sha1 string, size long, mtime double"


def listing(spark, rows):
    return spark.createDataFrame(rows, SEEN)


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def changed(spark, seen, stored):
    got = incremental.new_or_changed(listing(spark, seen), incremental.stored_last(files(spark, stored)))
    return sorted(r.path for r in got.collect())


def test_each_clause(spark):
    stored = [
        (1, "same", 5.0, "a", 1, 10.0), (2, "content", 5.0, "a", 1, 10.0), (3, "nosha-same", 5.0, None, 1, 10.2), (4, "nosha-size", 5.0, "a", 1, 10.0), (5, "nosha-second", 5.0, "a", 1, 10.9),
        (6, "unfinished", None, "a", 1, 10.0), (7, "twice", 5.0, "a", 1, 10.0), (8, "twice", 6.0, "b", 1, 10.0), (9, "back", 5.0, "a", 1, 10.0), (10, "touched", 5.0, "a", 1, 10.0),
    ]
    seen = [
        ("same", 1.0, "a", 1, 10.0, "j"), ("content", 1.0, "b", 1, 10.0, "j"), ("nosha-same", 1.0, "x", 1, 10.9, "j"), ("nosha-size", 1.0, None, 2, 10.0, "j"), ("nosha-second", 1.0, None, 1, 11.0, "j"),
        ("unfinished", 1.0, "a", 1, 10.0, "j"), ("twice", 1.0, "a", 1, 10.0, "j"), ("back", 1.0, "b", 1, 10.0, "j"), ("back", 2.0, "a", 1, 10.0, "j"), ("touched", 1.0, "a", 9, 99.0, "j"), ("new", 1.0, None, None, None, None),
        (None, 1.0, "a", 1, 10.0, "j"),
    ]
    assert changed(spark, seen + seen, stored) == ["content", "new", "nosha-second", "nosha-size", "twice", "unfinished"]


def test_empty_tables(spark):
    assert changed(spark, [], []) == []
    assert changed(spark, [("a", None, None, None, None, None)], []) == ["a"]


def test_exactly_once_over_failures(spark, tmp_path):
    store = incremental.IncrementalStore(spark, f"file://{tmp_path}")
    seen = listing(spark, [(f"p{i}", 1.0, str(i), i, 1.0, "j") for i in range(20)])

    def fail(df):
        return df.selectExpr("raise_error(path) AS path")

    with pytest.raises(Exception):  # noqa: B017
        store.run(seen, fail)
    assert store.committed() == [] and store.output() is None
    assert store.run(seen, lambda df: df.select("path", "sha1"))
    assert store.run(seen, lambda df: df.select("path", "sha1")) is None
    more = seen.unionByName(listing(spark, [("p3", 2.0, "new", 3, 2.0, "k"), ("q", 2.0, None, 1, 2.0, "k")]))
    assert store.run(more, lambda df: df.select("path", "sha1"))
    assert store.run(more, lambda df: df.select("path", "sha1")) is None
    rows = store.output().collect()
    assert len(rows) == 22 and sum(r.path == "p3" for r in rows) == 2


def test_folded_manifests_and_a_race(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "FOLD", 3)
    store = incremental.IncrementalStore(spark, f"file://{tmp_path}")
    copy = lambda df: df.select("path", "sha1")
    seen = None
    for k in range(7):
        now = listing(spark, [(f"p{k}", float(k), "x", 1, 1.0, "j"), ("same", float(k), str(k), 1, 1.0, "j")])
        seen = now if seen is None else seen.unionByName(now)
        assert store.run(seen, copy).endswith(f"-{k + 1}") and store.run(seen, copy) is None
    assert store._numbers("folded") == [3, 6] and store.manifest().count() == 8 and store.output().count() == 14
    # a run that another one overtakes fails to commit, and its members are taken by the next
    more = seen.unionByName(listing(spark, [("late", 9.0, "x", 1, 1.0, "j")]))

    def overtaken(df):
        assert incremental.IncrementalStore(spark, store.root).run(seen.unionByName(listing(spark, [("other", 9.0, "x", 1, 1.0, "j")])), copy)
        return copy(df)

    with pytest.raises(Exception):  # noqa: B017
        store.run(more, overtaken)
    assert "late" not in {r.path for r in store.output().collect()} and store.run(more, copy) and store.run(more, copy) is None
    assert sorted(r.path for r in store.output().filter("path in ('late', 'other')").collect()) == ["late", "other"]


@pytest.mark.parametrize(
    "old,expect",
    [
        (None, "new"), (("text", 0, "x", True, 5, 10.0), "skip"), (("text", 0, None, True, 5, 10.0), "hash-only"), (("text", 0, "x", True, 6, 10.0), "process"), (("text", 0, "x", True, 5, 11.0), "process"), (("text", 0, "x", False, 5, 10.0), "process"),
        (("error:decode", 2, "x", False, 5, 10.0), "process"), (("error:decode", 3, "x", False, 5, 10.0), "capped"), (("docx-partial", 1, "x", True, 5, 10.0), "process"), (("excluded:unsupported", 0, "x", False, 5, 10.7), "skip"), (("name-only", 9, "x", False, 5, 10.0), "capped"),
    ],
)
def test_resume_decision(spark, old, expect):
    walked = spark.createDataFrame([("p", 5, 10.5)], "path string, size long, mtime double")
    schema = "path string, method string, attempts long, sha1 string, has_chunks boolean, size long, mtime double"
    existing = spark.createDataFrame([("p", *old)] if old else [], schema)
    assert resume.decide(walked, existing).first().decision == expect


def test_prune_is_scoped(spark):
    f = spark.createDataFrame([("/r/docs/keep",), ("/r/docs/gone",), ("/r/docs2/other",), ("/r/photos/x",)], "path string")
    w = spark.createDataFrame([("/r/docs/keep",)], "path string")
    assert [r.path for r in resume.missing(f, w, ["/r/docs/"]).collect()] == ["/r/docs/gone"]
    assert resume.missing(f, w.limit(0), ["/r/docs"]).count() == 0


def test_jobs(spark):
    q = JobQueue(lambda r: {"n": 1 / r["x"]}, limit=2)
    a, b = q.submit({"x": 1}), q.submit({"x": 0})
    with pytest.raises(QueueFull):
        q.submit({"x": 1})
    assert q.step() == a and q.records[a]["status"] == "complete"
    assert q.step() == b and q.records[b]["status"] == "error"
    c = q.submit({"x": 1})
    assert q.cancel(c) and not q.cancel(c) and q.step() is None
    t = q.table(spark)
    assert keep_newest(t, 2).count() == 2
    open_ = spark.createDataFrame([("a", "running", "{}", 1.0), ("b", "complete", "{}", 1.0)], t.schema)
    assert {r.id: r.status for r in sweep_interrupted(open_).collect()} == {"a": "error", "b": "complete"}
