import datetime as dt

from lamplight.functions.sql import register
from lamplight.operators import vision
from lamplight.streaming import operators as streams


def test_windows_over_a_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    spark.createDataFrame([(at(0), "a"), (at(1), "a"), (at(61), "a"), (at(200), "b")], "ts timestamp, k string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = streams.tumbling(stream, "ts", "1 hour", ["k"], late="10 minutes").writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n) for r in spark.table("tumbled").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert streams.sessions(batch, "ts", "30 minutes", ["k"]).count() == 3


def test_ingest_in_batches(spark, tmp_path):
    rows = [(f"/d/{i}", f"{i}", ".txt", "/d", "/d", i, 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "path string, name string, ext string, dir string, drive string, size long, mtime double")
    df.repartition(3).write.parquet(str(tmp_path / "land"))
    out = str(tmp_path / "out")
    handle = lambda d, k: d.write.mode("overwrite").parquet(f"{out}/batch={k}")
    for _ in range(2):  # the second finds nothing new
        streams.ingest(spark, str(tmp_path / "land"), str(tmp_path / "cp"), handle, 1).awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT fold('Đồng') a, stem_en('reports') b, cosine(array(1f, 0f), array(1f, 0f)) c, jaro_winkler('martha', 'marhta') d, enrich('KYC reports', 'en') e").first()
    assert (r.a, r.b, r.c, round(r.d, 4)) == ("Dong", "report", 1.0, 0.9611) and r.e == ["kyc", "reports", "report"]


def test_vision_aggregates(spark):
    t = spark.createDataFrame([("v", "cat", 0.5), ("v", "cat", 0.9), ("v", "dog", 0.7)], "v string, tag string, s double")
    assert [(r.tag, r.score) for r in vision.tags_per_video(t, "v", "tag", "s", 1).collect()] == [("cat", 0.9)]
    e = spark.createDataFrame([("g", [1.0, 0.0]), ("g", [0.0, 1.0]), ("g", [1.0]), ("h", None)], "g string, e array<float>")
    assert sorted((r.g, r.dim, r.mean) for r in vision.mean_pool(e, "g", "e").collect()) == [("g", 0, 0.5), ("g", 1, 0.5)]
    h = spark.createDataFrame([(1, "00ff00ff00ff00ff"), (2, "00ff00ff00ff00fe"), (3, "ffffffffffffffff"), (4, "00ff00ff00ff00ff"), (5, "bad"), (6, None)], "id long, phash string")
    assert sorted(tuple(r) for r in vision.near_hashes(h).collect()) == [(1, 2, 1), (1, 4, 0)]
    i = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "id long, e array<float>")
    assert [(r.id, r.tag) for r in vision.score_tags(i, [("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "id", "e").collect()] == [(1, "x")]
