import sqlite3

import pytest
from pyspark.sql import functions as F

from lamplight.functions import stemming, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x")).first()[0]


def test_words_and_folding(spark):
    assert one(spark, "Straße 12, Đồng-Nai", text.words) == ["straße", "12", "đồng", "nai"]
    assert one(spark, "Đồng e\u0301té 한글", text.fold) == "Dong ete " + "".join(stemming.drop_marks("한글"))
    assert one(spark, None, text.fold) is None
    assert one(spark, "ngan_hang ĐỒNG", text.fts_tokens) == ["ngan_hang", "đong"]
    assert one(spark, None, text.fts_tokens) == []
    assert one(spark, "e\u0301", text.nfc) == "é"


@pytest.mark.parametrize(
    "sample,lang",
    [("", "und"), ("123", "und"), ("Привет мир", "ru"), ("Báo cáo giao dịch đáng ngờ tại ngân hàng", "vi"), ("Das ist nicht der Bericht und die Liste", "de"), ("Straße", "de"), ("plain words", "und"), (None, "und")],
)
def test_language_rules(spark, sample, lang):
    assert one(spark, sample, text.detect_lang) == lang


def test_language_with_dictionary(spark):
    english = F.array(F.lit("plain"), F.lit("words"))
    assert one(spark, "plain words here", lambda c: text.detect_lang(c, english)) == "en"
    assert one(spark, "plain words đồng đồng", lambda c: text.detect_lang(c, english)) == "mixed"


def test_markup_paths_and_globs(spark):
    assert one(spark, "a<b>c</b> d > e <open", text.strip_html) == "a c  d   e "
    assert one(spark, "/srv/share/x.tar.GZ", text.extension) == ".gz"
    assert one(spark, "/srv/.hidden", text.extension) == ""
    assert one(spark, "C:\\a\\b.txt", text.drive) == "C:"
    df = spark.createDataFrame([("C:\\Users\\me\\AppData",), ("C:\\Users\\me\\x\\AppData",), ("/proc",)], "p string")
    got = [r[0] for r in df.select(F.col("p").rlike(text.glob_pattern("?:\\Users\\*\\AppData"))).collect()]
    assert got == [True, False, False]
    assert one(spark, 12345678, lambda c: text.clock(F.col(c).cast("long"))) == "34:17:36"
    assert one(spark, "ä" * 100 + "\nx", text.error_clip) == "ä" * 60


@pytest.mark.parametrize(
    "word,stem",
    [("generously", "generous"), ("consisting", "consist"), ("hopping", "hop"), ("skies", "sky"), ("ties", "tie"), ("cries", "cri"), ("relational", "relat"), ("laundering", "launder"), ("agreed", "agre"), ("happily", "happili"), ("knightly", "knight"), ("bias", "bias"), ("rate", "rate"), ("controlling", "control"), ("national", "nation"), ("news", "news")],
)
def test_stems(word, stem):
    assert stemming.stem(word) == stem


def test_enrichment():
    got = stemming.enriched(["kyc", "ngân", "hàng", "reports"], "und", {"ngân hàng"}, {"kyc": ["know your customer"]})
    assert got == ["kyc", "ngân", "hàng", "reports", "ngan", "hang", "report", "ngân_hàng", "ngan_hang", "know", "your", "customer"]
    assert stemming.enriched([], "en") == []


def test_bm25_equals_sqlite(spark, tmp_path):
    from lamplight.operators import search

    docs = [(1, "a.txt", "d/a.txt", "risk report about risk", "tok"), (2, "b.txt", "d/b.txt", "a deposit ledger", ""), (3, "risk", "e/c.txt", "đồng ngân hàng", "risk"), (4, None, "e/d.txt", None, None)]
    df = spark.createDataFrame(docs, "id long, name string, path string, content string, tokens string")
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE fts USING fts5(name, path, content, tokens, tokenize=\"unicode61 remove_diacritics 2 tokenchars '_'\")")
    con.executemany("INSERT INTO fts(rowid, name, path, content, tokens) VALUES (?, ?, ?, ?, ?)", docs)
    for q in (["ledger"], ["deposit", "report"]):
        true = con.execute("SELECT rowid, bm25(fts) FROM fts WHERE fts MATCH ? ORDER BY 2, 1", (" OR ".join(f'"{t}"' for t in q),)).fetchall()
        got = [(r.id, r.score) for r in search.bm25(df, q).collect()]
        assert [i for i, _ in got] == [i for i, _ in true]
        assert all(abs(a + b) < 1e-9 for (_, a), (_, b) in zip(got, true, strict=True))
    assert search.bm25(df, []).count() == 0
    assert search.search(df, "   ").count() == 0
    index = search.SearchIndex(spark, str(tmp_path / "index"))
    assert not index.exists()
    index.write(df)
    many = index.search([("q", ["risk", "report"])]).orderBy("rank").collect()
    assert [(r.id, round(r.score, 9)) for r in many] == [(r.id, round(r.score, 9)) for r in search.bm25(df, ["report", "risk"]).collect()]
    assert search.search(df, "rsik", fuzzy=True).first().id == 3
    snip = search.search(df, "ngân").first().snippet
    assert snip == "đồng [ngân] hàng"


def test_index_tokens_are_those_of_the_column(spark):
    samples = ["", "Ünïcode_Ötzi 12½ x²", "ngân hàng ĐỒNG e\u0301t", "한글 テスト ﬁne", "\ue000x İstanbul ΣΟΦΟΣ", "a\u200bb\u00ad-c\u0000d", "\U0001f600 👩\u200d👩 नमस्ते"]
    df = spark.createDataFrame([(x,) for x in samples], "x string")
    tokens = text.fts_tokenizer()
    assert [r[0] for r in df.select(text.fts_tokens("x")).collect()] == [tokens(x) for x in samples]


def test_likeness_of_names_equals_duckdb():
    import duckdb
    import numpy as np

    from lamplight.operators.search import jaro_winkler

    rng = np.random.default_rng(1)
    names = ["", "a", "ab", "martha", "marhta", "dixon", "dicksonx", "misty rose part", "x" * 5000, "é" * 3, "a\0b"] + ["".join(rng.choice(list("abcde "), int(rng.integers(0, 14)))) for _ in range(400)]
    for q in ("a", "martha", "misty rose part", "abc de", "dixon"):
        true = [duckdb.execute("SELECT CASE WHEN $1 = '' THEN 0 ELSE jaro_winkler_similarity($2, $1) END", [x, q]).fetchone()[0] for x in names if "\0" not in x]
        got = jaro_winkler(q, [x for x in names if "\0" not in x])
        # the prefix counts at any likeness here, above 0.7 only there
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, true, strict=True) if b > 0.7 or a <= b + 1e-9)
    assert jaro_winkler("", ["", "a"]).tolist() == [1.0, 0.0] and jaro_winkler("a", []).tolist() == []
