import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from lamplight.operators import chunking, search
from lamplight.operators.corpus import Corpus
from lamplight.operators.embedding import HashingEmbedder
from lamplight.plans.indexer import index, processed, reports
from lamplight.settings import InvalidSetting, Runtime, Settings, merged
from lamplight.sources import extract, lexicons


def put(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return path


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<d xmlns:w="u"><w:t>{text}</w:t><w:x>no</w:x></d>')
    return out.getvalue()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    put(root, "docs/report_en.txt", "Anti money laundering compliance report. Suspicious activity detected.")
    put(root, "docs/bao_cao_vi.txt", "Báo cáo giao dịch đáng ngờ tại ngân hàng. Khách hàng rủi ro cao.")
    put(root, "docs/sub/notes.md", "KYC and CDD notes for bank review.")
    put(root, "docs/a.docx", docx("Contract of the bank"))
    put(root, "docs/bad.docx", "garbage")
    put(root, ".git/x.txt", "left out")
    put(root, "photos/outside.txt", "outside of the scope")
    put(root, "x.dll", "left out")
    return root


def test_index_resume_and_prune(spark, tree, tmp_path):
    out = str(tmp_path / "corpus")
    s = Settings(commit_batch=3)
    n = index(spark, [tree], out, settings=s)
    assert (n.discovered, n.files, n.errors, n.removed) == (6, 6, 1, 0)
    c = Corpus(spark, out)
    files = {r.name: r for r in c.table("files").collect()}
    assert files["bad.docx"].method == "error:decode" and files["bad.docx"].attempts == 1
    assert files["bao_cao_vi.txt"].lang == "vi" and files["a.docx"].method == "docx"
    ids = {k: r.id for k, r in files.items()}
    assert sorted(ids.values()) == [1, 2, 3, 4, 5, 6]
    for query in ("launder", "ngan hang", "know your customer bank", "zzz", " "):
        want = [(r.id, round(r.score, 9), r.snippet) for r in search.search(c.searchable(), query).collect()]
        assert [(r.id, round(r.score, 9), r.snippet) for r in c.search(query).collect()] == want
    assert c.search("launder").first().id == ids["report_en.txt"]
    assert c.search("ngan hang").first().id == ids["bao_cao_vi.txt"]
    assert c.search("raport_en.txt", fuzzy=True).first().id == ids["report_en.txt"]
    assert [tuple(r) for r in c.top_folders("bank").collect()] == [tuple(r) for r in search.top_folders(c.searchable(), ["bank"]).collect()]
    assert c.text(ids["a.docx"]) == "Contract of the bank" and c.text(999) is None
    # the broken file is tried again, three times in all
    for attempts in (2, 3, 3):
        n = index(spark, [tree], out, settings=s)
        assert c.table("files").filter("name = 'bad.docx'").first().attempts == attempts
    assert n.capped == 1 and n.files == 0
    # a scoped run prunes only below its root, and a changed file is taken again under its id
    os.remove(os.path.join(tree, "docs/sub/notes.md"))
    put(tree, "docs/report_en.txt", "Another text about deposit ledgers.")
    os.remove(os.path.join(tree, "photos/outside.txt"))
    n = index(spark, [os.path.join(tree, "docs")], out, settings=s)
    assert (n.removed, n.files) == (1, 1)
    now = {r.name: r.id for r in c.table("files").collect()}
    assert now["report_en.txt"] == ids["report_en.txt"] and "outside.txt" in now and "notes.md" not in now
    assert c.search("laundering").count() == 0 and c.search("deposit").first().id == now["report_en.txt"]
    for query in ("deposit", "bank", "outside"):
        assert [tuple(r) for r in c.search(query).collect()] == [tuple(r) for r in search.search(c.searchable(), query).collect()]
    # a changed file that fails keeps nothing old; an unchanged one that fails keeps its row
    other = index(spark, [os.path.join(tree, "docs")], out, HashingEmbedder(32), s)
    assert other.files >= 3 and {r.model for r in c.table("chunks").filter("file_id != %d" % now["outside.txt"]).collect()} == {"hashing-32"}
    r = reports(c, str(tmp_path / "reports"), "mirror")
    assert r["files"] == 5 and r["sidecars"] == 1 and os.path.exists(tmp_path / "reports/analysis.md")


def test_cancel_keeps_committed_batches(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(8):
        put(root, f"f{i}.txt", f"text {i}")
    calls = iter([False, True])
    n = index(spark, [root], str(tmp_path / "c"), settings=Settings(commit_batch=4), cancelled=lambda: next(calls, True))
    assert n.cancelled and 0 < Corpus(spark, str(tmp_path / "c")).table("files").count() < 8


def test_carry_forward_of_vision(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"))
    base = "path string, drive string, dir string, name string, ext string, size long, mtime double, lang string, method string, ocr_used int, pages long, sha1 string, elapsed_ms long, content string, tokens array<string>, chunks array<struct<chunk_index:int,content:string,embedding:array<float>,model:string,page_start:int,page_end:int>>"
    row = lambda p, size: (p, "/", "/", p, ".png", size, 1.0, "en", "ocr", 1, 1, None, 5, "seen", ["seen"], [(0, "seen", [1.0, 0.0], "m", None, None)])
    seen = F.struct(F.lit("a cat").alias("caption"), F.lit("00ff00ff00ff00ff").alias("phash"))
    c.upsert(spark.createDataFrame([row("a", 1), row("b", 1)], base).withColumn("vision", seen), 1.0)
    assert c.table("vision").count() == 2
    c.upsert(spark.createDataFrame([row("a", 1), row("b", 2)], base), 2.0)
    ids = {r.path: r.id for r in c.table("files").collect()}
    assert [r.file_id for r in c.table("vision").collect()] == [ids["a"]]
    assert c.table("chunks").count() == 2 and c.table("chunks").select("id").distinct().count() == 2


def test_newer_corpus_is_refused(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"))
    c.set_meta(schema_version="99")
    with pytest.raises(ValueError, match="schema version 99"):
        Corpus(spark, str(tmp_path / "c"))


def test_extractors(tmp_path):
    s = Settings()
    mail = b"Subject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\nFrom: a@b.example\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/plain\n\nbody\n--x\nContent-Type: text/html\n\n<p>html</p>\n--x\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=\"y.pdf\"\n\nzz\n--x--\n"
    got = extract.extract_bytes(mail, "m.eml", s).text
    assert got.startswith("Subject: Grüße\nFrom: a@b.example") and "body" in got and " html " in got and "[attachment: y.pdf]" in got
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in/a.txt", "inner")
        f.writestr("../evil.txt", "evil")
        f.writestr("bad.docx", "broken")
    a = extract.extract_bytes(z.getvalue(), "z.zip", s)
    assert a.text == "[archive entry: in/a.txt]\ninner" and a.method == "archive-partial"
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("b.txt")
        info.size = 2
        f.addfile(info, io.BytesIO(b"hi"))
    assert extract.extract_bytes(t.getvalue(), "t.tgz", s).text == "[archive entry: b.txt]\nhi"
    nested = z.getvalue()
    for _ in range(5):
        o = io.BytesIO()
        with zipfile.ZipFile(o, "w") as f:
            f.writestr("n.zip", nested)
        nested = o.getvalue()
    assert "inner" not in extract.extract_bytes(nested, "n.zip", s).text
    assert extract.extract_bytes(b"x", "~$a.docx", s).method == "excluded:office-lock"
    assert extract.extract_bytes(b"x", "a.unknown", s).method == "excluded:unsupported"
    assert extract.finish(extract.extract_bytes(b" ", "a.txt", s)).method == "text-partial"
    assert extract.extract_bytes("é".encode("cp1252"), "a.txt", s).text == "é"
    assert extract.page_segments("a\f \fccc", 3) == [(1, "a"), (3, "cc")]
    assert extract.needs_ocr("auto", 19, 1) and not extract.needs_ocr("auto", 20, 1) and extract.needs_ocr("on", 99, 1)
    p = tmp_path / "abbr.txt"
    p.write_text("# c\nKYC = know your customer; x\nkyc\tsecond, x\n")
    assert lexicons.abbreviations(p, tmp_path / "none") == {"kyc": ["know your customer", "x", "second"]}
    for e, name in ((FileNotFoundError(), "io-not-found"), (PermissionError(), "io-denied"), (TimeoutError(), "timeout"), (extract.Encrypted(), "encrypted"), (zipfile.BadZipFile(), "decode"), (extract.Unsupported(), "unsupported"), (RuntimeError(), "unknown")):
        assert extract.failure(e) == name


@pytest.mark.parametrize("n,starts", [(0, []), (1, [0]), (1199, [0]), (1200, [0]), (1201, [0, 1000]), (2200, [0, 1000]), (2201, [0, 1000, 2000])])
def test_window_boundaries(spark, n, starts):
    df = spark.createDataFrame([(1, "😀" * n)], "k long, t string")
    rows = chunking.windows(df, "k", "t").orderBy("start").collect()
    assert [r.start for r in rows] == starts and [r.chunk_index for r in rows] == list(range(len(starts)))
    assert all(len(r.content) <= 1200 for r in rows) and sum(len(r.content) for r in rows) - 200 * max(0, len(rows) - 1) == n


def test_pages_of_windows(spark):
    text = "alpha " * 350 + "\f \f" + "bravo " * 350
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, t string")
    rows = chunking.paged_windows(df, "k", "t").orderBy("start").collect()
    assert (rows[0].page_start, rows[-1].page_end) == (1, 3) and any(r.page_start < r.page_end for r in rows)
    assert {r.k for r in rows} == {1}


def test_settings():
    assert merged({"workers": 4, "ocr": "off"}, {"workers": 9}).workers == 9
    for bad in ({"nope": 1}, {"workers": 65}, {"ocr": "maybe"}, {"workers": "8"}, {"workers": True}, {"skip_dirs": "x"}):
        with pytest.raises(InvalidSetting):
            merged(bad)
    r = Runtime()
    with pytest.raises(InvalidSetting):
        r.apply({"extract": 4, "embed": "x"})
    assert r.stages["extract"] == 8 and r.apply({"extract": 400})["extract"] == 64
    assert Settings(headroom=50).cores(8) == 4

@pytest.mark.parametrize("size", [10, 60_000])
def test_index_knows_dictionaries_of_any_size(spark, tmp_path, size):
    """Ending a word list at some size turned English files into und."""
    (tmp_path / "lex/dict").mkdir(parents=True)
    (tmp_path / "lex/dict/en_US.dic").write_text("\n".join([str(size), "plain/S", "words", "reports", *(f"filler{k}" for k in range(size))]))
    (tmp_path / "lex/dict/vi_VN.dic").write_text("\n".join(["ngan", "hang", "bao", "cao", *(f"vfiller{k}" for k in range(size))]))
    (tmp_path / "in").mkdir()
    for name, x in {"en": "plain words reports", "mixed": "plain words ngan hang", "vi": "bao cao ngan hang", "und": "zzz qqq xxx"}.items():
        (tmp_path / f"in/{name}.txt").write_text(x)
    s = Settings(lexicons=str(tmp_path / "lex"))
    walked = spark.createDataFrame([(str(p),) for p in sorted((tmp_path / "in").iterdir())], "path string")
    walked = walked.selectExpr("path", "'' drive", "'/in' dir", "element_at(split(path, '/'), -1) name", "'.txt' ext", "1L size", "0D mtime")
    got = {r.name: r for r in processed(extract.extract_files(walked, s), walked, HashingEmbedder(), s).select("name", "lang", "tokens").collect()}
    assert {k: r.lang for k, r in got.items()} == {"en.txt": "en", "mixed.txt": "mixed", "vi.txt": "vi", "und.txt": "und"}
    assert "report" in got["en.txt"].tokens and "report" not in got["vi.txt"].tokens


def test_exhaustive_archives_are_whole():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "x" * 1500)
        f.writestr("b.txt", "last member")
    a = extract.extract_bytes(z.getvalue(), "z.zip", Settings(ocr="exhaustive", max_chars=1000))
    assert a.text.endswith("[archive entry: b.txt]\nlast member") and "x" * 1500 in a.text
    assert len(extract.extract_bytes(z.getvalue(), "z.zip", Settings(max_chars=1000)).text) == 1000


def test_exhaustive_pdf_recognises_every_page(monkeypatch):
    def run(program, *args, seconds=120):
        return b"layer one\f\f\f" if program == "pdftotext" else args[1].encode()

    pages = iter(["", "scanned two", ""])
    monkeypatch.setattr(extract, "run", run)
    s = Settings(ocr="exhaustive")
    got = extract.extract_bytes(b"", "a.pdf", s, path="a.pdf", tools={"image": lambda p: next(pages)})
    assert got.segments == [(1, "[Text layer]\nlayer one"), (2, "[OCR]\nscanned two"), (3, "[Page 3: no textual content detected]")]
    assert (got.method, got.ocr_used, got.pages) == ("pdf-exhaustive-ocr", 1, 3) and got.text.startswith("[Page 1]\n[Text layer]\nlayer one\n\n[Page 2]\n[OCR]\nscanned two")
    with pytest.raises(extract.Unsupported):
        extract.extract_bytes(b"", "a.pdf", s, path="a.pdf")


ROWS = "path string, drive string, dir string, name string, ext string, size long, mtime double, lang string, method string, ocr_used int, pages long, sha1 string, elapsed_ms long, content string, tokens array<string>, chunks array<struct<chunk_index:int,content:string,embedding:array<float>,model:string,page_start:int,page_end:int>>"


def stored_rows(spark, names, word="seen"):
    return spark.createDataFrame([(n, "/", "/d", n, ".txt", 1, 1.0, "en", "text", 0, None, None, 5, f"{word} {n}", [word], [(0, word, [1.0, 0.0], "m", None, None)]) for n in names], ROWS)


def weight(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)


def state(c):
    """Everything a corpus holds, batch numbers aside."""
    tables = {t: sorted(map(str, (r.asDict() for r in c.table(t).collect()))) for t in ("files", "documents", "chunks", "vision", "faces", "postings")}
    return tables, c.statistics()


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    """100 files into a corpus of 100 and into one of 10,000: the same bytes."""
    wrote = {}
    for n in (100, 10_000):
        c = Corpus(spark, str(tmp_path / f"c{n}"))
        c.upsert(stored_rows(spark, [f"old{k}" for k in range(n)]), 1.0)
        before = weight(c.root)
        c.upsert(stored_rows(spark, [*(f"old{k}" for k in range(50)), *(f"new{k}" for k in range(50))], "fresh"), 2.0)
        wrote[n] = weight(c.root) - before
        assert c.table("files").count() == n + 50 and c.table("files").select("id").distinct().count() == n + 50
        assert {r.file_id for r in c.table("postings").filter("term = 'fresh'").collect()} == {r.id for r in c.table("files").filter("indexed_at = 2").collect()}
        assert c.statistics() == (n + 50, c.table("documents").agg(F.sum("n_tokens")).first()[0])
    assert wrote[10_000] < 1.2 * wrote[100]


def test_compaction_and_expiry_keep_the_content(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"))
    for k in range(9):
        c.upsert(stored_rows(spark, [f"f{i}" for i in range(k, k + 4)], f"word{k}"), float(k))
    c.remove(c.table("files").filter("name in ('f0', 'f7')").select("path"))
    c.set_sha1(spark.createDataFrame([("f3", "aa"), ("f4", None)], "path string, sha1 string"))
    c.record_failed(spark.createDataFrame([("f5", 77)], "path string, elapsed_ms long"), 99.0)
    now = state(c)
    assert c.table("files").filter("name = 'f3'").first().sha1 == "aa" and c.table("files").filter("name = 'f5'").first().elapsed_ms == 77
    parts = len(c._snapshot()["parts"]["files"])
    assert c.compact() and len(c._snapshot()["parts"]["files"]) < parts and state(c) == now
    c.upsert(stored_rows(spark, ["f1", "f20"], "later"), 50.0)
    c.remove(c.table("files").filter("name = 'f2'").select("path"))
    now = state(c)
    assert c.compact(everything=True) and state(c) == now and not any(c._snapshot()["gone"].values())
    assert c.expire(1) and state(c) == now and not c.expire(1)
    assert [r.id for r in c.search("later").collect()] == [r.id for r in search.search(c.searchable(), "later").collect()]
    assert not os.path.isdir(os.path.join(c.root, "staged")) or not os.listdir(os.path.join(c.root, "staged"))


def test_an_index_reads_only_the_terms_of_a_query(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "c"))
    c.upsert(stored_rows(spark, [f"f{i}" for i in range(50)]), 1.0)
    plan = c.table("postings").filter(F.col("term").isin(["seen"]))._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan.replace(" ", "") or "EqualTo(term,seen)" in plan
    assert "content" not in plan


@pytest.mark.parametrize(
    "text,name",
    [
        ("Grüße aus München, wie geht es dir heute", "cp1252"), ("L’été à Orléans, déjà passé très vite", "cp1252"), ("Съешь ещё этих мягких французских булок", "cp1251"), ("Съешь ещё этих мягких французских булок", "koi8_r"),
        ("Zażółć gęślą jaźń, proszę państwa", "cp1250"), ("Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "cp1253"), ("いろはにほへと ちりぬるを 我が世誰ぞ", "shift_jis"), ("いろはにほへと ちりぬるを 我が世誰ぞ", "euc_jp"), ("我能吞下玻璃而不伤身体，这是真的", "gb18030"), ("나는 유리를 먹을 수 있어요 그래도", "euc_kr"),
    ],
)
def test_encodings_are_detected(text, name):
    from lamplight.sources.charset import decode

    assert decode(text.encode(name), 1000) == text
    assert decode(text.encode(), 1000) == text and decode(b"\xef\xbb\xbf" + text.encode(), 5) == text[:5]
    assert decode(text.encode("utf-16"), 1000) == text and decode(text.encode()[:-1], 1000, cut=True) in text


def test_media_images_and_odd_archives(monkeypatch, tmp_path):
    s, calls = Settings(), []

    def run(program, *args, seconds=120):
        calls.append((program, *args))
        if program == "tesseract":
            return b"  " if args[-1] == "3" else b"second try"
        if program == "bsdtar":
            if args[0] == "-tf":
                return b"b.txt\n../evil.txt\na.txt\nlocked.txt\nd/\n"
            if args[-1] == "locked.txt":
                raise extract.Encrypted("locked")
            return args[-1].encode()
        return b""

    monkeypatch.setattr(extract, "run", run)
    monkeypatch.setattr(extract.shutil, "which", lambda p: p)
    got = extract.extract_bytes(b"", "a.png", s, path="a.png")
    assert (got.text, got.method, got.ocr_used) == ("second try", "ocr", 1) and [c[-1] for c in calls] == ["3", "6"]
    assert extract.extract_bytes(b"", "a.heic", s, path="a.heic").text == "second try" and any(c[0] == "ffmpeg" for c in calls)
    tools = {"media": lambda p: [(0, 250, "hello"), (100 * 3725, 100 * 3726, " there ")], "frames": lambda p: ["f1", "f2", "f3"], "image": lambda p: {"f1": "title", "f2": "title"}.get(p, "end")}
    got = extract.extract_bytes(b"", "v.m4v", s, path="v.m4v", tools=tools)
    assert got.text == "[Audio transcript]\n[00:00:00-00:00:02] hello\n[01:02:05-01:02:06] there\n\n[Video frame OCR]\ntitle\nend" and (got.method, got.pages) == ("video-transcript-ocr", 3)
    assert extract.extract_bytes(b"", "s.opus", s, path="s.opus", tools=tools).method == "audio-transcript"
    with pytest.raises(extract.Unsupported):
        extract.extract_bytes(b"", "s.opus", s, path="s.opus")
    got = extract.extract_bytes(b"Rar!", "x.rar", s)
    assert got.text == "[archive entry: a.txt]\na.txt\n[archive entry: b.txt]\nb.txt" and got.method == "archive-partial"
    assert extract.extract_bytes(b"31\nSubject: s\n\nbody", "m.emlx", s).text.startswith("Subject: s")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "open")
    raw = bytearray(z.getvalue())
    raw[raw.index(b"PK\x01\x02") + 8] |= 1  # the directory says the member is encrypted
    assert extract.extract_bytes(bytes(raw), "z.zip", s).method == "archive-partial"
    put(str(tmp_path), "one.bin", b"abc")


def test_settings_files_and_scopes(tmp_path):
    from lamplight.settings import SKIP_PATHS_WINDOWS, corpus_name, include_paths, load
    from lamplight.sources.walk import Pruner

    put(str(tmp_path), "c.yaml", "workers: 900\nocr: 'off'\nocr_dpi: 20\nlexicons: lex\nskip_dirs: [a, b]\n")
    s = merged(load(str(tmp_path / "c.yaml")), {"workers": 3})
    assert (s.workers, s.ocr, s.ocr_dpi, s.skip_dirs) == (3, "off", 150, ("a", "b")) and s.lexicons == str(tmp_path / "lex") and load(None) == {}
    put(str(tmp_path), "empty.yaml", "")
    assert load(str(tmp_path / "empty.yaml")) == {}
    for bad in ("[1]", "nope: 1", "ocr: maybe", "a: [", "workers: x"):
        put(str(tmp_path), "bad.yaml", bad)
        with pytest.raises(InvalidSetting):
            load(str(tmp_path / "bad.yaml"))
    root = str(tmp_path / "root")
    inside = put(root, "d/x.txt", "x")
    put(str(tmp_path), "outside.txt", "y")
    os.symlink(str(tmp_path / "outside.txt"), os.path.join(root, "link.txt"))
    assert include_paths([root], None) is None and include_paths([root], ["d/x.txt"]) == [os.path.realpath(inside)]
    for bad in ("/etc/passwd", "../outside.txt", "C:\\x", "none.txt", "d", "link.txt"):
        with pytest.raises(InvalidSetting):
            include_paths([root], [bad])
    assert corpus_name("mail-2024") == "mail-2024"
    for bad in ("", ".", "..", "a/b", "a\\b", "jobs", ".hidden", "C:x"):
        with pytest.raises(InvalidSetting):
            corpus_name(bad)
    p = Pruner([], list(SKIP_PATHS_WINDOWS), [])
    assert p.folder("C:\\Users\\me\\AppData") and p.folder("D:\\Program Files (x86)") and not p.folder("C:\\Users\\me\\Documents")


def test_scoped_run_with_hash_lane_and_reopening(spark, tmp_path):
    root, out = str(tmp_path / "t"), str(tmp_path / "c")
    for name in ("a.txt", "b.txt", "c.txt"):
        put(root, f"d/{name}", f"text of {name}")
    at = []
    n = index(spark, [root], out, include=["d/a.txt"], progress=lambda p: at.append((p.processed, p.worked, p.total)))
    assert (n.discovered, n.files, n.removed) == (3, 1, 0) and at == [(1, 1, 1)]
    c = Corpus(spark, out)
    index(spark, [root], out)
    # a finished row without checksum is hashed and not extracted; one that cannot be read is counted
    files = c.table("files")
    c._rewrite(files.withColumn("sha1", F.lit(None).cast("string")))
    n = index(spark, [root], out)
    assert (n.hashed, n.hash_failed, n.files) == (3, 0, 0) and c.table("files").filter("sha1 IS NULL").count() == 0
    c._rewrite(c.table("files").withColumn("sha1", F.lit(None).cast("string")))
    n = index(spark, [root], out, settings=Settings(hash_backfill=False))
    assert (n.hashed, n.skipped) == (0, 3)
    os.remove(os.path.join(root, "d/c.txt"))
    n = index(spark, [root], out, include=["d/a.txt"])
    assert n.removed == 1 and c.table("files").count() == 2


def test_what_reopens_an_intact_row(spark):
    from lamplight.operators import resume

    cols = "id long, path string, ext string, method string, size long, mtime double, attempts long, sha1 string, has_chunks boolean, anchored boolean"
    row = lambda i, ext, method, anchored=True: (i, f"p{i}", ext, method, 1, 1.0, 0, "x", True, anchored)
    rows = [row(1, ".pdf", "pdf-text", False), row(2, ".pdf", "pdf-text"), row(3, ".pdf", "pdf-ocr", False), row(4, ".pdf", "pdf-exhaustive-ocr"), row(5, ".png", "ocr"), row(6, ".png", "ocr"), row(7, ".txt", "text", False), row(8, ".mp4", "video-transcript-ocr"), row(9, None, None)]
    e = spark.createDataFrame(rows, cols)
    v = spark.createDataFrame([(5, "tags", "m1"), (6, "meta", None), (8, "captions", "m2")], "file_id long, mode string, faces_model string")
    got = lambda *a, **k: {r.id for r in resume.upgrades(e, *a, **k).filter("upgrade").collect()}
    assert got() == {1} and got(exhaustive=True) == {1, 2, 3}
    assert got(v, mode="tags") == {1, 6} and got(v, mode="captions") == {1, 5, 6} and got(v, mode="meta") == {1} and got(v) == {1}
    assert got(v, mode="off", faces_model="m1") == {1, 6, 8}
    walked = e.select("path", "size", "mtime")
    assert {r.decision for r in resume.decide(walked, resume.upgrades(e), F.col("upgrade")).filter("path = 'p1'").collect()} == {"process"}


def test_vision_hook_stores_what_a_model_saw(spark, tmp_path):
    root, out = str(tmp_path / "t"), str(tmp_path / "c")
    put(root, "a.png", b"x")
    put(root, "b.png", b"y")
    put(root, "c.txt", "z")

    def look(path, mode):
        if path.endswith("b.png"):
            raise ValueError("broken")
        return {"caption": "a cat", "tags": [{"tag": "cat", "score": 0.5}], "found_faces": [{"face_index": 0, "x": 1, "y": 2, "w": 30, "h": 30, "quality": 0.9, "embedding": [1.0, 0.0], "frame": 0}]}

    tools, s = {"vision": look, "image": lambda p: "seen"}, Settings(vision="tags", faces_model="f1")
    n = index(spark, [root], out, settings=s, tools=tools)
    c = Corpus(spark, out)
    assert (n.vision_files, n.faces) == (1, 1) and [(r.caption, r.mode, r.faces_model) for r in c.table("vision").collect()] == [("a cat", "tags", "f1")]
    assert index(spark, [root], out, settings=s, tools=tools).files == 1  # only the broken one is looked at again
    assert index(spark, [root], out, settings=Settings(vision="tags", faces_model="f2"), tools=tools).files == 2


def test_a_walk_splits_deep_folders(spark, tmp_path):
    """One folder at the top holds everything: its folders are walked by tasks of their own, each file once."""
    import json

    from lamplight.sources.walk import _Reader, walk

    want = set()
    for i in range(6):
        for j in range(14):
            want.add(os.path.realpath(put(str(tmp_path), f"all/a{i}/b{j}/c/d/e/f{i}{j}.txt", "x")))
        want.add(os.path.realpath(put(str(tmp_path), f"all/a{i}/own.txt", "x")))
    put(str(tmp_path), "all/a0/node_modules/x.txt", "left out")
    os.symlink(str(tmp_path / "all"), str(tmp_path / "all/a1/loop"))
    s = Settings()
    parts = _Reader({"roots": json.dumps([str(tmp_path)]), "skip_dirs": json.dumps(list(s.skip_dirs))}).partitions()
    assert sum(p.value[0] == "deep" for p in parts) == 84
    assert sorted(r.path for r in walk(spark, [str(tmp_path)], s).collect()) == sorted(want)
    assert walk(spark, [str(tmp_path / "none")], s).count() == 0
