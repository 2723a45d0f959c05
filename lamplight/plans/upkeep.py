"""Queries over what keeps a corpus: upserts, pruning, scopes, sinks, hydration and media summaries, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.functions import stemming, text, vectors
from lamplight.operators import jobs, resume, search, sinks, vector_search, vision
from lamplight.operators.corpus import Change, Corpus
from lamplight.plans import catalogue
from lamplight.plans.catalogue import query
from lamplight.session import shared_dir, table

_STORED = catalogue._STORED_SQL
_WHITE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B"


def _corpus(spark: SparkSession, sf: str, chunks: bool = False) -> Corpus:
    """A corpus of the newest row of each path and, if asked for, of the chunks without their contents."""
    c = Corpus(spark, f"{shared_dir(spark).rstrip('/')}/lamplight-corpus-{uuid.uuid4().hex}")
    rows = {"files": catalogue._stored(spark, sf)}
    if chunks:
        rows["chunks"] = table(spark, sf, "chunks").select("id", "file_id", "chunk_index", "page_start")
    c.commit(Change(rows, {}))
    return c


# ---- corpus ------------------------------------------------------------------------------


@query(f"SELECT path, coalesce(sha1, sha1(path)) AS sha1 FROM {_STORED}")
def corpus_set_sha1(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf)
    c.set_sha1(c.table("files").filter("sha1 IS NULL").select("path", F.sha1("path").alias("sha1")))
    return c.table("files").select("path", "sha1")


@query(f"SELECT path, CASE WHEN method LIKE 'error:%' THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN method LIKE 'error:%' THEN 1234 ELSE elapsed_ms END AS elapsed_ms FROM {_STORED}")
def corpus_record_failed(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf)
    c.record_failed(c.table("files").filter("method LIKE 'error:%'").select("path", F.lit(1234).alias("elapsed_ms")), 5.0)
    return c.table("files").select("path", "attempts", "elapsed_ms")


@query(f"SELECT f.path, count(c.id) AS chunks FROM {_STORED} f LEFT JOIN chunks c ON c.file_id = f.id WHERE f.ext IS DISTINCT FROM '.txt' AND f.ext IS DISTINCT FROM '.pdf' GROUP BY f.path")
def corpus_remove(spark: SparkSession, sf: str) -> DataFrame:
    """Two removals, and a full compaction between them, leave what neither names."""
    c = _corpus(spark, sf, chunks=True)
    c.remove(c.table("files").filter("ext = '.txt'").select("path"))
    c.compact(everything=True)
    c.remove(c.table("files").filter("ext = '.pdf'").select("path"))
    kept = c.table("chunks").select(F.col("file_id").alias("id"), F.lit(1).alias("one"))
    return c.table("files").select("id", "path").join(kept, "id", "left").groupBy("path").agg(F.count("one").alias("chunks"))


@query(f"SELECT f.path FROM {_STORED} f WHERE (f.path LIKE '/srv/share/finance/%' OR f.path LIKE '/srv/share/archive/%') AND f.path NOT IN (SELECT path FROM discovered WHERE job_id = (SELECT max(job_id) FROM discovered))")
def prune_missing(spark: SparkSession, sf: str) -> DataFrame:
    """What a prune of two roots drops after a walk that saw what the job of the greatest id saw."""
    d = table(spark, sf, "discovered")
    walked = d.filter(F.col("job_id") == d.agg(F.max("job_id")).first()[0]).select("path").distinct()
    return resume.missing(catalogue._stored(spark, sf), walked, ["/srv/share/finance/", "/srv/share/archive"]).select("path")


_FLAGS = "(SELECT file_id, max(page_start) IS NOT NULL AS anchored FROM chunks GROUP BY file_id)"


@query(
    f"SELECT f.path, coalesce((f.method IN ('pdf-text', 'pdf-exhaustive-text', 'pdf-exhaustive-ocr') AND c.file_id IS NOT NULL AND NOT c.anchored) OR (f.ext = '.pdf' AND coalesce(f.method, '') NOT LIKE 'pdf-exhaustive%'), false) AS upgrade"
    f" FROM {_STORED} f LEFT JOIN {_FLAGS} c ON c.file_id = f.id"
)
def reopened_exhaustive(spark: SparkSession, sf: str) -> DataFrame:
    flags = resume.with_chunks(catalogue._stored(spark, sf), table(spark, sf, "chunks"))
    return resume.upgrades(flags, exhaustive=True).select("path", "upgrade")


@query(
    f"WITH v AS (SELECT id AS file_id, CASE id % 3 WHEN 0 THEN 'meta' WHEN 1 THEN 'tags' ELSE 'captions' END AS mode FROM files WHERE id % 2 = 0)"
    f" SELECT f.path FROM {_STORED} f LEFT JOIN v ON v.file_id = f.id LEFT JOIN {_FLAGS} c ON c.file_id = f.id"
    " WHERE (f.ext IN ('.png', '.jpg', '.jpeg', '.tif', '.tiff', '.bmp', '.webp', '.gif', '.heic', '.mkv', '.mp4', '.mov', '.m4v', '.avi', '.webm') AND coalesce(v.mode, 'off') IN ('off', 'meta'))"
    " OR (f.method IN ('pdf-text', 'pdf-exhaustive-text', 'pdf-exhaustive-ocr') AND c.file_id IS NOT NULL AND NOT c.anchored)"
)
def reopened_vision(spark: SparkSession, sf: str) -> DataFrame:
    """Reopened when tags are asked for and every second file has been looked at in some mode."""
    flags = resume.with_chunks(catalogue._stored(spark, sf), table(spark, sf, "chunks"))
    mode = F.when(F.col("id") % 3 == 0, "meta").when(F.col("id") % 3 == 1, "tags").otherwise("captions")
    seen = table(spark, sf, "files").filter("id % 2 = 0").select(F.col("id").alias("file_id"), mode.alias("mode"), F.lit(None).cast("string").alias("faces_model"))
    return resume.upgrades(flags, seen, mode="tags").filter("upgrade").select("path")


@query(
    "WITH r AS (SELECT path, size, mtime, CASE WHEN ext = '.txt' THEN 'error:decode' ELSE 'text' END AS method FROM files WHERE id % 2 = 0)"
    f", k AS (SELECT path, size, mtime FROM {_STORED} s WHERE method LIKE 'excluded:%' OR (s.id IN (SELECT file_id FROM chunks) AND NOT (method = 'name-only' OR method LIKE 'error:%' OR method LIKE '%-partial')))"
    " SELECT path, method FROM r WHERE NOT (method LIKE 'error:%' AND EXISTS (SELECT 1 FROM k WHERE k.path = r.path AND k.size = r.size AND trunc(k.mtime) = trunc(r.mtime)))"
)
def kept_on_failure(spark: SparkSession, sf: str) -> DataFrame:
    """Results of a run that fails on text files, without failures of files whose unchanged row is complete."""
    run = table(spark, sf, "files").filter("id % 2 = 0").select("path", "size", "mtime", F.when(F.col("ext") == ".txt", "error:decode").otherwise("text").alias("method"))
    return resume.keep_old_on_error(run, resume.with_chunks(catalogue._stored(spark, sf), table(spark, sf, "chunks"))).select("path", "method")


@query(r"SELECT DISTINCT path FROM discovered WHERE regexp_matches(dir, '(?i)^/srv/share/[^/]*/20[^/]*$')")
def skipped_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Paths below folders that an anchored pattern leaves out."""
    d = table(spark, sf, "discovered").filter(F.col("dir").rlike(text.glob_pattern("/srv/SHARE/*/20*")))
    return d.select("path").distinct()


@query(
    "WITH n AS (SELECT id, CASE WHEN status = 'running' THEN 'error' ELSE status END AS status, updated_at + CASE WHEN status = 'running' THEN 1 ELSE -1 END AS updated_at, 1 AS r FROM jobs),"
    " u AS (SELECT id, status, updated_at, 0 AS r FROM jobs UNION ALL SELECT * FROM n) SELECT id, status, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, r DESC) AS k FROM u) WHERE k = 1"
)
def job_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old, running = table(spark, sf, "jobs").select("id", "status", "updated_at"), F.col("status") == "running"
    new = old.select("id", F.when(running, "error").otherwise(F.col("status")).alias("status"), (F.col("updated_at") + F.when(running, 1).otherwise(-1)).alias("updated_at"))
    return jobs.upsert(old, new)


# ---- sinks -------------------------------------------------------------------------------


@query("SELECT 'doc/' || doc_id AS path, lang, n_chars AS size, md5(substr(text, 1, 400)) AS snippet, sha1(text) AS sha1 FROM documents")
def sink_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON lines and read back."""
    d = table(spark, sf, "documents").withColumn("path", F.concat(F.lit("doc/"), "doc_id"))
    files = d.select("path", "lang", "method", F.col("n_chars").alias("size"), "ocr_used", F.lit(0).alias("pages"), F.col("n_chars").alias("chars"), F.sha1("text").alias("sha1"))
    at = f"{shared_dir(spark).rstrip('/')}/lamplight-manifest-{uuid.uuid4().hex}"
    sinks.write_manifest(files, d.select("path", F.col("text").alias("content")), at, "overwrite")
    back = spark.read.schema("path string, lang string, size long, snippet string, sha1 string").json(at)
    return back.select("path", "lang", "size", F.md5("snippet").alias("snippet"), "sha1")


@query("SELECT path, name, ext, size, printf('%.0f', mtime) AS mtime, ocr_used FROM files")
def sink_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Written as CSV and read back."""
    at = f"{shared_dir(spark).rstrip('/')}/lamplight-csv-{uuid.uuid4().hex}"
    sinks.write_catalogue(table(spark, sf, "files"), at, "overwrite")
    ddl = "path string, dir string, name string, ext string, size long, mtime string, lang string, method string, ocr_used int"
    return spark.read.schema(ddl).csv(at, header=True, escape='"', multiLine=True).select("path", "name", "ext", "size", "mtime", "ocr_used")


# ---- hits and texts ----------------------------------------------------------------------


@query("SELECT f.path, f.name, c.chunk_index, CAST(c.id AS DOUBLE) AS score, md5(c.content) AS content, c.page_start, c.page_end, c.id FROM (SELECT id FROM chunks ORDER BY id DESC LIMIT 50) h JOIN chunks c USING (id) JOIN files f ON f.id = c.file_id")
def hydrated_hits(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks")
    hits = chunks.orderBy(F.desc("id")).limit(50).select("id", F.col("id").cast("double").alias("score"))
    return vector_search.hydrate(hits, chunks, table(spark, sf, "files")).withColumn("content", F.md5("content"))


_HIT = ", ".join(f"'{w}'" for w in catalogue.SEARCH_TERMS)
_SNIPPET_SQL = rf"""
, sh AS (SELECT id, score FROM r ORDER BY r.score DESC, id LIMIT 20),
 st AS (SELECT sh.id, sh.score, d.text, regexp_extract_all(d.text, '[\p{{L}}\p{{N}}_]+') AS w, regexp_extract_all(d.text, '([^\p{{L}}\p{{N}}_]*)[\p{{L}}\p{{N}}_]+', 1) AS g FROM sh JOIN documents d ON d.doc_id = sh.id),
 sn AS (SELECT *, list_transform(w, lambda x: strip_accents(lower(x))) AS q, len(w) AS n FROM st),
 sc AS (SELECT *, list_transform(range(1, greatest(n - 12 + 1, 1) + 1), lambda i: len(list_distinct(list_filter(q[i:i + 11], lambda x: x IN ({_HIT}))))) AS k FROM sn),
 sb AS (SELECT *, list_position(k, list_max(k)) AS i FROM sc)
SELECT id, round(score, 6) AS score, CASE WHEN text IS NULL THEN NULL WHEN n = 0 THEN '' ELSE (CASE WHEN i > 1 THEN ' … ' ELSE '' END)
  || array_to_string(list_transform(range(i, least(i + 11, n) + 1), lambda j: (CASE WHEN j > i THEN g[j] ELSE '' END) || (CASE WHEN q[j] IN ({_HIT}) THEN '[' || w[j] || ']' ELSE w[j] END)), '')
  || (CASE WHEN i - 1 + 12 < n THEN ' … ' ELSE '' END) END AS snippet FROM sb
"""


@query(catalogue._fts_sql(catalogue.SEARCH_TERMS) + _SNIPPET_SQL)
def fts_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(catalogue._docs(spark, sf), catalogue.SEARCH).withColumn("score", F.round("score", 6))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents WHERE text IS NOT NULL)")
def document_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text of one document, by a corpus."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    last = d.agg(F.max("doc_id")).first()[0]
    c = Corpus(spark, f"{shared_dir(spark).rstrip('/')}/lamplight-corpus-{uuid.uuid4().hex}")
    c.commit(Change({"documents": d.select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))}, {}))
    return spark.range(1).select(F.lit(last).alias("doc_id"), F.md5(F.lit(c.text(last))).alias("digest"))


_KNOWN = r"(SELECT list(DISTINCT lower(w)) FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS w FROM lang_samples WHERE lang = '{}'))"


@query(
    catalogue._LANG_SQL.rsplit("r AS (", 1)[0]
    + f"k AS (SELECT {_KNOWN.format('en')} AS en, {_KNOWN.format('vi')} AS vi),"
    + " e AS (SELECT n.*, len(list_filter(ws, lambda x: list_contains(k.en, x))) AS en, len(list_filter(ws, lambda x: list_contains(k.vi, x))) AS vi FROM n, k),"
    + " y AS (SELECT doc_id, len(ws) AS words, cy / chars > 0.02 AS ru, marks, marks / chars > 0.02 OR vi / n > 0.35 AS isvi, en / n > 0.35 AS isen, contains(t, 'ß') OR de / n > 0.15 AS isde, en, vi FROM e)"
    " SELECT doc_id, CASE WHEN words = 0 THEN 'und' WHEN ru THEN 'ru' WHEN isvi AND isen THEN 'mixed' WHEN isvi THEN 'vi' WHEN NOT isen AND NOT isde AND marks > 0 THEN 'vi' WHEN isde THEN 'de' WHEN isen THEN 'en' WHEN en >= vi AND en > 0 THEN 'en' ELSE 'und' END AS detected FROM y"
)
def detect_lang_dict(spark: SparkSession, sf: str) -> DataFrame:
    """With dictionaries, here the words of the English and Vietnamese samples."""
    s = table(spark, sf, "lang_samples")
    known = lambda lang: {r.w for r in s.filter(F.col("lang") == lang).select(F.explode(text.words("text")).alias("w")).distinct().collect()}  # noqa: E731 - a fixed table
    return table(spark, sf, "documents").select("doc_id", text.detect_lang("text", known("en"), known("vi")).alias("detected"))


@query(
    catalogue._LANG_SQL
    + rf", tx AS (SELECT d.doc_id AS id, concat_ws(' ', coalesce(text, ''), name, replace({catalogue._DOC_PATH}, '/', ' ')) AS t FROM documents d JOIN r USING (doc_id) WHERE detected IN ('de', 'ru')),"
    r" tw AS (SELECT id, list_transform(regexp_extract_all(t, '[\p{L}\p{N}]+'), lambda v: lower(v)) AS ws FROM tx)"
    r" SELECT id, md5(array_to_string(list_sort(list_distinct(list_concat(ws, list_transform(ws, lambda v: replace(strip_accents(v), 'đ', 'd'))))), ' ')) AS digest FROM tw"
)
def token_enrich_folded(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched tokens of German and Russian documents: words and folded words, no stems."""
    d = catalogue._docs(spark, sf).withColumn("detected", text.detect_lang("content")).filter("detected IN ('de', 'ru')")
    words = text.words(text.token_source(F.coalesce("content", F.lit("")), "name", "path"))
    return d.select("id", F.md5(F.array_join(F.array_sort(stemming.enrich(words, F.col("detected"))), " ")).alias("digest"))


@query(rf"SELECT doc_id, md5(CASE WHEN regexp_matches(coalesce(text, ''), '[^{_WHITE}\x0C]') THEN text ELSE concat_ws(' ', name, source) END) AS digest FROM documents")
def fallback_contents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fallback_content("text", "name", "source")).alias("digest"))


@query("SELECT l_orderkey, l_linenumber, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS at FROM (SELECT l_orderkey, l_linenumber, (l_orderkey * 977 + l_linenumber) // 100 AS s FROM lineitem)")
def clock_times(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.clock(F.col("l_orderkey") * 977 + F.col("l_linenumber")).alias("at"))


# ---- vectors and media -------------------------------------------------------------------


@query(catalogue._BIT_SQL + "SELECT b.id, CAST(list_sum(list_transform(list_zip(code, c), lambda z: bit_count(xor(z[1], z[2])))) AS INT) AS distance FROM b, (SELECT code AS c FROM b ORDER BY id LIMIT 1)")
def vector_bit_distances(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    codes = vector_search.codes(e, "bit", vector_search.centre_vector(e), id="vec_id")
    first = codes.orderBy("id").first().code
    return codes.select("id", vectors.hamming(F.col("code"), F.array(*(F.lit(int(x)).cast("long") for x in first))).cast("int").alias("distance"))


@query(
    "WITH q AS (SELECT min(vec_id) AS q, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label), e AS (SELECT q.q, e.vec_id AS id, e.label, row_number() OVER (PARTITION BY q.q ORDER BY list_cosine_similarity(e.embedding, q.v) DESC, e.vec_id) AS k FROM q, embeddings e)"
    " SELECT q, count(*) FILTER (WHERE label % 2 = 0) / 10.0 AS recall FROM e WHERE k <= 10 GROUP BY q"
)
def vector_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the ten nearest of the first vector of each label that a search of half of the labels keeps."""
    e = table(spark, sf, "embeddings")
    asked = [(r.q, [float(x) for x in r.v]) for r in e.groupBy("label").agg(F.min("vec_id").alias("q"), F.min_by("embedding", "vec_id").alias("v")).collect()]  # a row a label
    hits = None
    for q, v in asked:
        one = vector_search.exact_search(e, v, 10, "vec_id").select(F.lit(q).cast("long").alias("q"), "id")
        hits = one if hits is None else hits.unionByName(one)
    even = hits.join(e.filter("label % 2 = 0").select(F.col("vec_id").alias("id")), "id", "left_semi")
    return vector_search.recall(even, hits)


_OBJECTS = "(SELECT user_id, event_type AS label, count(*) AS n FROM events GROUP BY user_id, event_type)"


@query(
    f"WITH o AS (SELECT user_id, string_agg(label || ' x' || n, ', ' ORDER BY n DESC, label) AS objects, string_agg(label, ', ' ORDER BY label) AS tags FROM {_OBJECTS} GROUP BY user_id)"
    " SELECT user_id AS file_id, md5('[vision]' || chr(10) || concat_ws(chr(10), CASE WHEN user_id % 2 = 0 THEN 'caption: user ' || user_id END, 'objects: ' || objects, 'tags: ' || tags, CASE WHEN user_id % 3 = 0 THEN 'camera: K1' END)) AS block FROM o"
)
def vision_blocks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("label")).agg(F.count("*").cast("int").alias("count"), F.max("value").alias("confidence"))
    per = o.groupBy(F.col("user_id").alias("file_id")).agg(
        F.array_sort(F.collect_list(F.struct("label", "count", "confidence")), lambda a, b: F.when(a["count"] != b["count"], (b["count"] - a["count"]).cast("int")).when(a["label"] < b["label"], -1).otherwise(1)).alias("objects"),
        F.array_sort(F.collect_list(F.struct(F.col("label").alias("tag"), F.col("confidence").cast("float").alias("score")))).alias("tags"),
    )
    made = per.withColumn("caption", F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("user "), F.col("file_id").cast("string")))).withColumn("exif", F.create_map(F.lit("camera"), F.when(F.col("file_id") % 3 == 0, "K1")))
    return vision.content_block(made).select("file_id", F.md5("block").alias("block"))


@query(
    "WITH e AS (SELECT user_id, event_id, CASE WHEN value >= 50 THEN value END AS v, CASE event_type WHEN 'click' THEN 'meta' WHEN 'view' THEN 'tags' WHEN 'purchase' THEN 'captions' WHEN 'signup' THEN 'off' END AS mode FROM events)"
    " SELECT user_id AS video, arg_min(v, event_id) FILTER (WHERE v IS NOT NULL) AS v, arg_min(mode, CASE mode WHEN 'off' THEN 1 WHEN 'meta' THEN 2 WHEN 'tags' THEN 3 ELSE 4 END) FILTER (WHERE mode IS NOT NULL) AS mode FROM e GROUP BY user_id"
)
def video_summaries(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    mode = F.when(t == "click", "meta").when(t == "view", "tags").when(t == "purchase", "captions").when(t == "signup", "off")
    frames = table(spark, sf, "events").select(F.col("user_id").alias("video"), "event_id", F.when(F.col("value") >= 50, F.col("value")).alias("v"), mode.alias("mode"))
    return vision.frames_summary(frames, "video", "event_id", ["v"])


@query("SELECT c.file_id, f.path, f.name, f.dir, c.n FROM (SELECT file_id, count(*) AS n FROM chunks GROUP BY file_id) c JOIN files f ON f.id = c.file_id")
def vision_with_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunks").groupBy("file_id").agg(F.count("*").alias("n"))
    return vision.with_files(rows, table(spark, sf, "files")).select("file_id", "path", "name", "dir", "n")


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
def parts_never_returned(spark: SparkSession, sf: str) -> DataFrame:
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 25").select("l_partkey")
    return table(spark, sf, "part").select("p_partkey").subtract(returned)
