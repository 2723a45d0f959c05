"""Queries over the standard tables with their SQL counterparts."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamplight.functions import methods, stemming, text, vectors
from lamplight.operators.corpus import Change, Corpus
from lamplight.operators import chunking, incremental, jobs, resume, search, stats, vector_search, vision
from lamplight.session import cut, shared_dir, spread, table
from lamplight.streaming import operators as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NEWEST_SQL = """
WITH n AS (SELECT path, sha1, size, mtime FROM (SELECT *, row_number() OVER (PARTITION BY path
       ORDER BY seen_at DESC NULLS LAST, sha1 DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST) AS k FROM discovered WHERE path IS NOT NULL) WHERE k = 1),
     m AS (SELECT path, sha1, size, mtime FROM (SELECT *, row_number() OVER (PARTITION BY path
       ORDER BY indexed_at DESC, sha1 DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST) AS k FROM files WHERE indexed_at IS NOT NULL) WHERE k = 1)
SELECT n.path FROM n LEFT JOIN m ON n.path = m.path
WHERE m.path IS NULL OR CASE WHEN n.sha1 IS NULL OR m.sha1 IS NULL
      THEN n.size IS DISTINCT FROM m.size OR floor(n.mtime) IS DISTINCT FROM floor(m.mtime) ELSE n.sha1 <> m.sha1 END
"""


@query(_NEWEST_SQL)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    manifest = incremental.stored_last(table(spark, sf, "files"))
    return incremental.new_or_changed(table(spark, sf, "discovered"), manifest).select("path")


# ---- sources and scalar functions -------------------------------------------------------

_DOC_PATH = "source || '/' || coalesce(name, 'doc_' || doc_id)"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """documents as a corpus: id, name, dir, path, content."""
    name = F.coalesce("name", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    d = spread(table(spark, sf, "documents").select("doc_id", "name", "source", "text", "lang", "method", "ext", "ocr_used"))
    return d.select(F.col("doc_id").alias("id"), F.col("name"), F.col("source").alias("dir"), F.concat_ws("/", "source", name).alias("path"), F.col("text").alias("content"), "lang", "method", "ext", "ocr_used")


@query("SELECT doc_id, source, lang, n_chars, md5(text) AS digest FROM documents")
def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("digest"))


@query(
    r"SELECT id, regexp_extract(path, '([^/\\]*)$', 1) AS base, lower(regexp_extract(path, '[^/\\](\.[^./\\]*)$', 1)) AS suffix,"
    r" regexp_replace(path, '[/\\][^/\\]*$', '') AS folder, regexp_extract(path, '^([A-Za-z]:|[/\\]?[^/\\]*)', 1) AS first_part FROM files"
)
def file_records(spark: SparkSession, sf: str) -> DataFrame:
    p = "path"
    return table(spark, sf, "files").select("id", text.base_name(p).alias("base"), text.extension(p).alias("suffix"), text.directory(p).alias("folder"), text.drive(p).alias("first_part"))


_WORDS_SQL = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w))"


@query(f"SELECT doc_id, CAST(len({_WORDS_SQL}) AS INT) AS n, md5(array_to_string({_WORDS_SQL}, ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def tokens_words(spark: SparkSession, sf: str) -> DataFrame:
    w = text.words("text")
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.size(w).alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


@query("SELECT id, replace(replace(strip_accents(name), 'đ', 'd'), 'Đ', 'D') AS folded FROM files")
def names_folded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").select("id", text.fold("name").alias("folded"))


_STOP = ", ".join(f"'{w}'" for w in text.GERMAN_STOPWORDS)
_LANG_SQL = rf"""
WITH s AS (SELECT doc_id, substr(coalesce(text, ''), 1, 2000) AS t FROM documents),
     w AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x))[1:300] AS ws FROM s),
     n AS (SELECT doc_id, t, ws, greatest(length(t), 1) AS chars, greatest(len(ws), 1) AS n, len(regexp_extract_all(lower(t), '[{text.VIETNAMESE}]')) AS marks,
           len(list_filter(ws, lambda x: x IN ({_STOP}))) AS de, len(regexp_extract_all(t, '[Ѐ-ԯ]')) AS cy FROM w),
     r AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN 'und' WHEN cy / chars > 0.02 THEN 'ru' WHEN marks / chars > 0.02 THEN 'vi'
           WHEN NOT (contains(t, 'ß') OR de / n > 0.15) AND marks > 0 THEN 'vi' WHEN contains(t, 'ß') OR de / n > 0.15 THEN 'de' ELSE 'und' END AS detected FROM n)
"""


@query(_LANG_SQL + "SELECT doc_id, detected FROM r")
def detect_lang(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", F.substring("text", 1, text.LANG_CHARS).alias("text"))).select("doc_id", text.detect_lang("text").alias("detected"))


@query(_LANG_SQL + "SELECT detected, count(*) AS n FROM r GROUP BY detected")
def lang_counts(spark: SparkSession, sf: str) -> DataFrame:
    return detect_lang(spark, sf).groupBy("detected").agg(F.count("*").alias("n"))


@query()
def token_enrich(spark: SparkSession, sf: str) -> DataFrame:
    """Enriched tokens of every document; stems have no SQL counterpart."""
    d = _docs(spark, sf)
    words = text.words(text.token_source(F.coalesce("content", F.lit("")), "name", "path"))
    return d.select("id", stemming.enrich(words, text.detect_lang("content")).alias("tokens"))


@query(r"SELECT doc_id, md5(replace(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '<[^>]*$', '', 'g'), '>', ' ')) AS digest FROM documents")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.strip_html("text")).alias("digest"))


@query("SELECT doc_id, sha1(text) AS digest FROM documents")
def sha1_content(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("digest"))


@query("SELECT min(doc_id) AS first_id, count(*) AS copies, sha1(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY sha1(text) HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("text IS NOT NULL").groupBy(F.sha1("text").alias("digest"))
    return d.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")


@query("SELECT id, json_extract_string(CASE WHEN json_valid(envelope_json) THEN envelope_json END, '$.job_id') AS job, status FROM jobs")
def job_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "jobs").select("id", F.get_json_object("envelope_json", "$.job_id").alias("job"), "status")


# ---- chunks ------------------------------------------------------------------------------

_WINDOW_SQL = r"""
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0),
     w AS (SELECT doc_id, s AS start, substr(text, CAST(s + 1 AS INT), 1200) AS part FROM d, unnest(range(0, greatest(n - 200, 1), 1000)) AS u(s)),
     k AS (SELECT * FROM w WHERE regexp_matches(part, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x0C]'))
"""


@query(_WINDOW_SQL + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INT) AS chunk_index, CAST(start AS INT) AS start, CAST(length(part) AS INT) AS chars, md5(part) AS digest FROM k")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.windows(table(spark, sf, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_index", "start", F.length("content").alias("chars"), F.md5("content").alias("digest"))


@query(
    r"WITH p AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS part, generate_subscripts(string_split(text, chr(12)), 1) AS page FROM documents WHERE text IS NOT NULL)"
    r" SELECT doc_id, CAST(page AS INT) AS page, CAST(length(part) AS INT) AS chars FROM p WHERE regexp_matches(part, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]')"
)
def page_segments(spark: SparkSession, sf: str) -> DataFrame:
    p = chunking.pages(table(spark, sf, "documents"), "doc_id", "text")
    return p.select("doc_id", "page", F.length("text").alias("chars"))


_SPAN_SQL = r"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS part, generate_subscripts(string_split(text, chr(12)), 1) AS page FROM documents WHERE text IS NOT NULL),
     f AS (SELECT * FROM p WHERE regexp_matches(part, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]')),
     o AS (SELECT doc_id, page, length(part) AS n, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY page) AS stop, string_agg(part, '') OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS whole FROM f),
     w AS (SELECT DISTINCT doc_id, s AS start, substr(whole, CAST(s + 1 AS INT), 1200) AS piece FROM o, unnest(range(0, greatest(length(whole) - 200, 1), 1000)) AS u(s)),
     k AS (SELECT * FROM w WHERE regexp_matches(piece, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]'))
SELECT k.doc_id, CAST(k.start AS INT) AS start, CAST(min(o.page) AS INT) AS page_start, CAST(max(o.page) AS INT) AS page_end FROM k JOIN o ON o.doc_id = k.doc_id AND o.stop > k.start AND o.stop - o.n < k.start + length(k.piece)
GROUP BY k.doc_id, k.start
"""


@query(_SPAN_SQL)
def chunk_page_spans(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.paged_windows(table(spark, sf, "documents"), "doc_id", "text")
    return c.select("doc_id", "start", "page_start", "page_end")


# ---- full text ---------------------------------------------------------------------------

#: A search and its index terms, written out.
SEARCH, SEARCH_TERMS = "risk assessment ledger", ["assess", "assessment", "ledger", "risk"]
SEARCHES = {
    "risk assessment ledger": SEARCH_TERMS, "Prüfbericht": ["prufbericht", "prüfbericht"],
    "hợp đồng tín dụng": ["dong", "dung", "hop", "hợp", "tin", "tín", "đồng", "dụng"], "dossier du client": ["client", "dossier", "du"],
}


def _fts_sql(terms: list[str]) -> str:
    tok = r"regexp_extract_all(lower(strip_accents(coalesce({}, ''))), '[\p{{L}}\p{{N}}_\p{{Co}}]+')"
    every = f"list_concat({tok.format('name')}, list_concat({tok.format(_DOC_PATH)}, {tok.format("replace(text, chr(0), ' ')")}))"
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{k}" for k, w in enumerate(terms))
    some = " OR ".join(f"f{k} > 0" for k in range(len(terms)))
    dfs = ", ".join(f"sum(CASE WHEN f{k} > 0 THEN 1 ELSE 0 END) AS d{k}" for k in range(len(terms)))
    idf = lambda k: f"CASE WHEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) > 0 THEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(k)}) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * length / mean))" for k in range(len(terms)))
    return (
        f"WITH x AS (SELECT doc_id AS id, source AS dir, {every} AS t FROM documents), c AS (SELECT id, dir, len(t) AS length, {counts} FROM x),"
        f" s AS (SELECT count(*) AS n, avg(length) AS mean, {dfs} FROM c), r AS (SELECT id, dir, {score} AS score FROM c, s WHERE {some})"
    )


def _index(spark: SparkSession, sf: str, fresh: bool = False) -> search.SearchIndex:
    """The stored index of documents, in the shared folder; written once for each state of the table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    at = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()
    name = hashlib.md5(f"{sf} {at}".encode()).hexdigest()
    index = search.SearchIndex(spark, f"{shared_dir(spark).rstrip('/')}/lamplight-fts-{search.FORMAT}-{name}")
    if fresh or not index.exists():
        index.write(_docs(spark, sf))
    return index


_FTS_TOKENS = "SELECT doc_id, unnest(list_concat({name}, list_concat({path}, {text}))) AS term FROM documents".format(
    **{k: rf"regexp_extract_all(lower(strip_accents(coalesce({v}, ''))), '[\p{{L}}\p{{N}}_\p{{Co}}]+')" for k, v in {"name": "name", "path": _DOC_PATH, "text": "replace(text, chr(0), ' ')"}.items()}
)


@query(f"WITH t AS ({_FTS_TOKENS}) SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS tokens, count(DISTINCT term) AS terms FROM t")
def fts_index(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the stored index anew; the searches below read it."""
    index = _index(spark, sf, fresh=True)
    return index.postings().agg(F.countDistinct("term").alias("terms")).select(*(F.lit(v).cast("long").alias(n) for n, v in zip(("documents", "tokens"), index.statistics(), strict=True)), "terms")


@query(_fts_sql(SEARCH_TERMS) + " SELECT id FROM r")
def fts_match(spark: SparkSession, sf: str) -> DataFrame:
    tf = search.term_frequencies(_docs(spark, sf), search.match_terms(SEARCH))
    return tf.filter(F.exists("f", lambda x: x > 0)).select("id")


@query(_fts_sql(SEARCH_TERMS) + " SELECT id, round(score, 6) AS score FROM r ORDER BY r.score DESC, id LIMIT 20")
def fts_bm25_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Without an index: every document is tokenized."""
    return search.bm25(_docs(spark, sf), search.match_terms(SEARCH)).select("id", F.round("score", 6).alias("score"))


@query(_fts_sql(SEARCH_TERMS) + " SELECT id, round(score, 6) AS score FROM r ORDER BY r.score DESC, id LIMIT 20")
def fts_bm25_top(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).search([(SEARCH, search.match_terms(SEARCH))]).select("id", F.round("score", 6).alias("score"))


@query(" UNION ALL ".join(f"SELECT * FROM ({_fts_sql(ts)} SELECT '{q}' AS query, id, round(score, 6) AS score FROM r ORDER BY r.score DESC, id LIMIT 10)" for q, ts in SEARCHES.items()))
def search_hits_multi(spark: SparkSession, sf: str) -> DataFrame:
    hits = _index(spark, sf).search([(q, search.match_terms(q)) for q in SEARCHES], k=10)
    return hits.select("query", "id", F.round("score", 6).alias("score"))


@query(_fts_sql(SEARCH_TERMS) + " SELECT dir, count(*) AS n FROM r GROUP BY dir ORDER BY n DESC, dir LIMIT 10")
def top_folders(spark: SparkSession, sf: str) -> DataFrame:
    folders = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("dir"))
    return search.folders_of(_index(spark, sf).postings(), folders, search.match_terms(SEARCH))


@query("SELECT p_partkey AS id, p_name AS name, round(jaro_winkler_similarity('misty rose part', lower(p_name)), 6) AS score FROM part ORDER BY jaro_winkler_similarity('misty rose part', lower(p_name)) DESC, id LIMIT 20")
def fuzzy_names(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.fuzzy_names(table(spark, sf, "part"), "misty rose part", "p_name", "p_partkey")
    return hits.select("id", "name", F.round("score", 6).alias("score"))


# ---- statistics --------------------------------------------------------------------------


@query(
    " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM files GROUP BY {c} ORDER BY n DESC, value NULLS LAST LIMIT {k})" for c, k in stats.LIMITS.items())
)
def analyze_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return stats.breakdown(table(spark, sf, "files"))


@query("SELECT ext, lang, method, count(*) AS n FROM files GROUP BY GROUPING SETS ((ext), (lang), (method))")
def analyze_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "files").createOrReplaceTempView("lamplight_files")
    return spark.sql("SELECT ext, lang, method, count(*) AS n FROM lamplight_files GROUP BY GROUPING SETS ((ext), (lang), (method))")


@query("SELECT method AS value, count(*) AS n FROM files GROUP BY method ORDER BY n DESC, value LIMIT 20")
def analyze_methods(spark: SparkSession, sf: str) -> DataFrame:
    return stats.grouped(table(spark, sf, "files"), "method", 20)


@query("SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(ocr_used), 0) AS BIGINT) AS ocr_files FROM files")
def analyze_totals(spark: SparkSession, sf: str) -> DataFrame:
    return stats.totals(table(spark, sf, "files"))


@query(
    "SELECT (SELECT count(*) FROM files) AS indexed_files, (SELECT CAST(coalesce(sum(chars), 0) AS BIGINT) FROM files) AS total_characters, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM files) AS total_bytes,"
    " (SELECT CAST(coalesce(sum(ocr_used), 0) AS BIGINT) FROM files) AS ocr_files, (SELECT count(DISTINCT lang) FROM files) AS languages, (SELECT count(DISTINCT method) FROM files) AS methods,"
    " (SELECT count(*) FROM chunks WHERE embedding IS NOT NULL) AS embedded_chunks, greatest((SELECT count(DISTINCT path) FROM discovered) - (SELECT count(*) FROM files), 0) AS pending_files"
)
def corpus_status(spark: SparkSession, sf: str) -> DataFrame:
    walked = table(spark, sf, "discovered").agg(F.countDistinct("path")).first()[0]
    return stats.status(table(spark, sf, "files"), table(spark, sf, "chunks"), walked)


_STORED_SQL = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST, id DESC) AS k FROM files) WHERE k = 1)"


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """Newest row a path, as one corpus state."""
    cols = [c for c in table(spark, sf, "files").columns if c not in ("path", "indexed_at", "id")]
    return incremental.newest_per_key(table(spark, sf, "files"), "path", "indexed_at", ["id", *cols])


_WALKED_SQL = "(SELECT path, max_by(size, seen_at) AS size, max_by(mtime, seen_at) AS mtime, max_by(name, seen_at) AS name, max_by(dir, seen_at) AS dir FROM (SELECT DISTINCT path, size, mtime, name, dir, seen_at FROM discovered) GROUP BY path)"


def _walked(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.newest_per_key(table(spark, sf, "discovered"), "path", "seen_at", ["size", "mtime", "name", "dir"])


@query(f"SELECT w.dir, w.name, w.path, f.id AS file_id, f.method, f.id IS NOT NULL AS indexed FROM {_WALKED_SQL} w LEFT JOIN {_STORED_SQL} f ON f.path = w.path")
def tree_listing(spark: SparkSession, sf: str) -> DataFrame:
    listing = _walked(spark, sf).withColumn("is_dir", F.lit(False))
    return stats.tree(listing, _stored(spark, sf)).select("dir", "name", "path", "file_id", "method", "indexed")


# ---- incremental -------------------------------------------------------------------------

_DECISION_SQL = f"""
SELECT w.path, CASE WHEN f.path IS NULL THEN 'new'
  WHEN w.size <> f.size OR trunc(w.mtime) <> trunc(f.mtime) OR (NOT done AND f.attempts < 3) THEN 'process'
  WHEN NOT done THEN 'capped' WHEN f.sha1 IS NULL AND w.size < 1073741824 THEN 'hash-only' ELSE 'skip' END AS decision
FROM {_WALKED_SQL} w LEFT JOIN (SELECT s.*, coalesce(method LIKE 'excluded:%' OR (s.id IN (SELECT file_id FROM chunks) AND NOT (method = 'name-only' OR method LIKE 'error:%' OR method LIKE '%-partial')), FALSE) AS done FROM {_STORED_SQL} s) f ON f.path = w.path
"""


@query(_DECISION_SQL)
def resume_decision(spark: SparkSession, sf: str) -> DataFrame:
    existing = resume.with_chunks(_stored(spark, sf), table(spark, sf, "chunks"))
    return resume.decide(_walked(spark, sf), existing)


@query(f"SELECT decision, count(*) AS n FROM ({_DECISION_SQL}) GROUP BY decision")
def resume_summary(spark: SparkSession, sf: str) -> DataFrame:
    return resume_decision(spark, sf).groupBy("decision").agg(F.count("*").alias("n"))


@query("SELECT file_id FROM chunks WHERE file_id IN (SELECT id FROM files) GROUP BY file_id HAVING max(page_start) IS NULL")
def unanchored_files(spark: SparkSession, sf: str) -> DataFrame:
    return resume.unanchored(table(spark, sf, "files"), table(spark, sf, "chunks"))


@query("SELECT id, id IN (SELECT file_id FROM chunks) AS has_chunks FROM files")
def has_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return resume.with_chunks(table(spark, sf, "files"), table(spark, sf, "chunks")).select("id", "has_chunks")


@query("SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count_if(ocr_used = 1) AS ocr_files, count_if(method LIKE 'error:%') AS errors, count_if(method = 'error:encrypted') AS encrypted, count_if(method = 'name-only' OR method LIKE 'error:%' OR method LIKE '%-partial') AS incomplete FROM files")
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    return resume.counters(table(spark, sf, "files"))


@query("SELECT id, status FROM (SELECT *, row_number() OVER (ORDER BY updated_at DESC, id) AS k FROM jobs) WHERE k <= 20")
def job_history_keep(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.keep_newest(table(spark, sf, "jobs"), 20).select("id", "status")


@query("SELECT id, CASE WHEN status IN ('queued', 'running', 'cancelling') THEN 'error' ELSE status END AS status FROM jobs")
def job_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.sweep_interrupted(table(spark, sf, "jobs")).select("id", "status")


# ---- vectors -----------------------------------------------------------------------------


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").orderBy("vec_id").limit(1).first().embedding]


_Q = "(SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"SELECT vec_id AS id, round(CAST(list_cosine_similarity(embedding, q) AS DOUBLE), 4) AS score FROM embeddings, {_Q} ORDER BY list_cosine_similarity(embedding, q) DESC, id LIMIT 10")
def vector_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = vector_search.exact_search(table(spark, sf, "embeddings"), _query_vector(spark, sf), 10, "vec_id")
    return hits.select("id", F.round(F.col("score").cast("double"), 4).alias("score"))


@query(
    "SELECT count_if(model = 'tiny-multi-64' AND len(embedding) = 64) AS compared, count_if(NOT (model = 'tiny-multi-64' AND len(embedding) = 64)) AS skipped,"
    " list_sort(list(DISTINCT model) FILTER (WHERE model <> 'tiny-multi-64'))[1:4] AS other_models FROM chunks WHERE embedding IS NOT NULL"
)
def vector_scan_stats(spark: SparkSession, sf: str) -> DataFrame:
    return vector_search.scan_statistics(table(spark, sf, "chunks"), "tiny-multi-64", 64)


@query("WITH m AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x))) AS top FROM embeddings) SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(round(CAST(x * CAST(127.0::FLOAT / top AS FLOAT) AS FLOAT)) AS INT)) AS code FROM m")
def vector_int8_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_search.codes(table(spark, sf, "embeddings"), "int8", id="vec_id")


_CENTRE_SQL = "(SELECT dim, avg(CAST(x AS DOUBLE)) AS mean FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY dim)"


@query(f"SELECT CAST(dim AS INT) AS dim, round(mean, 6) AS mean FROM {_CENTRE_SQL}")
def vector_centre(spark: SparkSession, sf: str) -> DataFrame:
    return vector_search.centre(table(spark, sf, "embeddings")).select("dim", F.round("mean", 6).alias("mean"))


_BIT_SQL = f"""
WITH x AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
     w AS (SELECT vec_id, dim // 32 AS w, CAST(sum(CASE WHEN x.x > c.mean THEN CAST(1 AS BIGINT) << CAST(dim % 32 AS INT) ELSE 0 END) AS BIGINT) AS v FROM x JOIN {_CENTRE_SQL} c USING (dim) GROUP BY vec_id, w),
     b AS (SELECT vec_id AS id, list(v ORDER BY w) AS code FROM w GROUP BY vec_id)
"""
_INT8_SQL = (
    "WITH m AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x))) AS top FROM embeddings),"
    " b AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(round(CAST(x * CAST(127.0::FLOAT / top AS FLOAT) AS FLOAT)) AS DOUBLE)) AS code FROM m)"
)
_RERANK_SQL = f"SELECT p.id, round(CAST(list_cosine_similarity(e.embedding, q) AS DOUBLE), 4) AS score FROM p JOIN embeddings e ON e.vec_id = p.id, {_Q} ORDER BY list_cosine_similarity(e.embedding, q) DESC, p.id LIMIT 10"


@query(_BIT_SQL + "SELECT * FROM b")
def vector_bit_codes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vector_search.codes(e, "bit", vector_search.centre_vector(e), id="vec_id")


def _fast(spark: SparkSession, sf: str, tier: str) -> DataFrame:
    """A quantised search whose codes are stored first, as an index holds them."""
    e = table(spark, sf, "embeddings")
    middle = vector_search.centre_vector(e) if tier == "bit" else None
    index = cut(vector_search.packed_codes(e, tier, middle, id="vec_id"))
    hits = vector_search.fast_search(e, index, _query_vector(spark, sf), 10, tier, middle, id="vec_id")
    return hits.select("id", F.round(F.col("score").cast("double"), 4).alias("score"))


@query(_INT8_SQL + ", p AS (SELECT b.id FROM b, (SELECT code AS c FROM b ORDER BY id LIMIT 1) ORDER BY 1 - list_cosine_similarity(code, c), b.id LIMIT 100) " + _RERANK_SQL)
def vector_fast_int8(spark: SparkSession, sf: str) -> DataFrame:
    return _fast(spark, sf, "int8")


@query(_BIT_SQL + ", p AS (SELECT b.id FROM b, (SELECT code AS c FROM b ORDER BY id LIMIT 1) ORDER BY list_sum(list_transform(list_zip(code, c), lambda z: bit_count(xor(z[1], z[2])))), b.id LIMIT 100) " + _RERANK_SQL)
def vector_fast_bit(spark: SparkSession, sf: str) -> DataFrame:
    return _fast(spark, sf, "bit")


@query("SELECT model, CAST(len(embedding) AS INT) AS dimensions, count(*) AS n FROM chunks WHERE embedding IS NOT NULL GROUP BY ALL")
def corpus_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return vector_search.corpus_dimensions(table(spark, sf, "chunks"))


@query("SELECT event_type, CAST(len(s) AS INT) AS n, s[1] AS best, s[len(s) // 2 + 1] AS median, s[len(s)] AS worst FROM (SELECT event_type, list_sort(list(value)) AS s FROM events WHERE value IS NOT NULL GROUP BY event_type)")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return vector_search.latency_summary(table(spark, sf, "events"), "event_type", "value")


@query("WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, CAST(dim AS INT) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM e GROUP BY label, dim")
def mean_pool_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return vision.mean_pool(table(spark, sf, "embeddings"), "label", "embedding").select("label", "dim", F.round("mean", 6).alias("mean"))


@query(
    "WITH v AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label), s AS (SELECT e.vec_id AS id, 'label ' || v.label AS tag, list_cosine_similarity(e.embedding, v.v) AS score FROM embeddings e, v)"
    " SELECT id, tag, round(CAST(score AS DOUBLE), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, tag) AS k FROM s WHERE score >= 0.22) WHERE k <= 8"
)
def tag_scores_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).orderBy("label").collect()  # a row a label
    return vision.score_tags(e, [(f"label {r.label}", list(r.v)) for r in first], "vec_id", "embedding").select("id", "tag", F.round("score", 4).alias("score"))


@query("WITH h AS (SELECT DISTINCT substr(sha1(text), 1, 16) AS h FROM documents WHERE text IS NOT NULL), q AS (SELECT h, CAST(('0x' || h) AS UBIGINT) AS v FROM h) SELECT a.h AS a, CAST(bit_count(xor(a.v, b.v)) AS INT) AS distance FROM q a, (SELECT min(h) AS h, CAST(('0x' || min(h)) AS UBIGINT) AS v FROM h) b")
def hash_hamming(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every document hash to the least one."""
    h = table(spark, sf, "documents").filter("text IS NOT NULL").select(F.substring(F.sha1("text"), 1, 16).alias("a")).distinct()
    least = h.agg(F.min("a")).first()[0]
    return h.select("a", vectors.phash_distance(F.col("a"), F.lit(least)).alias("distance"))


@query(
    "WITH h AS (SELECT min(doc_id) AS id, substr(sha1(text), 1, 16) AS h FROM documents WHERE text IS NOT NULL GROUP BY h), v AS (SELECT id, CAST(('0x' || h) AS UBIGINT) AS v FROM h),"
    " c AS (SELECT doc_id AS id, substr(sha1(text), 1, 16) AS h FROM documents WHERE text IS NOT NULL)"
    " SELECT a.id AS id_a, b.id AS id_b, CAST(bit_count(xor(a.v, b.v)) AS INT) AS distance FROM v a JOIN v b ON a.id < b.id AND bit_count(xor(a.v, b.v)) <= 3"
    " UNION ALL SELECT h.id, c.id, 0 FROM c JOIN h ON c.h = h.h AND c.id <> h.id"
)
def hash_near_pairs(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.substring(F.sha1("text"), 1, 16).alias("phash"))
    return vision.near_hashes(h)


# ---- media aggregation -------------------------------------------------------------------


@query("SELECT user_id AS video, event_type AS label, count(*) AS n, max(value) AS confidence FROM events WHERE value >= 0.5 GROUP BY user_id, event_type")
def objects_by_image(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumnRenamed("user_id", "video").withColumnRenamed("event_type", "label")
    return vision.objects_per_image(e, "video", "label", "value")


@query("SELECT user_id AS video, event_type AS label, count(*) AS n, max(value) AS confidence FROM events GROUP BY user_id, event_type")
def objects_by_video(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("video"), F.col("event_type").alias("label"), F.lit(1).alias("one"), "value")
    return vision.objects_per_video(e, "video", "label", "one", "value")


@query("SELECT user_id AS video, event_type AS tag, score, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS k FROM (SELECT user_id, event_type, max(value) AS score FROM events GROUP BY ALL)) WHERE k <= 3")
def tags_by_video(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("video"), F.col("event_type").alias("tag"), "value")
    return vision.tags_per_video(e, "video", "tag", "value", 3)


@query("SELECT user_id AS video, event_id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 5")
def faces_first_n(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumnRenamed("user_id", "video")
    return vision.first_faces(e, "video", "ts", "event_id", 5).select("video", "event_id", "rank")


@query("WITH g AS (SELECT l_orderkey AS k, list(l_linenumber ORDER BY l_linenumber) AS xs FROM lineitem GROUP BY l_orderkey) SELECT k, CASE WHEN len(xs) <= 4 THEN xs ELSE list_transform(range(0, 4), lambda i: xs[CAST(floor(i * len(xs) / 4) AS INT) + 1]) END AS picked FROM g")
def cap_evenly(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("xs"))
    return g.select("k", vectors.cap_evenly(F.col("xs"), 4).alias("picked"))


# ---- merging -----------------------------------------------------------------------------

_RUN_SQL = "(" + _NEWEST_SQL.replace("SELECT n.path FROM", "SELECT n.path, n.size, n.mtime, 'text' AS method FROM") + ")"


def _run(spark: SparkSession, sf: str) -> DataFrame:
    """A run's results: every new or changed path, processed to text."""
    todo = incremental.new_or_changed(table(spark, sf, "discovered"), incremental.stored_last(table(spark, sf, "files")))
    return todo.select("path", "size", "mtime", F.lit("text").alias("method"))


@query(f"SELECT coalesce(n.path, o.path) AS path, coalesce(n.method, o.method) AS method, n.path IS NOT NULL AS rewritten FROM {_STORED_SQL} o FULL JOIN {_RUN_SQL} n ON n.path = o.path")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Through a corpus: what is stored is committed, then the run's results are upserted."""
    corpus = Corpus(spark, f"{shared_dir(spark).rstrip('/')}/lamplight-corpus-{uuid.uuid4().hex}")
    corpus.commit(Change({"files": _stored(spark, sf), "chunks": table(spark, sf, "chunks").select("id", "file_id", "chunk_index", "page_start")}, {}))
    none = F.array().cast("array<struct<chunk_index:int,content:string,embedding:array<float>,model:string,page_start:int,page_end:int>>")
    corpus.upsert(_run(spark, sf).select("*", F.lit("").alias("name"), F.lit("").alias("content"), F.array().cast("array<string>").alias("tokens"), none.alias("chunks")), -1.0)
    return corpus.table("files").select("path", "method", F.coalesce(F.col("indexed_at") == -1, F.lit(False)).alias("rewritten"))


@query(
    f"SELECT o.path, CASE WHEN n.path IS NULL THEN 'kept' WHEN n.size = o.size AND trunc(n.mtime) = trunc(o.mtime) THEN 'carried' ELSE 'dropped' END AS fate,"
    f" CASE WHEN n.path IS NULL THEN o.attempts WHEN c.id IS NOT NULL THEN 0 ELSE o.attempts + 1 END AS attempts FROM {_STORED_SQL} o LEFT JOIN {_RUN_SQL} n ON n.path = o.path LEFT JOIN (SELECT DISTINCT file_id AS id FROM chunks) c ON c.id = o.id"
)
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """What an upsert without vision results does with stored vision rows, and the attempts it writes."""
    flags = resume.with_chunks(_stored(spark, sf), table(spark, sf, "chunks"))
    new = _run(spark, sf).select("path", F.col("size").alias("s1"), F.col("mtime").alias("m1"), F.col("method").alias("method1"))
    both = flags.join(new, "path", "left")
    moved = methods.changed(F.col("s1"), F.col("m1"), F.col("size"), F.col("mtime"))
    fate = F.when(F.col("s1").isNull(), "kept").when(~moved, "carried").otherwise("dropped")
    tried = methods.next_attempts(methods.complete(F.col("method1"), F.col("has_chunks")), moved, F.col("attempts"))
    return both.select("path", fate.alias("fate"), F.when(F.col("s1").isNull(), F.col("attempts")).otherwise(tried).cast("long").alias("attempts"))


# ---- general relational coverage ---------------------------------------------------------


def _sql(name: str, tables: str, spark_sql: str, duck: str | None = None) -> None:
    """A query both engines read as it stands; tables are views of the session under their own prefix."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        made = spark_sql
        for t in sorted(tables.split(), key=len, reverse=True):
            table(spark, sf, t).createOrReplaceTempView(f"lp_{t}")
            made = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 lp_{t}", made)
        return spark.sql(made)

    run.__name__ = name
    query(duck or spark_sql)(run)


_sql(
    "q1_pricing_summary", "lineitem",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n"
    " FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
)
_sql(
    "q3_shipping_priority", "customer orders lineitem",
    "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey"
    " WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
)
_sql(
    "q5_local_suppliers", "region nation customer orders lineitem supplier",
    "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey"
    " JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey WHERE r_name = 'ASIA' GROUP BY n_name",
)
_sql(
    "q6_revenue_change", "lineitem",
    "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
)
_sql("orders_cube", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("orders_rollup", "orders", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
_sql("customer_rank", "customer", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS place, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent FROM customer")
_sql("nations_without_suppliers", "nation supplier", "SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier")
_sql("nations_on_both_sides", "customer supplier", "SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_sql("customers_without_orders", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql(
    "events_tumbling", "events",
    "SELECT window.start AS start, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),"
    " g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s"
)
def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sessions(table(spark, sf, "events"), "ts", "30 minutes", ["user_id"]).select("user_id", "start", "n")


@query("SELECT p.event_id, max(v.ts) AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts <= p.ts GROUP BY p.event_id")
def events_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The last view of the same user before each purchase, by one ordered pass a user instead of a range join."""
    e = table(spark, sf, "events").filter("event_type IN ('purchase', 'view')")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(w)
    return e.withColumn("last_view", seen).filter("event_type = 'purchase'").select("event_id", "last_view")
