"""The pN_ queries of this folder; each takes (spark, sf_dir) and covers its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.session import anti_join, semi_join, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from lamplight.llm.language import learn, mislabelled

    return mislabelled(table(spark, sf, "files"), table(spark, sf, "chunks"), learn(table(spark, sf, "lang_samples")))


def p1_files(spark: SparkSession, sf: str) -> DataFrame:
    from lamplight.llm.language import file_languages, learn

    return file_languages(table(spark, sf, "chunks"), learn(table(spark, sf, "lang_samples")))


def p1_stretches(spark: SparkSession, sf: str) -> DataFrame:
    from lamplight.llm.language import learn, with_stretches

    chunks = table(spark, sf, "chunks").select("id", "content")
    found = with_stretches(chunks, "content", learn(table(spark, sf, "lang_samples")))
    return found.select("id", F.explode("stretches").alias("s")).select("id", "s.*")


def _email_chunks(spark: SparkSession, sf: str) -> DataFrame:
    mails = table(spark, sf, "files").filter("method = 'email'").select(F.col("id").alias("file_id"))
    chunks = table(spark, sf, "chunks").select(F.col("id").alias("chunk_id"), "file_id", "content")
    return semi_join(chunks, mails, "file_id").select("chunk_id", "content")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from lamplight.llm.email import learn, line_labels

    lines = line_labels(_email_chunks(spark, sf), "chunk_id", "content", learn(table(spark, sf, "lang_samples")))
    return lines.filter("label in ('quoted', 'signature', 'notice')").select("chunk_id", "line_no")


def p2_new_text(spark: SparkSession, sf: str) -> DataFrame:
    from lamplight.llm.email import learn, with_new_text

    return with_new_text(_email_chunks(spark, sf), "content", learn(table(spark, sf, "lang_samples"))).select("chunk_id", "new_text", "header")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    from lamplight.llm.tokenizer import with_token_ids

    return with_token_ids(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    from lamplight.llm.tokenizer import with_token_count

    return with_token_count(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def p9_windows(spark: SparkSession, sf: str) -> DataFrame:
    from lamplight.llm.packing import pack

    return pack(p8_counts(spark, sf), "doc_id", "n_tokens")


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    from lamplight.llm.splitting import split_documents

    return split_documents(table(spark, sf, "documents"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the splitter cuts: each has exactly one piece 0."""
    return p10_pieces(spark, sf).filter(F.col("piece_no") == 0).select("doc_id")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """(tbl, id, text) of file names and chunk contents."""
    files = table(spark, sf, "files").select(F.lit("files").alias("tbl"), "id", F.col("name").alias("text"))
    return files.unionByName(table(spark, sf, "chunks").select(F.lit("chunks").alias("tbl"), "id", F.col("content").alias("text")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from lamplight.llm.neighbours import similar_pairs, usable

    pairs = similar_pairs(usable(table(spark, sf, "chunks")))
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p4_knn(spark: SparkSession, sf: str) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 100, against all rows."""
    from lamplight.llm.neighbours import nearest, usable

    vectors = usable(table(spark, sf, "chunks"))
    return nearest(vectors, vectors.filter("id % 100 = 0"))


def _repair(spark: SparkSession, sf: str):
    from lamplight.llm.scans import repair

    scanned = table(spark, sf, "files").filter("ocr_used = 1").select(F.col("id").alias("file_id"))
    chunks = table(spark, sf, "chunks").select(F.col("id").alias("chunk_id"), "file_id", F.col("chunk_index").alias("page"), "content")
    return repair(semi_join(chunks, scanned, "file_id"), anti_join(chunks, scanned, "file_id"), table(spark, sf, "lang_samples"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _repair(spark, sf).found()


def p5_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _repair(spark, sf).paragraphs()


def p6_restored(spark: SparkSession, sf: str) -> DataFrame:
    from lamplight.llm.encoding import damaged_rows, learn

    rows = _texts(spark, sf)
    return damaged_rows(rows, learn(rows))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_restored(spark, sf).select("tbl", "id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    from lamplight.llm.lookalike import lookalike_pairs

    return lookalike_pairs(_texts(spark, sf))


def p7_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The same links as p7_found as membership: what a group of very many copies needs."""
    from lamplight.llm.lookalike import lookalike_classes

    return lookalike_classes(_texts(spark, sf))


def p7_forms(spark: SparkSession, sf: str) -> DataFrame:
    from lamplight.llm.lookalike import with_form

    return with_form(_texts(spark, sf), "text", "form").select("tbl", "id", "form")


QUERIES = {f.__name__: f for f in (p1_found, p1_files, p1_stretches, p2_found, p2_new_text, p4_found, p4_knn, p5_found, p5_paragraphs, p6_found, p6_restored, p7_found, p7_classes, p7_forms, p8_ids, p8_counts, p9_windows, p10_found, p10_pieces)}
#: Brute force where SQL can express a query and is quick enough over whole tables.
SQL: dict[str, str] = {
    "p4_found": """
WITH v AS (SELECT id, coalesce(model, '') AS model, embedding FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = dimensions AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.embedding, b.embedding) AS c FROM v a JOIN v b ON a.model = b.model AND len(a.embedding) = len(b.embedding) AND a.id <> b.id),
     r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE k <= 10 AND c >= 0.9
""",
}
