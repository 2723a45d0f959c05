"""Full-text search with BM25, snippets, fuzzy names and folders of matches."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamplight.functions.stemming import query_terms
from lamplight.functions.text import fts_tokenizer, fts_tokens, let
from lamplight.session import cut, free, read_text, write_text

K1, B = 1.2, 0.75
SEARCHED = ("name", "path", "content", "tokens")


#: Results of a search, at most.
MOST = 100


def clamp_limit(limit: int) -> int:
    return max(1, min(MOST, limit))


def _tokens(docs: DataFrame) -> Column:
    """Tokens of all searched columns that docs has."""
    return F.concat(*(fts_tokens(c) for c in SEARCHED if c in docs.columns))


def match_terms(query: str, abbreviations: Mapping[str, list[str]] | None = None) -> list[str]:
    """Index terms of a query; none for a blank one, which matches nothing."""
    return query_terms(query, abbreviations=abbreviations)


def term_frequencies(docs: DataFrame, terms: list[str], id: str = "id") -> DataFrame:
    """(id, length, f): token count of each document and, by term, how often it occurs.

    One pass without shuffle; no postings are needed for a single query.
    """
    of = lambda ts, w: F.size(F.filter(ts, lambda x: x == w))
    count = lambda ts: F.array(*(of(ts, w) for w in terms)) if terms else F.array().cast("array<int>")
    made = let(_tokens(docs), lambda ts: F.struct(F.size(ts).alias("length"), count(ts).alias("f")))
    # the explode of one element keeps later expressions from computing the tokens again
    return docs.select(F.col(id).alias("id"), F.explode(F.array(made)).alias("m")).select("id", "m.length", "m.f")


def bm25_score(f: Column, length: Column, idf: list[float], mean: float) -> Column:
    """Sum over terms, in the order of the terms."""
    total = F.lit(0.0)
    for k, w in enumerate(idf):
        tf = f[k].cast("double")
        total = total + F.lit(w) * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length / F.lit(mean)))
    return total


def bm25(docs: DataFrame, terms: list[str], id: str = "id", k: int = 20) -> DataFrame:
    """(id, score) of the k best documents holding any term; ties to the lower id.

    idf is floored at 1e-6 for terms in more than half of the documents. Null columns count as
    empty; no terms and no documents give no rows. The first pass brings four numbers and one
    count a term to the driver; the second, over what the first wrote, keeps k rows a task.
    """
    tf = term_frequencies(docs, terms, id)
    if terms:
        tf = cut(tf)  # a few numbers a document, read twice
    else:
        return tf.select("id", F.lit(0.0).alias("score")).limit(0)
    n, mean, *df = tf.agg(F.count("*"), F.avg("length"), *(F.count_if(F.col("f")[i] > 0) for i in range(len(terms)))).first()
    idf = [bm25_idf(n, d) for d in df] if n else [0.0] * len(terms)
    hit = tf.filter(F.exists("f", lambda x: x > 0))
    return hit.select("id", bm25_score(F.col("f"), F.col("length"), idf, mean or 1.0).alias("score")).orderBy(F.desc("score"), "id").limit(k)


POSTINGS = "term string, file_id long, tf int, length int"


def postings_of(docs: DataFrame, id: str = "id") -> DataFrame:
    """(term, file_id, tf, length) of every searched column that docs has, counted document by document.

    length is that of the document, in tokens. A document is one Arrow row, so nothing is shuffled;
    null columns count as empty, and documents without tokens have no postings. The tokens are those of
    functions.text.fts_tokens.
    """
    own = [c for c in SEARCHED if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = fts_tokenizer()
        for b in batches:
            terms, ids, tfs, lengths = [], [], [], []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f = Counter(t for c in row[1:] if c for t in tokens(c))
                terms += f.keys()
                tfs += f.values()
                ids += [row[0]] * len(f)
                lengths += [f.total()] * len(f)
                if len(terms) > 200_000:
                    yield _postings(terms, ids, tfs, lengths)
                    terms, ids, tfs, lengths = [], [], [], []
            yield _postings(terms, ids, tfs, lengths)

    return docs.select(F.col(id).cast("long"), *own).mapInArrow(run, POSTINGS)


def _postings(terms: list, ids: list, tfs: list, lengths: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ids, pa.int64()), pa.array(tfs, pa.int32()), pa.array(lengths, pa.int32())], names=["term", "file_id", "tf", "length"])


#: Of stored indexes; another number where their files change.
FORMAT = 2
#: Postings a file of an index holds, about.
FILE_POSTINGS = 500_000


def write_postings(postings: DataFrame, path: str) -> None:
    """Sorted by term, one file a range of terms, with bloom filters: a query opens the files and row
    groups of its terms only. A term of very many documents spans several files."""
    staged = cut(postings)
    n = staged.count() // FILE_POSTINGS + 1
    ranged = staged.repartitionByRange(n, "term", "file_id") if n > 1 else staged.coalesce(1)
    ranged.sortWithinPartitions("term", "file_id").write.option("parquet.bloom.filter.enabled#term", "true").option("parquet.block.size", str(16 << 20)).parquet(path)
    free(staged)


def bm25_idf(n: int, d: int) -> float:
    """Weight of a term that d of n documents hold; floored where it would not be positive."""
    x = math.log((n - d + 0.5) / (d + 0.5))
    return x if x > 0 else 1e-6


def search_postings(postings: DataFrame, documents: int, tokens: int, queries: list[tuple[str, list[str]]], k: int = 20) -> DataFrame:
    """(query, id, score, rank) of several queries over stored postings; as bm25 otherwise.

    documents and tokens: how many all documents are and hold. Only the postings of the queries' terms
    are read; a row a term comes to the driver.
    """
    spark = postings.sparkSession
    terms = sorted({t for _, ts in queries for t in ts})
    if not terms or not documents:
        return spark.createDataFrame([], "query string, id long, score double, rank int")
    mine = postings.filter(F.col("term").isin(terms))
    df = {r.term: r.n for r in mine.groupBy("term").agg(F.count("*").alias("n")).collect()}
    weights = [(q, t, bm25_idf(documents, df[t])) for q, ts in queries for t in ts if t in df]
    w = spark.createDataFrame(weights or [("", "", 0.0)], "query string, term string, idf double")
    tf, mean = F.col("tf").cast("double"), max(tokens, 1) / documents
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * F.col("length") / F.lit(mean)))
    scored = mine.join(F.broadcast(w), "term").groupBy("query", F.col("file_id").alias("id")).agg(F.sum(part).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def folders_of(postings: DataFrame, folders: DataFrame, terms: list[str], folder: str = "dir", k: int = 10) -> DataFrame:
    """(folder, n) of the documents that hold a term; folders: (id, folder)."""
    hit = postings.filter(F.col("term").isin(terms)).select(F.col("file_id").alias("id")).distinct()
    return folders.select("id", folder).join(hit, "id", "left_semi").groupBy(folder).agg(F.count("*").alias("n")).orderBy(F.desc("n"), folder).limit(k)


class SearchIndex:
    """An inverted index in a folder, of any documents; the statistics, written last, say it is whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        return read_text(self.spark, f"{self.path}/statistics") is not None

    def drop(self) -> None:
        for name in ("statistics", "postings"):
            fs, p = self._fs(name)
            fs.delete(p, True)

    def write(self, docs: DataFrame, id: str = "id") -> None:
        self.drop()
        write_postings(postings_of(docs, id), f"{self.path}/postings")
        tokens = self.postings().agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
        write_text(self.spark, f"{self.path}/statistics", f"{docs.count()} {tokens}")

    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def statistics(self) -> tuple[int, int]:
        documents, tokens = read_text(self.spark, f"{self.path}/statistics").split()
        return int(documents), int(tokens)

    def search(self, queries: list[tuple[str, list[str]]], k: int = 20) -> DataFrame:
        return search_postings(self.postings(), *self.statistics(), queries, k)


def snippet(content: Column | str, terms: list[str], tokens: int = 12) -> Column:
    """The window of so many tokens with most distinct terms (the earliest on ties), terms in [ ],
    an ellipsis where text is left out. For the few winners of a search."""
    import re

    from lamplight.functions.stemming import drop_marks

    wanted = frozenset(terms)
    dropped = lambda w: drop_marks(w.lower())

    @F.pandas_udf("string")
    def cut(texts):
        def one(t):
            if t is None:
                return None
            spans = [(m.start(), m.end(), dropped(m.group()) in wanted and dropped(m.group())) for m in re.finditer(r"\w+", t)]
            if not spans:
                return ""
            best = max(range(max(1, len(spans) - tokens + 1)), key=lambda i: (len({s[2] for s in spans[i : i + tokens] if s[2]}), -i))
            own = spans[best : best + tokens]
            out, at = [], own[0][0]
            for a, b, hit in own:
                out += [t[at:a], f"[{t[a:b]}]" if hit else t[a:b]]
                at = b
            return (" … " if best else "") + "".join(out) + (" … " if best + tokens < len(spans) else "")

        return texts.map(one)

    return cut(F.col(content) if isinstance(content, str) else content)


def jaro_winkler(query: str, names: list[str]) -> np.ndarray:
    """Jaro similarity of the query to each name, raised by a common prefix of up to four characters; 1 for
    two equal strings, 0 where one is empty.

    Names of like length are scored at once, CELLS characters a block.
    """
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    out, by, i = np.zeros(len(names)), np.argsort(lengths, kind="stable"), 0
    while i < len(by):
        j = i + 1
        while j < len(by) and lengths[by[j]] * (j + 1 - i) <= CELLS:
            j += 1
        out[by[i:j]] = _jaro_winkler(query, [names[k] for k in by[i:j]])
        i = j
    return out


#: Characters of names that are scored at once.
CELLS = 1 << 20


def _jaro_winkler(query: str, names: list[str]) -> np.ndarray:
    """For each character of the query, the first free equal character within reach is taken in every name."""
    n, la = len(names), len(query)
    lb = np.fromiter(map(len, names), np.int64, n)
    width = int(lb.max(initial=0))
    if not la or not width:
        return np.array([float(x == query) for x in names])
    raw = np.frombuffer("".join(x.ljust(width, "\0") for x in names).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)
    q = np.frombuffer(query.encode("utf-32-le", "surrogatepass"), np.uint32)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    at = np.arange(width)[None, :]
    inside, taken = at < lb[:, None], np.zeros((n, width), bool)
    matched = np.zeros((n, la), bool)
    for i in range(la):
        free = (raw == q[i]) & inside & ~taken & (np.abs(at - i) <= reach)
        hit = free.any(axis=1)
        taken[np.flatnonzero(hit), free[hit].argmax(axis=1)] = True
        matched[:, i] = hit
    m = matched.sum(axis=1)
    # matched characters of both sides, in their own order, moved to the front
    mine = np.where(np.arange(la)[None, :] < m[:, None], np.take_along_axis(np.broadcast_to(q, (n, la)), np.argsort(~matched, axis=1, kind="stable"), 1), 0)
    theirs = np.take_along_axis(raw, np.argsort(~taken, axis=1, kind="stable"), 1)
    k = min(la, width)
    swaps = ((mine[:, :k] != theirs[:, :k]) & (np.arange(k)[None, :] < m[:, None])).sum(axis=1) // 2
    with np.errstate(all="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - swaps) / m) / 3, 0.0)
    p = min(4, k)
    prefix = np.cumprod((raw[:, :p] == q[:p]) & inside[:, :p], axis=1).sum(axis=1)
    out = jaro + 0.1 * prefix * (1 - jaro)
    return np.where(np.fromiter((x == query for x in names), bool, n), 1.0, out)


def fuzzy_names(names: DataFrame, query: str, name: str = "name", id: str = "id", k: int = 20) -> DataFrame:
    """(id, name, score) of the k names most like the query, case ignored; null names stay out."""
    q = query.lower()

    @F.pandas_udf("double")
    def score(s):
        import pandas as pd

        return pd.Series(jaro_winkler(q, s.tolist()))

    rows = names.filter(F.col(name).isNotNull()).select(F.col(id).alias("id"), F.col(name).alias("name"))
    return rows.withColumn("score", score(F.lower("name"))).orderBy(F.desc("score"), "id").limit(k)


def fuzzy_hits(names: DataFrame, query: str, k: int = 20) -> DataFrame:
    """The names most like the query as search results."""
    near = fuzzy_names(names, query, k=k)
    return near.select("id", "score", F.concat(F.lit("~"), F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("% name match")).alias("snippet"))


def top_folders(docs: DataFrame, terms: list[str], folder: str = "dir", k: int = 10) -> DataFrame:
    """(folder, n): where the matching documents are, most first, ties by name."""
    hit = docs.filter(F.arrays_overlap(_tokens(docs), F.array(*(F.lit(t) for t in terms)))) if terms else docs.limit(0)
    return hit.groupBy(folder).agg(F.count("*").alias("n")).orderBy(F.desc("n"), folder).limit(k)


def search(docs: DataFrame, query: str, k: int = 20, fuzzy: bool = False, abbreviations: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(id, score, snippet) of a text query over docs (id, name, path, content, ...).

    Where nothing matches and fuzzy is set, names most like the query, with their likeness.
    """
    terms = match_terms(query, abbreviations)
    hits = bm25(docs, terms, k=k)
    if fuzzy and not hits.take(1):
        return fuzzy_hits(docs, query, k)
    text = docs.select("id", "content").join(F.broadcast(hits), "id")  # at most k rows
    return text.select("id", "score", snippet("content", terms).alias("snippet")).orderBy(F.desc("score"), "id")
