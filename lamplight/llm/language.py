"""Language of documents and of stretches of mixed documents.

Hierarchical discrimination: linear support vector machines tell the language family first,
then one-versus-one machines separate the languages within it. Features are character
n-grams of single words, so a word's margins add up and a worker scores each distinct word
once. The machines learn from a bounded sample of labelled texts.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Family of each language; any other language is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ru": "slavic", "uk": "slavic", "vi": "vietic"}
#: ISO 639-2 codes and English names of labels.
SPELLINGS = {
    "en": "eng english", "de": "deu ger german", "fr": "fra fre french", "es": "spa spanish", "ru": "rus russian", "vi": "vie vietnamese", "mixed": "mul multilingual",
}
#: Labelled texts the machines learn from, at most, of each language.
SAMPLES_PER_LANGUAGE, SENTENCES_PER_LANGUAGE = 400, 500
#: Share of a file's text from which a language counts as one of the file.
SHARE = 0.1
#: A unit of fewer words, or decided with less confidence, follows its neighbours; so does a
#: stretch whose firm units have fewer words than STRETCH_WORDS together, unless its language has as many in
#: all such stretches of the text, SHARE of its firm words, and the confidence POOLED on average. Only units
#: of which a share KNOWN of the words is in samples of the language count there: names look like any language.
LEAST_WORDS, LEAST_CONFIDENCE, STRETCH_WORDS, POOLED, KNOWN = 4, 0.7, 9, 0.9, 0.3
DIMENSIONS = 1 << 14

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*").findall
_UNIT = re.compile(r".*?(?:[.!?…:][\"”»)]*(?=\s|$)|\n[ \t]*\n|$)", re.S)
_ADDRESS = re.compile(r"\S+@\S+|https?://\S+|\[attachment:[^\]]*\]|^(?:Subject|From|To|Cc|Date):", re.M)


def features(word: str) -> list[int]:
    w = f"^{word}$"
    grams = [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)] + [w]
    return [xxhash.xxh32_intdigest(g) % DIMENSIONS for g in grams if g not in "^$"]


def units(text: str) -> list[tuple[int, int]]:
    """Spans of sentences and lines that together cover the text."""
    return [m.span() for m in _UNIT.finditer(text) if m.end() > m.start()]


def words_of(text: str) -> list[str]:
    return _WORD(_ADDRESS.sub(" ", text).lower())


def train_svm(x: np.ndarray, y: np.ndarray, steps: int = 200, reg: float = 1e-4, rows: np.ndarray | None = None, gram: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Linear support vector machine for labels -1 and 1: accelerated ascent of its dual,
    both labels weighing the same.

    rows: those of x that y labels (all); gram: products of all rows of x, where several machines share them.
    """
    n = len(y)
    rows = np.arange(n) if rows is None else rows
    gram = x @ x.T if gram is None else gram
    q = (gram[np.ix_(rows, rows)].astype(np.float64) + 0.01) * np.outer(y, y)  # each row has a constant 0.1 besides
    upper = np.where(y > 0, 1 / (2 * reg * max(1, (y > 0).sum())), 1 / (2 * reg * max(1, (y < 0).sum())))
    v = np.ones(n)
    for _ in range(20):
        v = q @ v
        v /= np.linalg.norm(v) or 1.0
    rate = 1 / max(1.2 * np.linalg.norm(q @ v), 1e-9)
    alpha = ahead = np.zeros(n)
    for k in range(steps):
        new = np.clip(ahead + rate * (1 - q @ ahead), 0, upper)
        alpha, ahead = new, new + k / (k + 3) * (new - alpha)
    weight = np.zeros(len(x))
    weight[rows] = alpha * y
    return weight @ x, float(weight.sum() * 0.01)


@dataclass
class Model:
    """Weights of fixed size: one column a machine; languages, families and their machines."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray
    words: dict[str, frozenset[str]] = field(default_factory=dict)
    scale: float = 8.0
    memo: dict[str, int] = field(default_factory=dict)

    def margins(self, sums: np.ndarray, grams: np.ndarray) -> np.ndarray:
        return sums / np.maximum(grams, 1)[:, None] + self.bias

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and confidence of each row: the best family, then its duels."""
        nf = len(self.families)
        z = np.exp(self.scale * (margins[:, :nf] - margins[:, :nf].max(axis=1, keepdims=True)))
        family_p = z / z.sum(axis=1, keepdims=True)
        best = margins[:, :nf].argmax(axis=1)
        lang, conf = np.zeros(len(margins), np.int64), family_p[np.arange(len(margins)), best]
        for f, name in enumerate(self.families):
            own = [k for k, x in enumerate(self.languages) if FAMILIES.get(x, x) == name]
            rows = np.flatnonzero(best == f)
            votes = np.zeros((len(rows), len(own)))
            least = np.full((len(rows), len(own)), 1.0)
            for j, (a, b) in enumerate(self.pairs):
                ka, kb = self.languages.index(a), self.languages.index(b)
                if ka in own:
                    p = 1 / (1 + np.exp(-2 * self.scale * margins[rows, nf + j]))
                    for k, q in ((own.index(ka), p), (own.index(kb), 1 - p)):
                        votes[:, k] += (q > 0.5) + 1e-3 * q
                        least[:, k] = np.minimum(least[:, k], q)
            top = votes.argmax(axis=1)
            lang[rows] = np.array(own)[top]
            conf[rows] *= least[np.arange(len(rows)), top]
        return lang, conf


def _matrix(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, t in enumerate(texts):
        for w in words_of(t):
            np.add.at(x[i], features(w), 1)
    return x / np.maximum(x.sum(axis=1, keepdims=True), 1)


def train(samples: list[tuple[str, str]]) -> Model:
    """From (language, text) pairs; each sentence is an example, the first SENTENCES_PER_LANGUAGE of each language."""
    examples, counts = [], Counter()
    for lang, t in samples:
        for a, b in units(t):
            if counts[lang] < SENTENCES_PER_LANGUAGE and len(words_of(t[a:b])) >= LEAST_WORDS:
                counts[lang] += 1
                examples.append((lang, t[a:b]))
    langs = sorted({x for x, _ in examples})
    families = sorted({FAMILIES.get(x, x) for x in langs})
    pairs = [(a, b) for a, b in itertools.combinations(langs, 2) if FAMILIES.get(a, a) == FAMILIES.get(b, b)]
    x, label = _matrix([t for _, t in examples]), np.array([x for x, _ in examples])
    family = np.array([FAMILIES.get(v, v) for v in label])

    gram = x @ x.T

    def fit(rows: np.ndarray) -> Model:
        made = [train_svm(x, np.where(family[rows] == f, 1.0, -1.0), rows=rows, gram=gram) for f in families]
        for a, b in pairs:
            own = rows[(label[rows] == a) | (label[rows] == b)]
            made.append(train_svm(x, np.where(label[own] == a, 1.0, -1.0), rows=own, gram=gram))
        return Model(langs, families, pairs, np.stack([w for w, _ in made], axis=1).astype(np.float32), np.array([b for _, b in made]))

    # The scale of the confidence is the one under which held-out halves are likeliest.
    model = fit(np.arange(len(label)))
    model.words = {v: frozenset(w for x, t in examples if x == v for w in words_of(t)) for v in langs}
    loss = dict.fromkeys((1, 2, 4, 8, 16, 32), 0.0)
    for k in range(2):
        half = fit(np.flatnonzero(np.arange(len(label)) % 2 == k))
        out = np.flatnonzero(np.arange(len(label)) % 2 != k)
        margins = x[out] @ half.weights + half.bias
        for half.scale in loss:
            lang, conf = half.decide(margins)
            right = np.array(langs)[lang] == label[out]
            loss[half.scale] -= np.log(np.clip(np.where(right, conf, 1 - conf), 1e-6, 1)).sum()
    model.scale = min(loss, key=loss.get)
    return model


class Scorer(dict):
    """Distinct word to its row of summed weights; a worker fills it as words come."""

    def __init__(self, model: Model):
        self.model = model
        self.rows = np.zeros((1024, model.weights.shape[1] + 1))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        f = features(word)
        self.rows[at, :-1], self.rows[at, -1] = self.model.weights[f].sum(axis=0), len(f)
        self[word] = at
        return at

    def pooled(self, firm: list[int], lang: np.ndarray, conf: np.ndarray, n: np.ndarray, words: Callable[[int], list[str]]) -> set[int]:
        """Languages that a text holds in short stretches: enough words together, of units that are no mere names."""
        total, count, sure = sum(int(n[k]) for k in firm), Counter(), Counter()
        for k in firm:
            mine = self.model.words.get(self.model.languages[int(lang[k])], frozenset())
            own = words(k)
            if sum(w in mine for w in own) >= KNOWN * len(own):
                count[int(lang[k])] += int(n[k])
                sure[int(lang[k])] += float(conf[k]) * int(n[k])
        return {x for x, m in count.items() if m >= max(STRETCH_WORDS, SHARE * total) and sure[x] >= POOLED * m}

    def stretches(self, texts: list[str | None], form: Callable[[str], str] = lambda t: t) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, language, confidence) of each text's stretches; none without words. form is what a
        unit is read as; offsets are those of the text."""
        if len(self) > 300_000:
            self.clear()
        flat: list[int] = []
        counts: list[int] = []
        spans: list[list[tuple[int, int]]] = []
        for t in texts:
            own = units(t) if t else []
            spans.append(own)
            for a, b in own:
                before = len(flat)
                flat.extend(map(self.__getitem__, words_of(form(t[a:b]))))
                counts.append(len(flat) - before)
        n = np.array(counts, np.int64)
        cum = np.concatenate([np.zeros((1, self.rows.shape[1])), np.cumsum(self.rows[np.array(flat, np.int64)], axis=0)])
        stop = np.cumsum(n)
        sums = cum[stop] - cum[stop - n] if len(n) else cum[:0]
        lang, conf = self.model.decide(self.model.margins(sums[:, :-1], sums[:, -1])) if len(n) else (n, n)
        sure = (n >= LEAST_WORDS) & (conf >= LEAST_CONFIDENCE)
        out, at = [], 0
        names = self.model.languages
        for text, own in zip(texts, spans, strict=True):
            rows = range(at, at + len(own))
            at += len(own)
            if not any(n[k] for k in rows):
                out.append([])
                continue
            firm = [k for k in rows if sure[k]]
            if not firm:  # no unit is firm: the text as one
                s = sums[rows.start : rows.stop].sum(axis=0, keepdims=True)
                one, c = self.model.decide(self.model.margins(s[:, :-1], s[:, -1]))
                out.append([(own[0][0], own[-1][1], names[int(one[0])], float(c[0]))])
                continue
            if len({int(lang[k]) for k in firm}) > 1:  # short stretches give way to longer ones
                runs = [list(g) for _, g in itertools.groupby(firm, key=lambda k: int(lang[k]))]
                pooled = self.pooled(firm, lang, conf, n, lambda k: words_of(form(text[own[k - rows.start][0] : own[k - rows.start][1]])))  # noqa: B023
                long = [g for g in runs if int(lang[g[0]]) in pooled or sum(int(n[k]) for k in g) >= STRETCH_WORDS]
                firm = [k for g in long or [max(runs, key=lambda g: sum(int(n[k]) for k in g))] for k in g]
            keep = set(firm)
            made: list[list] = []
            last = int(lang[firm[0]])
            for k, (a, b) in zip(rows, own, strict=True):
                if k in keep:
                    last = int(lang[k])
                if made and made[-1][2] == last:
                    made[-1][1] = b
                else:
                    made.append([a, b, last, 0.0, 0])
                if k in keep:
                    made[-1][3] += float(conf[k]) * (b - a)
                    made[-1][4] += b - a
            out.append([(a, b, names[x], c / w) for a, b, x, c, w in made])
        return out


def learn(samples: DataFrame) -> Model:
    """Train on at most SAMPLES_PER_LANGUAGE texts of each language, the lowest sample_id first."""
    from pyspark.sql import Window

    first = Window.partitionBy("lang").orderBy("sample_id")
    some = samples.filter("lang is not null and text is not null").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= SAMPLES_PER_LANGUAGE)
    return train([(r.lang, r.text) for r in some.orderBy("lang", "k").select("lang", "text").collect()])


_STRETCH = "array<struct<start:int,stop:int,lang:string,confidence:double>>"


def with_stretches(df: DataFrame, text: str, model: Model, out: str = "stretches") -> DataFrame:
    """df with the stretches of column text: start and stop (code points), language, confidence.

    Null, empty and wordless texts have an empty list. No shuffle; an existing out is replaced.
    """
    from lamplight.llm.lookalike import TOUCHED, canonical

    kept = [c for c in df.columns if c != out]
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few hundred kB, whatever the corpus
    schema = df.select(*kept).schema.add(out, _parsed(_STRETCH))
    touched = re.compile(TOUCHED).search

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, known = Scorer(shared.value), {}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                found = score.stretches(b.column(len(kept)).to_pylist(), lambda t: canonical(t, known) if touched(t) else t)
                made = [[dict(zip(("start", "stop", "lang", "confidence"), s, strict=True)) for s in x] for x in found]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, kind)], names=[*kept, out])

    return df.select(*kept, df[text].alias("__text")).mapInArrow(run, schema)


def _parsed(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(f"x {ddl}")["x"].dataType


def label_column(label: str):
    """The language a label names, whatever its spelling; null for none (null, empty, und)."""
    primary = F.regexp_extract(F.lower(F.trim(F.col(label))), r"^(\p{L}+)", 1)
    spelt = F.create_map(*(F.lit(x) for code, names in SPELLINGS.items() for name in names.split() for x in (name, code)))
    known = F.coalesce(spelt[primary], primary)
    return F.when(F.col(label).isNull() | primary.isin("", "und", "none", "null", "unknown"), None).otherwise(known)


def file_languages(chunks: DataFrame, model: Model) -> DataFrame:
    """(file_id, lang, chars, share, confidence) of files with words; a chunk stored twice counts once."""
    s = with_stretches(chunks.filter("file_id is not null").select("file_id", "chunk_index", "content"), "content", model)
    s = s.select("file_id", "chunk_index", F.explode("stretches").alias("s"))
    chars = (F.col("s.stop") - F.col("s.start")).cast("double")
    s = s.groupBy("file_id", "chunk_index", F.col("s.lang").alias("lang"), F.col("s.start").alias("start")).agg(F.max(chars).alias("chars"), F.max("s.confidence").alias("confidence"))
    by = s.groupBy("file_id", "lang").agg(F.sum("chars").alias("chars"), (F.sum(F.col("confidence") * F.col("chars")) / F.sum("chars")).alias("confidence"))
    total = by.groupBy("file_id").agg(F.sum("chars").alias("total"))
    return by.join(total, "file_id").select("file_id", "lang", "chars", (F.col("chars") / F.col("total")).alias("share"), "confidence")


def mislabelled(files: DataFrame, chunks: DataFrame, model: Model, share: float = SHARE) -> DataFrame:
    """(file_id, lang): files whose label is missing or not the true language, one row per language
    of at least the share. Two such languages make the true label mixed. Files without chunks or
    words are none; a file id stored twice is judged by each of its labels and comes out once."""
    langs = file_languages(chunks, model).filter(F.col("share") >= share).groupBy("file_id").agg(F.collect_set("lang").alias("langs"))
    true = F.when(F.size("langs") > 1, "mixed").otherwise(F.element_at("langs", 1))
    found = files.select(F.col("id").alias("file_id"), label_column("lang").alias("label")).join(langs, "file_id").filter(~F.col("label").eqNullSafe(true))
    return found.select("file_id", F.explode("langs").alias("lang")).distinct()
