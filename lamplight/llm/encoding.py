"""Finding and restoring text that was decoded with a wrong character encoding.

A first pass counts distinct tokens with non-ASCII characters. Rare tokens are joined with
their clean near-twins (the most frequent token) on what is left without non-ASCII
characters; aligning the two gives runs that stand for each other, and each run pair votes
for the transformations (read as one encoding, truly another) that explain it. Pairs that none
explains become mappings of their own, where enough tokens agree. Tokens
without ASCII letters have nothing to join on and are joined with the frequent token that a
transformation yields. Transformations with enough votes, an alphabet and character-pair
counts, all of bounded size, then go over every record in a second pass.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamplight.llm.lookalike import canonical
from lamplight.session import cut

#: Encodings that text is taken for, and what single bytes may truly be then.
READ_AS = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp1250", "cp1258", "mac_cyrillic")
BYTES = {
    "cp1252": ("cp1251", "cp437", "cp850", "cp866", "koi8_r", "mac_roman"), "cp1251": ("cp1252", "koi8_r", "cp866", "mac_cyrillic", "cp437"), "koi8_r": ("cp1251", "cp866"),
    "cp437": ("cp1252", "cp866"), "cp850": ("cp1252",), "cp866": ("cp1251",), "mac_roman": ("cp1252",), "mac_cyrillic": ("cp1251",), "cp1250": ("cp1252",),
}
#: Distinct rare tokens that must vote for a transformation, by so many pairs of runs.
LEAST_VOTES, LEAST_PAIRS = 5, 3
#: A mapping learned from alignment: share of all tokens' votes it needs, share of the alignments of its
#: run that agree, and share of the tokens with its run that have such a twin at all.
MAPPING_SHARE, AGREED, COVERED = 1e-5, 0.9, 0.5
#: A clean twin is at least so many times as frequent.
TWIN_RATIO = 4
#: Share of all counted tokens that a character needs to belong to the alphabet.
ALPHABET_SHARE = 1e-5
#: Rise of the mean log count of character pairs that restoring a token must bring.
RISE_UTF8, RISE_BYTES = 1.0, 2.5

_TOKEN = re.compile(r"[^ \t\n\r\f\v]*[^\x00-\x7f \t\n\r\f\v][^ \t\n\r\f\v]*")
_EDGE = "\"'()[]{}<>,.;:!?*_=|/\\&-~"
_MIXED = re.compile("[\u0400-\u052f][a-z\u00c0-\u024f]|[a-z\u00c0-\u024f][\u0400-\u052f]", re.I).search
_SPACED = re.compile("[\u00a0\u2000-\u200a\u202f\u205f\u3000]+")


def _codec(name: str) -> tuple[dict[str, int], list[str]]:
    """Character to byte and byte to character; undefined bytes are taken as C1 controls."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    to_byte = {c: b for b, c in enumerate(chars)}
    for b in range(0x80, 0xA0):
        to_byte.setdefault(chr(b), b)
    return to_byte, chars


CODECS = {name: _codec(name) for name in READ_AS}


def _utf8(text: str, read_as: str) -> str:
    """Valid UTF-8 sequences among the characters' bytes, each replaced by its character."""
    to_byte = CODECS[read_as][0]
    raw = [to_byte.get(c, -1) if ord(c) > 127 else -1 for c in text]
    out, i, n = [], 0, len(text)
    while i < n:
        b = raw[i]
        more = 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0
        if more and i + more < n and all(0x80 <= x <= 0xBF for x in raw[i + 1 : i + 1 + more]):
            try:
                out.append(bytes(raw[i : i + 1 + more]).decode())
                i += 1 + more
                continue
            except UnicodeDecodeError:
                pass
        out.append(text[i])
        i += 1
    return "".join(out)


@functools.lru_cache(maxsize=200_000)
def transform(text: str, chain: str) -> str:
    """Apply a transformation such as cp1252>utf8, cp1252>utf8*2 or cp1252>cp1251."""
    read_as, true = chain.split(">")
    if true.startswith("utf8"):
        for _ in range(int(true[5:] or 1)):
            text = _utf8(text, read_as)
        return text
    to_byte, chars = CODECS[read_as][0], CODECS[true][1]
    return "".join(c if ord(c) < 128 or c not in to_byte else chars[to_byte[c]] for c in text)


CHAINS = [f"{r}>utf8{k}" for r in READ_AS for k in ("", "*2", "*3")] + [f"{r}>{t}" for r in BYTES for t in BYTES[r]]


def tokens_of(text: str) -> list[str]:
    return [t for w in _TOKEN.findall(text) if (t := w.strip(_EDGE))]


def runs(token: str) -> tuple[str, list[str]]:
    """ASCII letters of a token and the non-ASCII runs between them."""
    parts = re.split(r"([\x00-\x7f])", token)
    return "".join(parts[1::2]), parts[0::2]


def votes(rare: str, clean: str) -> tuple[list[str], str]:
    """Transformations that turn the runs of the rare token into those of its twin, and the
    first pair of unequal runs."""
    a, ra = runs(rare)
    b, rb = runs(clean)
    if a != b or ra == rb:
        return [], ""
    differ = [(x, y) for x, y in zip(ra, rb, strict=True) if x != y]
    return [c for c in CHAINS if all(transform(x, c) == y for x, y in differ)], "\t".join(differ[0])


def unexplained(rare: str, clean: str) -> list[tuple[str, str]]:
    """Runs of a rare token and of its twin that differ in more than case, accent form or look; letters only.
    Runs of one length are aligned character by character."""
    a, ra = runs(rare)
    b, rb = runs(clean)
    if a != b or "\ufffd" in rare or canonical(rare).lower() == canonical(clean).lower():
        return []
    both = [p for x, y in zip(ra, rb, strict=True) for p in (zip(x, y, strict=True) if len(x) == len(y) else [(x, y)])]
    return [(x, y) for x, y in both if x.lower() != y.lower() and x and any(c.isalpha() for c in y)]


def pairs_of(token: str) -> list[str]:
    """Character pairs that touch a non-ASCII character; digits are alike, case is folded."""
    out = []
    for w in _SPACED.split(re.sub(r"\d", "0", token.lower())):
        w = f"^{w.strip(_EDGE)}$"
        out += [w[i : i + 2] for i in range(len(w) - 1) if w[i] > "\x7f" or w[i + 1] > "\x7f"]
    return out


def _same_make(token: str, new: str) -> bool:
    """For transformations of single bytes: a word of at least three letters, of one script, and
    no capital after a small letter that was not there before."""
    if sum(c.isalpha() for c in new) < 3 or _MIXED(new):
        return False
    return not any(b.isupper() and a.islower() and not y.isupper() for a, b, y in zip(new, new[1:], token[1:], strict=False))


@dataclass
class Model:
    """Transformations with their votes, the alphabet, and counts of character pairs."""

    chains: list[str]
    alphabet: frozenset[str]
    pairs: dict[str, int]
    learned: dict[str, str] = field(default_factory=dict)
    memo: dict[str, tuple[bool, str]] = field(default_factory=dict)

    def score(self, token: str) -> float:
        p = pairs_of(token)
        return sum(math.log(self.pairs.get(x, 0) + 0.1) for x in p) / len(p) if p else 99.0

    def mapped(self, token: str) -> str:
        """The token with every run, or else every character, that a learned mapping knows replaced."""
        one = lambda p: self.learned.get(p) or "".join(self.learned.get(c, c) for c in p)
        return "".join(p if i % 2 else one(p) for i, p in enumerate(re.split(r"([\x00-\x7f])", token)))

    def judge(self, token: str) -> tuple[bool, str]:
        """Whether a token is damaged, and its original or, where it cannot be had, itself."""
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[token] = found = self._judge(token)
        return found

    def _judge(self, token: str) -> tuple[bool, str]:
        lost = "�" in token or any("\x80" <= c <= "\x9f" for c in token)
        own = max(self.score(token), self.score(canonical(token)))
        best, rise = token, 0.0
        for c in [*self.chains, *(["learned>"] if self.learned else [])]:
            new = self.mapped(token) if c == "learned>" else transform(token, c)
            if new == token:
                continue
            fresh = set(new) - set(token)
            if not all(x < "\x80" or x in self.alphabet for x in fresh):
                continue
            if ">utf8" not in c and not _same_make(token, new):
                continue
            up = self.score(new) - own
            if not pairs_of(new):  # all of it became ASCII
                continue
            need = RISE_UTF8 if ">utf8" in c else RISE_BYTES
            if up - need > rise:
                best, rise = new, up - need
        return best != token or lost, best


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, n) over all texts of rows (tbl, id, text); summed within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(tokens_of(t))
                if len(seen) > 500_000:
                    yield flush()
        yield flush()

    texts = rows.filter(F.col("text").rlike(r"[^\x00-\x7f]")).select("text")
    return texts.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame) -> Model:
    """Learn the model from all rows (tbl, id, text). What reaches the driver is bounded: votes
    of sets of transformations (one per way to be explained), characters, and pairs of alphabet characters."""
    counts = cut(token_counts(rows))
    total = counts.agg(F.sum("n")).first()[0] or 0

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: Counter = Counter()
        two: Counter = Counter()
        for b in batches:
            for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for c in set(t):
                    if c > "\x7f":
                        one[c] += n
                for p in pairs_of(t):
                    two[p] += n
        yield pa.RecordBatch.from_arrays([pa.array([*one, *two], pa.string()), pa.array([*one.values(), *two.values()], pa.int64())], names=["gram", "n"])

    grams = counts.mapInArrow(letters, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    least = max(2, math.ceil(total * ALPHABET_SHARE / 10))
    seen = {r.gram: r.n for r in grams.filter(F.col("n") >= least).collect()}
    alphabet = frozenset(c for c, n in seen.items() if len(c) == 1 and n >= max(5, total * ALPHABET_SHARE))
    pairs = {p: n for p, n in seen.items() if len(p) == 2}

    strip = F.regexp_replace(F.lower("token"), "[^a-z]+", "")
    keyed = counts.withColumn("skeleton", strip).filter(F.length("skeleton") >= 2)
    twin = keyed.groupBy("skeleton").agg(F.max(F.struct("n", "token")).alias("top")).select("skeleton", F.col("top.n").alias("m"), F.col("top.token").alias("clean"))
    near = keyed.join(twin, "skeleton").filter((F.col("token") != F.col("clean")) & (F.col("m") >= TWIN_RATIO * F.col("n"))).select("token", "clean")

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for b in batches:
            for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                chains, pair = votes(t, c)
                if chains:
                    own[",".join(chains), pair] += 1
                else:
                    own.update(("", f"{x}\t{y}") for x, y in set(unexplained(t, c)))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.string()), pa.array([x for _, x in own], pa.string()), pa.array(list(own.values()), pa.int64())], names=["chains", "pair", "votes"])

    def yields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, clean, chain = [], [], []
            for t in b.column(0).to_pylist():
                for c in CHAINS:
                    if (new := transform(t, c)) != t and all(x < "\x80" or x in alphabet for x in new):
                        who.append(t)
                        clean.append(new)
                        chain.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (who, clean, chain)], names=["token", "clean", "chain"])

    bare = counts.withColumn("skeleton", strip).filter((F.length("skeleton") < 2) & (F.length("token") >= 3))
    lone = bare.select("token").mapInArrow(yields, "token string, clean string, chain string")
    known = counts.select(F.col("token").alias("clean"), F.col("n").alias("m"))
    lone = lone.join(known, "clean").join(counts, "token").filter(F.col("m") >= TWIN_RATIO * F.col("n"))
    lone = lone.groupBy("token", "clean").agg(F.array_join(F.array_sort(F.collect_set("chain")), ",").alias("chains"))
    lone = lone.groupBy("chains", F.concat(F.substring("token", 1, 1), F.lit("\t"), F.substring("clean", 1, 1)).alias("pair")).agg(F.count("*").alias("votes"))
    cast = near.mapInArrow(explained, "chains string, pair string, votes long").unionByName(lone)
    cast = cut(cast.groupBy("chains", "pair").agg(F.sum("votes").alias("votes")))
    # of each set of transformations the votes and its first LEAST_PAIRS pairs, found task by task
    told = cast.filter("chains <> ''")
    first = told.withColumn("k", F.row_number().over(Window.partitionBy("chains").orderBy("pair"))).filter(F.col("k") <= LEAST_PAIRS)
    kinds: dict[str, list[str]] = {}
    for r in first.select("chains", "pair").collect():
        kinds.setdefault(r.chains, []).append(r.pair)
    sets = [(r.chains.split(","), r.votes, kinds[r.chains]) for r in told.groupBy("chains").agg(F.sum("votes").alias("votes")).collect()]
    return Model(chosen(sets), alphabet, pairs, mappings(cast.filter("chains = ''"), counts))


def mappings(aligned: DataFrame, counts: DataFrame) -> dict[str, str]:
    """Run by run what alignment (pair, votes) taught that no transformation explains.

    A mapping needs LEAST_VOTES tokens and MAPPING_SHARE of all distinct tokens (so there are at most
    1 / MAPPING_SHARE of them), agreement, and a twin for most tokens that hold its run: a run that
    is usual without one is a writer's own.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                own.update({x for r in runs(t)[1] for x in (r, *r)} - {""})
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["bad", "n"])

    pair = F.split("pair", "\t")
    a = aligned.select(pair[0].alias("bad"), pair[1].alias("good"), "votes")
    total = a.groupBy("bad").agg(F.sum("votes").alias("all"), F.max(F.struct("votes", "good")).alias("top")).filter(F.col("top.votes") >= AGREED * F.col("all"))
    least = max(LEAST_VOTES, math.ceil(counts.count() * MAPPING_SHARE))
    total = cut(total.filter(F.col("top.votes") >= least).select("bad", F.col("top.good").alias("good"), F.col("top.votes").alias("votes")))
    if not total.take(1):
        return {}
    usual = counts.select("token").mapInArrow(of, "bad string, n long").groupBy("bad").agg(F.sum("n").alias("n"))
    return {r.bad: r.good for r in total.join(usual, "bad").filter(F.col("votes") >= COVERED * F.col("n")).select("bad", "good").collect()}


def chosen(sets: list[tuple[list[str], int, list[str]]]) -> list[str]:
    """Fewest transformations that explain the votes: the one that explains most first (on ties
    the earlier in CHAINS), then by what is left, as long as it explains LEAST_VOTES tokens by
    LEAST_PAIRS pairs of runs; a single pair is no transformation but a habit of a writer."""
    out: list[str] = []
    while True:
        left: Counter = Counter()
        kinds: dict[str, set[str]] = {}
        for chains, n, pairs in sets:
            if not any(c in out for c in chains):
                for c in chains:
                    left[c] += n
                    kinds.setdefault(c, set()).update(pairs)
        fit = [c for c in left if left[c] >= LEAST_VOTES and len(kinds[c]) >= LEAST_PAIRS]
        if not fit:
            return out
        out.append(max(fit, key=lambda c: (left[c], -CHAINS.index(c))))


def restore(text: str, model: Model) -> tuple[bool, str]:
    """Whether a text holds damage, and the text with what could be restored."""
    damaged, out, at = False, [], 0
    for m in _TOKEN.finditer(text):
        core = m.group().strip(_EDGE)
        if core:
            bad, new = model.judge(core)
            if bad:
                damaged = True
                start = m.start() + m.group().index(core)
                out += (text[at:start], new)
                at = start + len(core)
    return damaged, "".join(out) + text[at:] if damaged else text


def damaged_rows(rows: DataFrame, model: Model) -> DataFrame:
    """(tbl, id, text) of the damaged rows, text as far as restored.

    Null and pure ASCII texts are never damaged; repeated rows come out each time. No shuffle.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded: see learn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, texts = [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                bad, new = restore(t, shared.value)
                if bad:
                    keep.append(k)
                    texts.append(new)
            i = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(i), b.column(1).take(i), pa.array(texts, pa.string())], names=["tbl", "id", "text"])

    return rows.filter(F.col("text").rlike(r"[^\x00-\x7f]")).select("tbl", "id", "text").mapInArrow(run, "tbl string, id long, text string")
