"""Repairing text from scanned pages into continuous paragraphs.

Lines: boosted classifiers over a line and its neighbours find running headers, footers and
page numbers, and line ends that break a word or compound, across pages too. Words: distinct
unknown words meet the words of clean text through an inverted join on character q-grams,
and a boosted ranking chooses the replacement. All three learn from pages composed of
labelled sample sentences with planted damage; word counts come from the whole corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.llm.boosting import Trees
from lamplight.session import cut, free

#: Pages composed for training, and words whose damage the ranking learns from.
TRAINING_FILES, TRAINING_WORDS = 260, 1500
#: Candidates a training word is shown with.
CHOICES = 8
#: A word of clean text counts as known from so many occurrences.
KNOWN = 2
#: Length of q-grams, and the largest distance from an unknown word to a candidate. An edit damages
#: at most GRAM of them, so GRAM times the distance and one more cannot all be damaged.
GRAM, FAR = 3, 3
#: A word of up to SHORT characters also meets what is left of known words after up to SLIPS deletions:
#: its few q-grams could all be damaged.
SHORT, SLIPS = 6, 2
#: Share of the training words whose own misreading is taken from the table before it is consulted,
#: so that the ranking also learns from what no table explains.
UNTOLD = 0.35
#: Probability from which a classifier's answer is yes.
YES = 0.5

# What scanning makes of characters, as right and misread.
MISREAD = [
    ("l", "1"), ("i", "1"), ("i", "|"), ("l", "|"), ("o", "0"), ("O", "0"), ("s", "5"), ("g", "9"), ("é", "6"), ("t", "†"), ("e", "c"), ("c", "e"), ("h", "li"), ("u", "ii"), ("ü", "ii"), ("m", "rn"),
    ("rn", "m"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("a", "@"), ("b", "6"), ("B", "8"), ("S", "5"), ("I", "l"), ("l", "I"), ("q", "9"), ("z", "2"), ("ft", "6"), ("fi", "ﬁ"), ("n", "ri"), ("в", "8"), ("о", "0"), ("з", "3"), ("б", "6"), ("ч", "4"), ("п", "n"), ("и", "u"), ("ш", "ui"),
]
HYPHENS = "-­‐‑¬‧"
PAGE_WORDS = ["page", "seite", "trang", "página", "pagina", "pág", "p", "s", "стр", "страница", "tr", "folio", "blatt"]

# What composed pages are made of beside sample sentences; invented for training.
TITLES = ["Ledger Extract", "Field Survey", "Quittungsheft", "Lagerliste Nord", "Registre des pesées", "Hoja de ruta", "Опись имущества", "Sổ trực ban"]

_FOLDS = [(bad, good) for good, bad in MISREAD if len(bad) > 1] + [(bad, good) for good, bad in MISREAD if len(bad) == 1]
_DIGITISH = str.maketrans({"l": "1", "I": "1", "|": "1", "i": "1", "O": "0", "o": "0", "s": "5", "S": "5", "g": "9", "z": "2", "B": "8"})
_NUMBER = re.compile(r"^\d{1,4}$")
_PAGE = re.compile(rf"^(?:{'|'.join(PAGE_WORDS)})\.?\s*\d{{1,4}}(?:\s*(?:/|of|von|sur|de|из|trên)\s*\d{{1,4}})?$", re.I)
_MARKED = re.compile(r"^(?:\[\d{1,4}\]|[-–—]\s*\d{1,4}\s*[-–—]|\(\d{1,4}\)|\d{1,4}\s*/\s*\d{1,4})$")
_ROMAN = re.compile(r"^[ivxlc|1]{1,7}$", re.I)
_AMOUNT = re.compile(r"^[\d.,\s]+$")
_WORD = re.compile(r"[^\W_]+(?:[|†@¦§$!][^\W_]+|[|†@¦§$])*")
#: A word of two characters is only looked at if one of them is a likely misreading.
_SHORT = re.compile(r"^(?:[a-zà-ỹ][015|†@9]|[015|†@9][a-zà-ỹ])$").match
_LETTER = re.compile(r"[^\W\d_]")


def fold(text: str) -> str:
    """Equal for texts that differ by common misreadings and by digits; for counting repeats."""
    t = re.sub(r"\s+", " ", text.strip().lower())
    for a, b in (("rn", "m"), ("li", "h"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("|", "l"), ("1", "l"), ("i", "l"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "é"), ("†", "t"), ("@", "a"), ("c", "e"), ("8", "b")):
        t = t.replace(a, b)
    return re.sub(r"\d+", "#", t)


def number_in(line: str) -> int:
    """The page number that a furniture-like line holds, else -1."""
    m = re.search(r"\d{1,4}", line.strip().translate(_DIGITISH))
    return int(m.group()) if m and len(line) < 30 else -1


#: Slots of a page that can hold furniture: first, second, last, last but one non-blank line.
SLOTS = 4


def edges(lines: list[str]) -> list[int]:
    """Line indexes of the slots, -1 where a page has too few lines."""
    full = [k for k, x in enumerate(lines) if x.strip()]
    n = len(full)
    return [full[0] if n else -1, full[1] if n > 2 else -1, full[-1] if n > 1 else -1, full[-2] if n > 3 else -1]


def furniture_features(lines: list[str], repeats: list[int], pages: int) -> np.ndarray:
    """One row a slot; repeats[s]: pages of the file with a like line at an edge."""
    slots = edges(lines)
    full = [k for k, x in enumerate(lines) if x.strip()]
    width = max((len(x.strip()) for x in lines), default=1)
    rows = []
    for s, k in enumerate(slots):
        if k < 0:
            rows.append([0.0] * 25)
            continue
        x = lines[k].strip()
        d = x.translate(_DIGITISH)
        j = full.index(k)
        inner = lines[full[j + 1]].strip() if s in (0, 1) and j + 1 < len(full) else lines[full[j - 1]].strip() if s in (2, 3) and j else ""
        gap = not lines[k + 1].strip() if s in (0, 1) and k + 1 < len(lines) else not lines[k - 1].strip() if s in (2, 3) and k else False
        words = re.findall(r"[^\W\d_][\w'’-]*", x)
        caps = sum(w[0].isupper() for w in words)
        rows.append([
            s == 0, s == 1, s == 2, s == 3, bool(_PAGE.match(x) or _PAGE.match(re.sub(r"\S+$", lambda m: m.group().translate(_DIGITISH), x))), bool(_MARKED.match(d)), bool(_NUMBER.match(d)), bool(_ROMAN.match(x)),
            bool(_AMOUNT.match(x)), bool(_AMOUNT.match(x)) and not _NUMBER.match(x) and not _MARKED.match(x), bool(_AMOUNT.match(inner)) and not _MARKED.match(inner), repeats[s], repeats[s] / max(pages, 1), pages,
            len(x) / width, x[-1:] in ".!?,;", bool(re.search(r"[•|·]| {3,}|\t", x)), bool(re.search(r"\s[–—]\s", x)), caps / max(len(words), 1), len(words),
            x.isupper(), gap, inner[:1].isupper() if s in (0, 1) else inner[-1:] in ".!?", x[:1].isupper(),
            x[-1:] in HYPHENS and x[-2:-1].isalpha(),
        ])
    return np.array(rows, float)


def pair_features(line: str, after: str, known=None) -> list[float]:
    """Whether line ends inside a word that after goes on with; known says if a word is known."""
    x, y = line.rstrip(), after.strip()
    mark = x[-1:]
    body = x[:-1]
    left = re.search(r"\S*$", body).group() if mark in HYPHENS else re.search(r"\S*$", x).group()
    right = re.match(r"[^\W_]*", y).group()
    return [
        mark == "-", mark == "­", mark in ("‐", "‑"), mark == "¬", mark in HYPHENS, bool(body) and body[-1:].isalnum(), body[-1:].isspace() or not body, y[:1].islower(), y[:1].isupper(), y[:1].isdigit(), not y,
        len(left), len(right), left.isupper(), bool(_AMOUNT.match(x[:-1] or "x")),
    ]


Table = tuple[tuple[str, str], ...]


def damage(word: str, rng: np.random.Generator, table: Table = tuple(MISREAD)) -> str | None:
    """A word with one misreading, None if it has no character that is misread."""
    made = damaged(word, rng, table)
    return made[0] if made else None


def damaged(word: str, rng: np.random.Generator, table: Table) -> tuple[str, tuple[str, str]] | None:
    """As damage, with the misreading that was made."""
    fits = [(a, b) for a, b in table if a in word]
    if not fits:
        return None
    a, b = fits[int(rng.integers(len(fits)))]
    places = [m.start() for m in re.finditer(re.escape(a), word)]
    k = places[int(rng.integers(len(places)))]
    return word[:k] + b + word[k + len(a) :], (a, b)


def compose(samples: list[str], rng: np.random.Generator) -> list[tuple[list[str], set[int], set[int]]]:
    """Pages of a file: lines, indexes of furniture, indexes of line ends that break a word."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    name = lambda: "".join(pick(["ka", "lo", "mi", "ster", "ne", "bru", "da", "vex"]) for _ in range(int(rng.integers(2, 4)))).title()
    title, firm = pick([*TITLES, name()]), f"{name()} {pick(['Ltd', 'GmbH', '& Co', 'Holding', ''])}".strip()
    amount = lambda: pick([f"{rng.random() * 10 ** int(rng.integers(2, 6)):,.2f}", str(int(rng.integers(10, 90_000))), f"{int(rng.integers(10, 90_000)):,}"])
    style, first, total = int(rng.integers(0, 9)), int(rng.integers(1, 30)), int(rng.integers(30, 40))
    heads = pick([[], [title], [firm], [title, firm], [f"{title.upper()}    {firm}"], [f"{firm} • {title}"], [f"{title} – {firm}"]])
    foot = rng.random() < 0.3
    width = int(rng.integers(44, 62))
    word = pick(["Page", "Seite", "Trang", "p."])
    out, carry = [], ""
    for p in range(int(rng.integers(1, 7))):
        n = first + p
        number = [None, f"- {n} -", str(n), f"{n}/{total}", pick(["ii", "iii", "vi", "xi", "xxi", "iv"]), f"[{n}]", f"{word} {n}", f"{word} {n} of {total}", None][style]
        if number and rng.random() < 0.2:
            number = number.replace("1", "l").replace("0", "O")
        lines, bad, breaks = [], set(), set()

        def furniture(x: str, lines=lines, bad=bad) -> None:
            bad.add(len(lines))
            lines.append(x)

        head = heads[p % len(heads)] if heads and rng.random() < 0.9 else None
        if head and rng.random() < 0.25:
            head = damage(head, rng) or head
        top = style in (5, 6, 7)
        if head and not foot:
            furniture(head)
        if number and top and rng.random() < 0.9:
            furniture(number)
        if lines and rng.random() < 0.7:
            lines.append("")
        for para in range(int(rng.integers(1, 4))):
            if para:
                lines.append("")
                if rng.random() < 0.15:
                    lines += [amount() for _ in range(int(rng.integers(2, 4)))]
                    lines.append("")
            text = " ".join(pick(samples) for _ in range(int(rng.integers(1, 4))))
            words, row = text.split(), ""
            if carry:
                words, carry = [carry, *words], ""
            while words:
                w = words.pop(0)
                if len(row) + len(w) + 1 <= width:
                    row = f"{row} {w}".strip()
                    continue
                room = width - len(row) - 2
                if "-" in w[1:-1] and rng.random() < 0.5:
                    k = w.index("-", 1) + 1
                    lines.append(f"{row} {w[:k]}".strip())
                    breaks.add(len(lines) - 1)
                    row = w[k:]
                elif len(w) > 5 and room > 2 and rng.random() < 0.35:
                    k = min(room, len(w) - 2)
                    lines.append(f"{row} {w[:k]}{pick(HYPHENS[:5])}".strip())
                    breaks.add(len(lines) - 1)
                    row = w[k:]
                else:
                    lines.append(row + (pick([" –", " —", " -"]) if rng.random() < 0.04 else ""))
                    row = w
            if len(row) > 12 and row[-1] == "." and rng.random() < 0.15 and para:
                k = max(1, len(row.split()[-1]) // 2)
                carry, row = row[-k:], f"{row[:-k]}{pick(HYPHENS[:5])}"
                lines.append(row)
                breaks.add(len(lines) - 1)
                break
            lines.append(row)
        if rng.random() < 0.12:
            lines += ["", *(amount() for _ in range(2))]
        if rng.random() < 0.15:  # a short paragraph at the end is text
            lines += ["", " ".join(pick(samples).split()[-int(rng.integers(1, 6)) :])]
        if rng.random() < 0.8:
            lines.append("")
        if head and foot:
            furniture(head)
        if number and not top and rng.random() < 0.9:
            furniture(number)
        out.append((lines, bad, breaks))
    return out


def word_features(word: str, cand: str, n_word: int, n_cand: int, misread: bool) -> list[float]:
    """Of an unknown word and a candidate for what it should be."""
    a, b = word.lower(), cand.lower()
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    bad, good = a[p : len(a) - s], b[p : len(b) - s]
    inner = sum(1 for c in word if not c.isalpha())
    return [
        misread, len(bad), len(good), len(a), np.log1p(n_cand), np.log1p(n_word), np.log1p(n_cand) - np.log1p(n_word), inner, any(c in "|†@¦0123456789" for c in bad), p == 0, s == 0,
        sum(c.isdigit() for c in word) / len(word), len(good) == 0, len(bad) == 0, word[:1].isupper(), any(c.isalpha() for c in good) and good.isalpha(),
    ]


def misreadings(word: str, cand: str, table: Table = tuple(MISREAD)) -> int:
    """Fewest misreadings of the table (at most 2) that make the word of the candidate; 0 if none do."""
    a, b, lower = word.lower(), cand.lower(), _lower(table)
    steps = {(0, 0): 0}
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        n = steps[i, j]
        nxt = []
        if i < len(a) and j < len(b) and a[i] == b[j]:
            nxt.append((i + 1, j + 1, n))
        if n < 2:
            nxt += [(i + len(bad), j + len(good), n + 1) for good, bad in lower if a.startswith(bad, i) and b.startswith(good, j)]
        for x, y, m in nxt:
            if m < steps.get((x, y), 9):
                steps[x, y] = m
                todo.append((x, y))
    return steps.get((len(a), len(b)), 0)


@lru_cache(256)
def _lower(table: Table) -> list[tuple[str, str]]:
    return sorted({(g.lower(), b.lower()) for g, b in table if g.lower() != b.lower()})


@dataclass
class Model:
    """Three boosted classifiers of fixed size."""

    furniture: Trees
    breaks: Trees
    words: Trees
    table: Table = tuple(MISREAD)


def train_lines(samples: list[str], seed: int = 11) -> tuple[Trees, Trees]:
    """Furniture and line ends, from composed pages of sample sentences."""
    rng = np.random.default_rng(seed)
    fx, fy, px, py = [], [], [], []
    for _ in range(TRAINING_FILES):
        pages = compose(samples, rng)
        keys = Counter(k for lines, _, _ in pages for k in {fold(lines[e]) for e in edges(lines) if e >= 0})
        for lines, bad, breaks in pages:
            e = edges(lines)
            f = furniture_features(lines, [keys[fold(lines[k])] if k >= 0 else 0 for k in e], len(pages))
            for row, k in zip(f, e, strict=True):
                if k >= 0:
                    fx.append(row)
                    fy.append(k in bad)
            body = [k for k, x in enumerate(lines) if x.strip() and k not in bad]
            for k, after in zip(body, [*body[1:], None], strict=False):
                if after is not None or k in breaks:
                    px.append(pair_features(lines[k], lines[after] if after is not None else "er"))
                    py.append(k in breaks)
    return Trees().fit(np.array(fx), np.array(fy, float)), Trees().fit(np.array(px, float), np.array(py, float))


#: A word to learn from: the word as read, what it should be (None if it is right), the misreading made.
Lesson = tuple[str, str | None, tuple[str, str] | None]


def lessons(frequent: list[str], rare: list[str], table: Table = tuple(MISREAD), seed: int = 12) -> list[Lesson]:
    """Frequent words with a planted misreading, and rare words, which are right as they are."""
    rng = np.random.default_rng(seed)
    out: dict[str, Lesson] = {w: (w, None, None) for w in rare}
    for w in frequent:
        if hit := damaged(w, rng, table):
            out[hit[0]] = (hit[0], w, hit[1])
    return list(out.values())


def train_words(known: list[Lesson], candidates: dict[str, list[tuple[str, int]]], table: Table = tuple(MISREAD), seed: int = 13) -> Trees:
    """The ranking, from candidates (cand, n) of each lesson.

    The table of misreadings is one feature of the ranking and never a condition.
    """
    rng, x, y = np.random.default_rng(seed), [], []
    for word, true, why in known:
        told = tuple(t for t in table if t != why) if rng.random() < UNTOLD else table
        here = int(rng.geometric(0.7))  # few unknown words come often, copies of a page aside
        for cand, n in candidates.get(word, ()):
            x.append(word_features(word, cand, here, n, bool(misreadings(word, cand, told))))
            y.append(cand == true)
    return Trees().fit(np.array(x, float), np.array(y, float)) if x else Trees(base=-9.0)


def words_of(line: str) -> list[tuple[int, str]]:
    """(offset, word) of words, codes and pure numbers left out."""
    return [(m.start(), m.group()) for m in _WORD.finditer(line) if (len(_LETTER.findall(m.group())) * 2 > len(m.group()) and len(m.group()) >= 3) or _SHORT(m.group())]


def clean_words(texts: DataFrame, text: str) -> DataFrame:
    """(word, n) of all clean texts, case folded; summed within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        find = re.compile(r"[^\W\d_]{2,}").findall
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(find(t.lower()))
                if len(seen) > 500_000:
                    yield flush()
        yield flush()

    return texts.filter(F.col(text).isNotNull()).select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def page_repeats(pages: DataFrame) -> DataFrame:
    """pages (chunk_id, file_id, page, content) with repeats (of each slot) and pages of the file.

    A page stored twice counts once. Repeats are counted by (file, line), so a file of very many
    pages spreads by its lines; only lines on several pages go back to their pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, f, p, s, fold(lines[k])) for c, f, p, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) for lines in [t.split("\n")] for s, k in enumerate(edges(lines)) if k >= 0]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["chunk_id", "file_id", "page", "slot", "line"])

    slots = cut(pages.select("chunk_id", "file_id", "page", "content").mapInArrow(run, "chunk_id long, file_id long, page int, slot int, line string"))
    many = slots.select("file_id", "line", "page").distinct().groupBy("file_id", "line").agg(F.count("*").cast("int").alias("n")).filter("n > 1")
    found = slots.join(many, ["file_id", "line"]).groupBy("chunk_id").agg(*(F.max(F.when(F.col("slot") == s, F.col("n"))).alias(f"r{s}") for s in range(SLOTS)))
    size = pages.select("file_id", "page").distinct().groupBy("file_id").agg(F.count("*").cast("int").alias("pages"))
    repeats = F.array(*(F.coalesce(f"r{s}", F.lit(1)) for s in range(SLOTS))).alias("repeats")
    return pages.join(found, "chunk_id", "left").join(size, "file_id", "left").select(*pages.columns, repeats, F.coalesce("pages", F.lit(1)).alias("pages"))


_LINES = "array<struct<line_no:long,text:string,furniture:boolean,broken:boolean>>"


def classify_lines(pages: DataFrame, model: Model) -> DataFrame:
    """(chunk_id, file_id, page, lines): every non-blank line with its two line answers.

    Whether the last text line of a page breaks a word is judged against the first text line of
    the next page, fetched by a join on (file_id, page + 1); where there is none, by itself.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred kB
    kind = pa.list_(pa.struct([("line_no", pa.int64()), ("text", pa.string()), ("furniture", pa.bool_()), ("broken", pa.bool_())]))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, f, p, t, r, n = (b.column(i).to_pylist() for i in range(6))
            split = [x.split("\n") for x in t]
            feats = [furniture_features(x, y, z) for x, y, z in zip(split, r, n, strict=True)]
            prob = shared.value.furniture.predict(np.concatenate(feats)).reshape(-1, SLOTS) if feats else np.zeros((0, SLOTS))
            out, head = [], []
            for lines, yes in zip(split, prob >= YES, strict=True):
                e = edges(lines)
                bad = {k for k, y in zip(e, yes, strict=True) if y and k >= 0}
                bad = {k for k in bad if k not in (e[1], e[3]) or (k == e[1] and e[0] in bad) or (k == e[3] and e[2] in bad)}
                rows = [{"line_no": k + 1, "text": x, "furniture": k in bad, "broken": False} for k, x in enumerate(lines) if x.strip()]
                out.append(rows)
                head.append(next((x["text"] for x in rows if not x["furniture"]), ""))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, kind), pa.array(head, pa.string())], names=["chunk_id", "file_id", "page", "lines", "head"])

    made = cut(page_repeats(pages).mapInArrow(first, f"chunk_id long, file_id long, page int, lines {_LINES}, head string"))
    heads = made.groupBy("file_id", (F.col("page") - 1).alias("page")).agg(F.min("head").alias("next_head"))
    both = made.join(heads, ["file_id", "page"], "left").select("chunk_id", "file_id", "page", "lines", "next_head", "head")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.column(3).to_pylist()
            x, where = [], []
            for rows, after in zip(out, b.column(4).to_pylist(), strict=True):
                body = [r for r in rows if not r["furniture"]]
                for r, nxt in zip(body, [*body[1:], None], strict=False):
                    x.append(pair_features(r["text"], nxt["text"] if nxt else after or "er"))
                    where.append(r)
            for r, p in zip(where, shared.value.breaks.predict(np.array(x, float)) if x else (), strict=True):
                r["broken"] = bool(p >= YES)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, kind), b.column(4)], names=["chunk_id", "file_id", "page", "lines", "next_head"])

    return both.mapInArrow(second, f"chunk_id long, file_id long, page int, lines {_LINES}, next_head string")


def page_words(lines: list[dict], next_head: str | None) -> list[tuple[int, int, str]]:
    """(line_no, length before a break or 0, word) of the text lines; broken words are joined.

    The first word of a page that goes on from the page before is left to that page.
    """
    body = [r for r in lines if not r["furniture"]]
    out, skip = [], False
    for k, r in enumerate(body):
        text = r["text"].rstrip()
        found = words_of(text)
        if skip and found and found[0][0] == len(text) - len(text.lstrip()):
            found = found[1:]
        skip = False
        tail = None
        if r["broken"]:
            m = re.search(r"[^\W_]*$", text[:-1])
            tail = m.group()
            found = [x for x in found if x[0] < m.start()]
            after = body[k + 1]["text"] if k + 1 < len(body) else next_head or ""
            m = re.match(r"\s*([^\W_]+(?:[|†@][^\W_]+)*)", after)
            if tail and m:
                word = tail + m.group(1)
                if len(_LETTER.findall(word)) * 2 > len(word) and len(word) >= 3:
                    out.append((r["line_no"], len(tail), word))
                skip = k + 1 < len(body)
        out += [(r["line_no"], 0, w) for _, w in found]
    return out


def words_in_lines(classified: DataFrame) -> DataFrame:
    """(chunk_id, line_no, next_no, cut, word): next_no is the line a broken word goes on in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, lines, after in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                body = [r["line_no"] for r in lines if not r["furniture"]]
                nxt = dict(zip(body, body[1:], strict=False))
                rows += [(c, no, nxt.get(no, -1), k, w) for no, k, w in page_words(lines, after)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["chunk_id", "line_no", "next_no", "cut", "word"])

    return classified.select("chunk_id", "lines", "next_head").mapInArrow(run, "chunk_id long, line_no long, next_no long, cut int, word string")


def leftovers(word: Column) -> Column:
    """The word and what is left of it after one to SLIPS deletions, each once."""
    less = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    out = [F.array(word)]
    for _ in range(SLIPS):
        out.append(F.array_distinct(F.flatten(F.transform(out[-1], less))))
    return F.array_distinct(F.concat(*out))


def candidates(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """(word, here, cand, n): known words (word, n) near the unknown ones (word, low, here).

    The rarest q-grams of an unknown word, as many as no admitted distance can damage all of, meet
    those of known words; a levenshtein bound in the join keeps near ones. A word of too few q-grams
    for that goes with all it has; a short one also meets known words through deletions, so that no
    known word within SLIPS edits is missed.
    """
    padded = lambda c: F.concat(F.lit("^"), c, F.lit("$"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(padded(c), i, GRAM)))
    index = known.select(F.col("word").alias("cand"), "n", F.explode(grams(F.col("word"))).alias("gram"))
    spread = index.groupBy("gram").agg(F.count("*").alias("df"))
    asked = unknown.select("word", "low", "here", F.explode(grams(F.col("low"))).alias("gram")).join(spread, "gram")
    far = F.least(F.lit(FAR), F.floor((F.length("low") + 1) / 2)).cast("int")
    rare = asked.groupBy("word", "low", "here").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "gram"))), F.lit(1), GRAM * far + 1).alias("g")).select("word", "low", "here", F.explode("g.gram").alias("gram"))
    near = (F.abs(F.length("low") - F.length("cand")) <= 2) & (F.levenshtein("low", "cand", FAR) >= 0) & (F.levenshtein("low", "cand", FAR) * 2 <= F.length("low") + 1)
    by_gram = rare.join(index, "gram").filter(near).select("word", "here", "cand", "n")
    brief = unknown.filter(F.length("low") <= SHORT).select("word", "low", "here", F.explode(leftovers(F.col("low"))).alias("left"))
    short = known.filter(F.length("word") <= SHORT + SLIPS).select(F.col("word").alias("cand"), "n", F.explode(leftovers(F.col("word"))).alias("left"))
    by_rest = brief.join(short, "left").filter(near).select("word", "here", "cand", "n")
    return by_gram.unionByName(by_rest).groupBy("word", "here", "cand").agg(F.max("n").alias("n"))


def unknown_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, low, here): distinct words that clean text does not know, with how often they are here."""
    distinct = words.groupBy("word").agg(F.count("*").alias("here")).withColumn("low", F.lower("word"))
    return distinct.join(known.filter(F.col("n") >= KNOWN).select(F.col("word").alias("low")), "low", "left_anti").select("word", "low", "here")


def corrections(words: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    """(word, right): unknown words with the replacement the ranking chose among their candidates.

    known: (word, n) of clean text. The best candidate is taken if the ranking says yes.
    """
    return ranked(candidates(cut(unknown_words(words, known)), known.filter(F.col("n") >= KNOWN)), model)


def ranked(pairs: DataFrame, model: Model) -> DataFrame:
    """(word, right) of (word, here, cand, n)."""
    shared = pairs.sparkSession.sparkContext.broadcast(model)  # some hundred kB

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, h, c, n = (b.column(i).to_pylist() for i in range(4))
            x = [word_features(w[k], c[k], h[k], n[k], bool(misreadings(w[k], c[k], shared.value.table))) for k in range(len(w))]
            p = shared.value.words.predict(np.array(x, float)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p, pa.float64())], names=["word", "cand", "p"])

    found = pairs.select("word", "here", "cand", "n").mapInArrow(rank, "word string, cand string, p double")
    return found.groupBy("word").agg(F.max(F.struct("p", "cand")).alias("b")).filter(F.col("b.p") >= YES).select("word", F.col("b.cand").alias("right"))


def misread_words(words: DataFrame, fixes: DataFrame) -> DataFrame:
    """(chunk_id, line_no, word, right): the line is that of the misread part of a broken word."""
    hit = words.join(fixes, "word")
    tail = F.length("word") - F.col("cut")
    head_fine = F.lower(F.expr("substring(word, 1, cut)")) == F.expr("substring(right, 1, cut)")
    tail_fine = F.lower(F.expr("right(word, length(word) - cut)")) == F.expr("right(right, length(word) - cut)")
    line = F.when((F.col("cut") == 0) | (tail <= 0), F.array("line_no")).when(head_fine, F.array("next_no")).when(tail_fine, F.array("line_no")).otherwise(F.array("line_no", "next_no"))
    return hit.select("chunk_id", F.explode(line).alias("line_no"), "word", "right").filter("line_no > 0")


def sample_texts(samples: DataFrame) -> list[str]:
    """At most 400 sample texts, lowest sample_id first."""
    return [r.text for r in samples.filter("text is not null").orderBy("sample_id").limit(400).select("text").collect()]


def chosen_lessons(known: DataFrame, table: Table = tuple(MISREAD)) -> list[Lesson]:
    """Of TRAINING_WORDS frequent and as many rare words of the lowest hash."""

    def some(n: Column) -> list[str]:
        return [r.word for r in known.filter(n & (F.length("word") >= 2)).orderBy(F.xxhash64("word"), "word").limit(TRAINING_WORDS).select("word").collect()]

    return lessons(some(F.col("n") >= 5), some(F.col("n") < KNOWN), table)


#: What here says of a word that is a lesson and no word of a page.
LESSON = 0


def asked_lessons(taught: list[Lesson], known: DataFrame) -> DataFrame:
    """Lessons as unknown words (word, low, here); those that a known word equals are left out."""
    rows = known.sparkSession.createDataFrame([(w, w.lower(), LESSON) for w, _, _ in taught], "word string, low string, here long")
    return rows.join(known.filter(F.col("n") >= KNOWN).select(F.col("word").alias("low")), "low", "left_anti").select("word", "low", "here")


def taught_ranking(pairs: DataFrame, taught: list[Lesson], table: Table = tuple(MISREAD)) -> Trees:
    """The ranking from the candidates of lessons, up to CHOICES each, the right one first and the others by hash."""
    true = pairs.sparkSession.createDataFrame([(w, t) for w, t, _ in taught], "word string, true string")
    order = F.row_number().over(Window.partitionBy("word").orderBy(F.when(F.col("cand") == F.col("true"), 0).otherwise(1), F.xxhash64("cand")))
    found: dict[str, list[tuple[str, int]]] = {}
    mine = pairs.filter(F.col("here") == LESSON).join(F.broadcast(true), "word")  # twice TRAINING_WORDS
    for r in mine.withColumn("k", order).filter(F.col("k") <= CHOICES).select("word", "cand", "n").orderBy("word", "cand").collect():
        found.setdefault(r.word, []).append((r.cand, r.n))
    return train_words(taught, found, table)


def learn(samples: DataFrame, known: DataFrame, table: Table = tuple(MISREAD)) -> Model:
    """Train on at most 400 sample texts and 2 TRAINING_WORDS words of clean text, with the candidates that
    the search for unknown words finds for them."""
    taught = chosen_lessons(known, table)
    pairs = candidates(asked_lessons(taught, known), known.filter(F.col("n") >= KNOWN))
    return Model(*train_lines(sample_texts(samples)), taught_ranking(pairs, taught, table), table)


@dataclass
class Repair:
    """What the stages found: classified lines, words by line, and corrections."""

    classified: DataFrame
    words: DataFrame
    fixes: DataFrame

    def found(self) -> DataFrame:
        """(chunk_id, line_no, kind); a line of furniture has no other kind."""
        lines = self.classified.select("chunk_id", F.explode("lines").alias("x")).select("chunk_id", "x.*")
        marked = lines.filter("furniture or broken").select("chunk_id", "line_no", F.when(F.col("furniture"), "furniture").otherwise("hyphen").alias("kind"))
        chars = misread_words(self.words, self.fixes).select("chunk_id", "line_no", F.lit("char").alias("kind")).distinct()
        return marked.unionByName(chars)

    def paragraphs(self) -> DataFrame:
        """(chunk_id, text): without furniture, words joined and corrected, a paragraph a line.

        A word broken across pages is completed on the page where it begins; the next page's own
        copy of its rest stays, so that no page loses text.
        """
        fixes = misread_words(self.words, self.fixes).groupBy("chunk_id").agg(F.collect_set(F.struct("word", "right")).alias("fixes"))
        both = self.classified.select("chunk_id", "lines").join(fixes, "chunk_id", "left").select("chunk_id", "lines", "fixes")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for lines, fix in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    right = {f["word"]: f["right"] for f in fix or ()}
                    text, last, broken = "", 0, False
                    for r in (r for r in lines if not r["furniture"]):
                        x = r["text"].strip()
                        text += ("" if broken else "\n\n" if text and r["line_no"] > last + 1 else " " if text else "") + (x[:-1] if r["broken"] and not re.search(r"[A-Z\d]-$", x) else x)
                        last, broken = r["line_no"], r["broken"]
                    out.append(_WORD.sub(lambda m: _cased(m.group(), right.get(m.group())), text))  # noqa: B023
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["chunk_id", "text"])

        return both.mapInArrow(run, "chunk_id long, text string")


def _cased(word: str, right: str | None) -> str:
    if right is None:
        return word
    return right.upper() if word.isupper() else right[:1].upper() + right[1:] if word[:1].isupper() else right


def repair(pages: DataFrame, clean: DataFrame, samples: DataFrame) -> Repair:
    """Repair scanned pages (chunk_id, file_id, page, content) with the clean texts' (content) words.

    Null contents have no rows; empty ones have no lines; a repeated page is repaired each time.
    """
    pages = cut(pages.filter("content is not null").select("chunk_id", "file_id", F.col("page").cast("int").alias("page"), "content"))
    known = cut(clean_words(clean, "content"))
    lines = Model(*train_lines(sample_texts(samples)), Trees())
    classified = cut(classify_lines(pages, lines))
    words = cut(words_in_lines(classified))
    # lessons and unknown words look for candidates together
    taught = chosen_lessons(known)
    asked = cut(unknown_words(words, known).unionByName(asked_lessons(taught, known)))
    pairs = cut(candidates(asked, known.filter(F.col("n") >= KNOWN)))
    model = Model(lines.furniture, lines.breaks, taught_ranking(pairs, taught))
    fixes = cut(ranked(pairs.filter(F.col("here") != LESSON), model))
    free(asked, pairs, known, pages)
    return Repair(classified, words, fixes)
