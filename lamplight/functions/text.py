"""Text functions as columns; Python only where no built-in expresses the meaning."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of language detection.
VIETNAMESE = "ăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
GERMAN_STOPWORDS = (
    "der", "die", "das", "und", "ist", "nicht", "mit", "ein", "eine", "auch", "für", "von", "den", "dem", "des", "sich", "auf", "werden", "wird", "aber", "oder", "als", "zum", "zur", "im", "bei", "aus", "dass", "einer", "eines",
)
LANG_CHARS, LANG_WORDS, MARK_SHARE, DICTIONARY_SHARE, STOPWORD_SHARE = 2000, 300, 0.02, 0.35, 0.15

WHITE = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def trim_white(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(as_column(c), WHITE, "")


def words(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order; null for null."""
    return F.transform(F.regexp_extract_all(as_column(c), F.lit(r"([\p{L}\p{N}]+)"), 1), F.lower)


@functools.cache
def _fold_tables() -> tuple[str, str, str]:
    """Characters that fold to one character, what to, and a class of those that need Python."""
    one, to, rest = [], [], []
    for k in range(0x80, 0x2FA20):
        if 0xD800 <= k < 0xE000 or 0xAC00 <= k < 0xD7A4:
            continue
        c = chr(k)
        d = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M"))
        if d != c and d:
            if len(d) == 1 and k < 0x10000 and ord(d) < 0x10000:
                one.append(c)
                to.append(d)
            else:
                rest.append(k)
    spans, start = [], None
    for k in rest:
        if start is None or k != last + 1:
            if start is not None:
                spans.append((start, last))
            start = k
        last = k
    if start is not None:
        spans.append((start, last))
    spans.append((0xAC00, 0xD7A3))
    return "".join(one), "".join(to), "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


@F.pandas_udf(StringType())
def _decomposed(s):
    return s.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFD", t) if not unicodedata.category(x).startswith("M")))


def strip_marks(c: Column | str, exact: bool = True) -> Column:
    """Canonically decomposed and without combining marks; đ stays.

    Native for characters that become one character; the few others (Hangul syllables and the
    like) pass a vectorised function when exact.
    """
    c = as_column(c)
    one, to, rest = _fold_tables()
    native = F.regexp_replace(F.translate(c, one, to), r"\p{M}+", "")
    return F.coalesce(_decomposed(F.when(c.rlike(rest), c)), native) if exact else native


def fold(c: Column | str, exact: bool = True) -> Column:
    """Accents dropped, đ and Đ become d and D."""
    return F.translate(strip_marks(c, exact), "đĐ", "dD")


def fts_tokens(c: Column | str) -> Column:
    """Full-text tokens: lower-cased, marks dropped, đ kept, _ a token character; empty for null."""
    c = F.coalesce(as_column(c), F.lit(""))
    text = F.lower(F.when(c.rlike(r"[^\x00-\x7f]"), strip_marks(c, exact=False)).otherwise(c))
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_\p{Co}]+)"), 1)


@functools.cache
def _fts_table() -> dict[int, str | None]:
    one, to, _ = _fold_tables()
    marks = (k for k in range(sys.maxunicode + 1) if unicodedata.category(chr(k)).startswith("M"))
    return dict.fromkeys(marks) | {ord(a): b for a, b in zip(one, to, strict=True)}


def fts_tokenizer() -> Callable[[str], list[str]]:
    """fts_tokens as a Python function, for work that goes through texts once outside the JVM."""
    table = _fts_table()
    # \\w is letters, numbers and _; private use characters are tokens too
    find = re.compile("[\\w\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd]+").findall
    return lambda t: find((t if t.isascii() else t.translate(table)).lower())


@F.pandas_udf(StringType())
def _nfc(s):
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column | str) -> Column:
    """Canonically composed; texts that hold nothing to compose do not leave the JVM."""
    c = as_column(c)
    may = r"[\u0300-\u036f\u0374\u037e\u0387\u0591-\u0670\u06d6-\u0ddf\u0f00-\u0fff\u1100-\u11ff\u1f00-\u1fff\u2000\u2001\u2126\u212a\u212b\u20d0-\u20ff\u302a-\u309a\uf900-\ufaff\ufb1d-\ufb4e]"
    return F.coalesce(_nfc(F.when(c.rlike(may), c)), c)


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def known_words(ws: Column, known: Collection[str]) -> Column:
    """How many of the words a dictionary of any size has; the dictionary travels with the function."""
    known = frozenset(known)

    @F.pandas_udf("int")
    def run(s):
        return s.map(lambda a: 0 if a is None else sum(w in known for w in a)).astype("int32")

    return run(ws)


def detect_lang(c: Column | str, english: Column | Collection[str] | None = None, vietnamese: Column | Collection[str] | None = None) -> Column:
    """und, ru, mixed, vi, de or en by rules over the first 2,000 characters and 300 words.

    english and vietnamese: known words, where dictionaries exist, as array columns (small ones)
    or as collections of any size; without them English text is und. Null text is und.
    """
    sample = F.substring(F.coalesce(as_column(c), F.lit("")), 1, LANG_CHARS)
    # collections are looked up in Python, which no lambda may call: before the rules
    counted_before = [known_words(F.slice(words(sample), 1, LANG_WORDS), k) if k is not None and not isinstance(k, Column) else F.lit(0) for k in (english, vietnamese)]

    def hits(ws: Column, known: Column | Collection[str] | None, before: Column) -> Column:
        return F.size(F.filter(ws, lambda w: F.array_contains(known, w))) if isinstance(known, Column) else before

    def counted(v: Column) -> Column:
        t = v["t"]
        return F.struct(t.alias("t"), v["en"].alias("en"), v["vi"].alias("vi"), F.slice(words(t), 1, LANG_WORDS).alias("ws"), F.greatest(F.length(t), F.lit(1)).alias("chars"), count_matches(F.lower(t), f"[{VIETNAMESE}]").alias("marks"), count_matches(t, r"[\u0400-\u052f]").alias("cyrillic"))

    def judged(x: Column) -> Column:
        n = F.greatest(F.size(x["ws"]), F.lit(1))
        german = F.size(F.filter(x["ws"], lambda w: w.isin(*GERMAN_STOPWORDS)))
        return F.struct(F.size(x["ws"]).alias("n"), (x["cyrillic"] / x["chars"]).alias("ru"), x["marks"].alias("marks"), (x["marks"] / x["chars"]).alias("vm"), hits(x["ws"], english, x["en"]).alias("en"), hits(x["ws"], vietnamese, x["vi"]).alias("vi"), (x["t"].contains("ß") | (german / n > STOPWORD_SHARE)).alias("de"))

    def named(y: Column) -> Column:
        n = F.greatest(y["n"], F.lit(1))
        is_vi = (y["vm"] > MARK_SHARE) | (y["vi"] / n > DICTIONARY_SHARE)
        is_en = y["en"] / n > DICTIONARY_SHARE
        is_de = ~is_vi & y["de"]
        return (
            F.when(y["n"] == 0, "und")
            .when(y["ru"] > MARK_SHARE, "ru")
            .when(is_vi & is_en, "mixed")
            .when(is_vi, "vi")
            .when(~is_en & ~is_de & (y["marks"] > 0), "vi")
            .when(is_de, "de")
            .when(is_en, "en")
            .when((y["en"] >= y["vi"]) & (y["en"] > 0), "en")
            .otherwise("und")
        )

    given = F.struct(sample.alias("t"), counted_before[0].alias("en"), counted_before[1].alias("vi"))
    return let(given, lambda v: let(counted(v), lambda x: let(judged(x), named)))


def strip_html(c: Column | str) -> Column:
    """Tags become one space each, as does a stray >; an unclosed < takes the rest along.
    Entities and the text of scripts stay as they are."""
    return F.translate(F.regexp_replace(F.regexp_replace(as_column(c), "<[^>]*>", " "), "<[^>]*$", ""), ">", " ")


def truncate(c: Column | str, chars: int) -> Column:
    return F.substring(as_column(c), 1, chars)


def extension(name: Column | str) -> Column:
    """Lower-cased with its dot; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(as_column(name), r"[^/\\](\.[^./\\]*)$", 1))


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(as_column(path), r"([^/\\]*)$", 1)


def directory(path: Column | str) -> Column:
    return F.regexp_replace(as_column(path), r"[/\\][^/\\]*$", "")


def drive(path: Column | str) -> Column:
    """First component: X: or /first."""
    return F.regexp_extract(as_column(path), r"^([A-Za-z]:|[/\\]?[^/\\]*)", 1)


def glob_pattern(pattern: str) -> str:
    """Anchored regular expression of a path pattern: * within a segment, ?: any drive letter,
    either slash, case ignored, as many segments as the pattern has."""
    import re

    parts = [p for p in re.split(r"[/\\]", pattern) if p]
    made = ["[A-Za-z]:" if p == "?:" else "".join("[^/\\\\]*" if c == "*" else re.escape(c) for c in p) for p in parts]
    return r"(?i)^[/\\]?" + r"[/\\]".join(made) + r"[/\\]?$"


def error_clip(c: Column | str, size: int = 120) -> Column:
    """On a single line, at most size bytes, cut between characters."""

    @F.pandas_udf("string")
    def clip(s):
        return s.map(lambda t: None if t is None else t.encode()[:size].decode(errors="ignore"))

    return clip(trim_white(F.regexp_replace(as_column(c), r"\s+", " ")))


def fallback_content(text: Column | str, name: Column | str, folder: Column | str) -> Column:
    """The text, or name and folder where extraction gave nothing but white space."""
    text = F.coalesce(as_column(text), F.lit(""))
    return F.when(trim_white(text) == "", F.concat_ws(" ", as_column(name), as_column(folder))).otherwise(text)


def token_source(content: Column | str, name: Column | str, path: Column | str) -> Column:
    return F.concat_ws(" ", as_column(content), as_column(name), F.translate(as_column(path), "\\/", "  "))


def clock(centiseconds: Column | str) -> Column:
    """hh:mm:ss of centiseconds."""
    s = F.floor(as_column(centiseconds) / 100)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600).cast("string")
    return F.concat_ws(":", F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), two(F.floor(s % 3600 / 60)), two(s % 60))
