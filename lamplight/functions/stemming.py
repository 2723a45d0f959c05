"""English stemming after the published Porter2 description, and token enrichment."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Collection, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the algorithm's description.
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_WHOLE = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "dying": "die", "lying": "lie", "tying": "tie"}
_WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_LATER = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_V = "[aeiouy]"


def _regions(w: str) -> tuple[int, int]:
    head = re.match("gener|commun|arsen", w)
    after = re.compile(f"{_V}[^aeiouy]")
    m = after.search(w)
    r1 = head.end() if head else m.end() if m else len(w)
    m = after.search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Porter2 stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = re.sub(rf"(?:^|(?<={_V}))y", "Y", word.lstrip("'"))
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"{_V}.+s$", w) and re.search(_V, w[:-2]):
        w = w[:-1]
    if w in _LATER:
        return w
    # past and progressive
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if m and m.group() in ("eed", "eedly"):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif m and re.search(_V, w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # derivations: the longest suffix decides
    for size in range(7, 1, -1):
        s = w[-size:]
        if s in _STEP2 and len(s) == size:
            w = w[:-size] + _STEP2[s] if len(w) - size >= r1 else w
            break
        if s == "ogi":
            w = w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
            break
        if s == "li":
            w = w[:-2] if len(w) - 2 >= r1 and w[-3:-2] and w[-3] in "cdeghkmnrt" else w
            break
    for size in range(7, 2, -1):
        s = w[-size:]
        if s in _STEP3 and len(s) == size:
            w = w[:-size] + _STEP3[s] if len(w) - size >= r1 else w
            break
        if s == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
            break
    for s in (*_STEP4[:6], "ion", *_STEP4[6:]):
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def drop_marks(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.category(c).startswith("M"))


@functools.lru_cache(maxsize=200_000)
def fold_word(word: str) -> str:
    return drop_marks(word).replace("đ", "d").replace("Đ", "D")


def segment(words: list[str], compounds: Collection[str], longest: int = 6) -> list[str]:
    """Compounds of at least two words, by greedy longest match."""
    out, i = [], 0
    most = min(longest, max((len(c.split()) for c in compounds), default=1))
    while i < len(words):
        size = next((k for k in range(min(most, len(words) - i), 1, -1) if " ".join(words[i : i + k]) in compounds), 1)
        if size > 1:
            out.append(" ".join(words[i : i + size]))
        i += size
    return out


def enriched(words: list[str], lang: str, compounds: Collection[str] = (), abbreviations: Mapping[str, list[str]] | None = None) -> list[str]:
    """Words, folded words, stems, joined compounds and expansions; each token once, first place kept."""
    out = list(words) + [f for w in words if (f := fold_word(w)) != w]
    if lang in ("en", "mixed", "und"):
        out += [s for w in words if w.isascii() and len(w) > 3 and (s := stem(w)) != w]
    if lang in ("vi", "mixed", "und"):
        for c in segment(words, compounds):
            joined = c.replace(" ", "_")
            out += [joined, fold_word(joined)]
    for w in words:
        for expansion in (abbreviations or {}).get(w, ()):
            out += re.findall(r"[^\W_]+", expansion.lower())
    return [t for t in dict.fromkeys(out) if t]


def enrich(words: Column, lang: Column, compounds: Collection[str] = (), abbreviations: Mapping[str, list[str]] | None = None) -> Column:
    """Column of enriched tokens; the lexicons are small files and travel with the function."""
    known, expand = frozenset(compounds), dict(abbreviations or {})

    @F.pandas_udf("array<string>")
    def run(w, x):
        import pandas as pd

        return pd.Series([None if a is None else enriched(list(a), b or "und", known, expand) for a, b in zip(w, x, strict=True)])

    return run(words, lang)


def query_terms(query: str, compounds: Collection[str] = (), abbreviations: Mapping[str, list[str]] | None = None) -> list[str]:
    """Sorted distinct terms of a search: words of the query, of its folded form, and enrichment."""
    query = unicodedata.normalize("NFC", query)
    plain = re.findall(r"[^\W_]+", query.lower())
    folded = re.findall(r"[^\W_]+", fold_word(query).lower())
    return sorted({*plain, *folded, *enriched(plain, "und", compounds, abbreviations)})
