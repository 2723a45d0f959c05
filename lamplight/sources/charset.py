"""Which encoding a file's bytes are in, judged by what each candidate makes of them."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Encodings of single bytes, more usual ones first, and of several bytes.
SINGLE = ("cp1252", "cp1251", "koi8_r", "cp1250", "cp1253", "cp1254", "cp1255", "cp1256", "cp866")
MULTIPLE = ("shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
#: Bytes that are looked at.
LOOKED = 64 << 10


@lru_cache(maxsize=65_536)
def _script(c: str) -> str:
    """Script of a letter by the first word of its name, blank for other characters."""
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


def plausibility(text: str) -> float:
    """Mean over the characters beyond ASCII: letters among letters of their script count for a reading,
    controls, unassigned characters, symbols within words and capitals after small letters against it."""
    total, n = 0.0, 0
    for i, c in enumerate(text):
        if c < "\x80":
            continue
        n += 1
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        kind = unicodedata.category(c)
        if kind[0] == "C":
            total -= 3
        elif kind[0] == "L":
            own = _script(c)
            total += sum(0.5 if _script(x) == own else -1.0 for x in (before, after) if x and x.isalpha())
            total += 0.5 if c.islower() or kind == "Lo" else 0.1
            total -= 1.5 if c.isupper() and before.islower() else 0
        elif kind[0] in "SN" or c in "¡¿ªº":
            total -= 0.5 + (before.isalpha() and after.isalpha())
        else:
            total += -0.5 if before.isalpha() and after.isalpha() and c not in "’­‐‑" else 0.2
    return total / n if n else 0.0


def _wide(raw: bytes, name: str) -> float:
    """As plausibility, for encodings of several bytes: nearly all must be ideographs, syllables or kana."""
    try:
        text = raw.decode(name)
    except UnicodeDecodeError as e:
        if e.start < len(raw) - 4:
            return -9.0
        text = raw[: e.start].decode(name)
    high = [c for c in text if c > "\x7f"]
    if not high:
        return -9.0
    usual = sum("\u3000" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3" or "\uff00" <= c <= "\uff5e" for c in high)
    kana = sum("\u3040" <= c <= "\u30ff" for c in high)
    rare = sum("\uff61" <= c <= "\uff9f" or "\ue000" <= c <= "\uf8ff" for c in high)
    hangul = sum("\uac00" <= c <= "\ud7a3" for c in high)
    return 2.0 * (usual - 3 * rare) / len(high) - 0.9 + 0.3 * kana / len(high) + 0.3 * (hangul > 0.95 * len(high))


def detect(raw: bytes, cut: bool = False) -> str:
    """Name of the encoding: by mark, UTF-8 where it is valid, else the most plausible candidate.

    cut: the bytes are the beginning of more, and may end within a character.
    """
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return name
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        if cut and e.start >= len(raw) - 3:
            return "utf-8"
    head = raw[:LOOKED]
    scores = {name: plausibility(head.decode(name, errors="replace")) for name in SINGLE}
    scores |= {name: _wide(head, name) for name in MULTIPLE}
    return max(scores, key=lambda k: scores[k])


def decode(raw: bytes, most: int, cut: bool = False) -> str:
    """Text of bytes in the detected encoding, at most so many characters."""
    name = detect(raw, cut)
    return raw.decode(name, errors="ignore" if cut and name.startswith("utf-8") else "replace")[:most]
