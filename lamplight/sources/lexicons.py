"""Dictionaries, word lists and abbreviations; a missing file is an empty lexicon."""

from __future__ import annotations

import re
from pathlib import Path


def lines(path: str | Path) -> list[str]:
    """Stripped, lower-cased lines without blanks and comments."""
    p = Path(path)
    if not p.is_file():
        return []
    return [x for line in p.read_text(encoding="utf-8", errors="replace").splitlines() if (x := line.strip().lower()) and not x.startswith("#")]


def dictionary(path: str | Path) -> set[str]:
    """Words of a spelling dictionary: what stands before the slash, numbers left out."""
    return {w for line in lines(path) if not (w := line.split("/")[0]).isdigit()}


def abbreviations(*paths: str | Path) -> dict[str, list[str]]:
    """Expansions by abbreviation from lines such as key = first; second (or a tab for the =)."""
    out: dict[str, list[str]] = {}
    for path in paths:
        for line in lines(path):
            parts = re.split(r"\t|=", line, maxsplit=1)
            if len(parts) == 2:
                known = out.setdefault(parts[0].strip(), [])
                known += [v for x in re.split("[;,]", parts[1]) if (v := x.strip()) and v not in known]
    return out
