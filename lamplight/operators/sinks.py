"""Files beside a corpus: manifest, catalogue, sidecar texts and reports."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.operators.stats import breakdown, totals

SNIPPET = 400
CATALOGUE = ("path", "dir", "name", "ext", "size", "mtime", "lang", "method", "ocr_used")


def write_manifest(files: DataFrame, content: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines: a row a processed file with the first characters of its text."""
    text = content.select("path", F.substring("content", 1, SNIPPET).alias("snippet"))
    files.select("path", "lang", "method", "size", "ocr_used", "pages", "chars", "sha1").join(text, "path", "left").write.mode(mode).json(path)


def write_catalogue(files: DataFrame, path: str, mode: str = "append") -> None:
    """CSV of nine columns with a header in each part; times in whole seconds."""
    rows = files.select(*(F.format_string("%.0f", "mtime").alias(c) if c == "mtime" else F.col(c) for c in CATALOGUE))
    rows.write.mode(mode).csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_sidecars(texts: DataFrame, target: str, where: str = "mirror") -> int:
    """Texts of (path, method, content) that were extracted from formats other than text, as files;
    mirror puts them below target, inplace beside the original, none writes nothing. The number written."""
    if where == "none":
        return 0

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = 0
            for path, content in zip(b["path"], b["content"], strict=True):
                to = f"{path}.txt" if where == "inplace" else os.path.join(target, path.lstrip("/\\").replace(":", "")) + ".txt"
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(to, "w", encoding="utf-8") as f:
                    f.write(content)
                n += 1
            yield pd.DataFrame({"n": [n]})

    done = ~F.col("method").isin("text", "name-only") & ~F.col("method").startswith("error:") & ~F.col("method").startswith("excluded:") & ~F.col("method").endswith("-partial")
    return texts.filter(done & F.col("content").isNotNull()).select("path", "content").mapInPandas(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def report(files: DataFrame) -> dict:
    """Totals and the most frequent values; a few rows whatever the corpus."""
    out = totals(files).first().asDict()
    for r in breakdown(files).orderBy("dimension", F.desc("n"), F.asc_nulls_last("value")).collect():
        out.setdefault(r.dimension, []).append([r.value, r.n])
    return out


def write_report(files: DataFrame, folder: str) -> None:
    """analysis.json and analysis.md in a folder of the driver."""
    data = report(files)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "analysis.json"), "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=1)
    with open(os.path.join(folder, "analysis.md"), "w", encoding="utf-8") as f:
        f.write("# Corpus\n\n" + "".join(f"- {k}: {v}\n" for k, v in data.items() if not isinstance(v, list)))
        for k, rows in data.items():
            if isinstance(rows, list):
                f.write(f"\n## {k}\n\n" + "".join(f"- {a}: {n}\n" for a, n in rows))
