"""Functions for SQL users: registered under plain names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lamplight.functions.stemming import enriched, fold_word, stem


def register(spark: SparkSession) -> list[str]:
    """fold(text), stem_en(word), enrich(text, lang), cosine(a, b), jaro_winkler(a, b)."""
    import re

    import numpy as np

    from lamplight.operators.search import jaro_winkler

    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(float("nan"), index=a.index)
        fine = a.notna() & b.notna()
        for x, rows in a[fine].groupby(a[fine]).groups.items():
            out[rows] = jaro_winkler(x, b[rows].tolist())
        return out

    def cosine(a, b):
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            x, y = np.asarray(x, np.float32), np.asarray(y, np.float32)
            n = np.linalg.norm(x) * np.linalg.norm(y) if x.shape == y.shape else 0
            out.append(float(x @ y / n) if n > 0 and np.isfinite(n) else -1.0)
        return pd.Series(out, dtype="float64")

    made = {
        "fold": F.pandas_udf(lambda s: s.map(fold_word, na_action="ignore"), "string"),
        "stem_en": F.pandas_udf(lambda s: s.map(stem, na_action="ignore"), "string"),
        "enrich": F.pandas_udf(lambda s, x: pd.Series([None if t is None else enriched(re.findall(r"[^\W_]+", t.lower()), v or "und") for t, v in zip(s, x, strict=True)]), "array<string>"),
        "cosine": F.pandas_udf(cosine, "double"),
        "jaro_winkler": F.pandas_udf(likeness, "double"),
    }
    for name, f in made.items():
        spark.udf.register(name, f)
    return list(made)
