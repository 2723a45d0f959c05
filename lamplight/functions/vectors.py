"""Vector functions as columns, and their vectorised kernels for bulk work."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _float(c: Column) -> Column:
    return c.cast("float")


def dot_f32(a: Column, b: Column) -> Column:
    """Sum of products in single precision, left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: _float(x * y)), F.lit(0.0).cast("float"), lambda s, v: _float(s + v))


def cosine_f32(a: Column, b: Column) -> Column:
    """Single-precision cosine; -1 where a norm is zero or not finite, or the widths differ."""
    na, nb = _float(F.sqrt(dot_f32(a, a))), _float(F.sqrt(dot_f32(b, b)))
    fine = lambda n: (n > 0) & ~F.isnan(n) & (n < F.lit(float("inf")))
    value = _float(dot_f32(a, b) / _float(na * nb))
    return F.when((F.size(a) == F.size(b)) & fine(na) & fine(nb), value).otherwise(F.lit(-1.0).cast("float"))


def literal(vector: list[float]) -> Column:
    one = lambda x: f"double('{x}')" if x != x or x in (float("inf"), float("-inf")) else f"{float(x)!r}D"
    return F.expr(f"cast(array({', '.join(one(x) for x in vector)}) as array<float>)")


def cosine_to(query: list[float], embedding: Column) -> Column:
    """cosine_f32 to one vector as a vectorised kernel: sums run left to right in single precision."""
    q = np.asarray(query, np.float32)
    total = lambda x: np.cumsum(x, axis=-1, dtype=np.float32)[..., -1]
    root = np.sqrt(total(q * q)) if len(q) else np.float32(0)

    @F.pandas_udf("float")
    def score(s):
        import pandas as pd

        out = np.full(len(s), -1, np.float32)
        rows = [k for k, v in enumerate(s) if v is not None and len(v) == len(q)]
        if rows and len(q):
            with np.errstate(all="ignore"):
                x = np.stack([np.asarray(s.iloc[k], np.float32) for k in rows])
                norm = np.sqrt(total(x * x))
                fine = (norm > 0) & np.isfinite(norm) & (root > 0) & np.isfinite(root)
                out[rows] = np.where(fine, total(x * q) / (norm * root), np.float32(-1))
        return pd.Series(out)

    return score(embedding)


def int8_codes(v: Column) -> Column:
    """Each element by 127 over the largest magnitude, half away from zero; not finite or all zero give 0."""
    fine = F.filter(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    top = F.coalesce(F.array_max(F.transform(fine, lambda x: F.abs(x))), F.lit(0.0).cast("float"))
    scale = _float(F.lit(127.0).cast("float") / top)
    one = lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(_float(x * scale)).cast("int")))
    bad = lambda x: F.isnan(x) | (F.abs(x) >= F.lit(float("inf"))) | (top <= 0)
    return F.transform(v, lambda x: F.when(bad(x), 0).otherwise(one(x)).cast("int"))


def bit_codes(v: Column, centre: Column) -> Column:
    """Words of 32 bits: bit i is set where element i exceeds the centre; NaN gives 0."""
    bits = F.zip_with(v, centre, lambda x, c: F.when(~F.isnan(x) & (x > c), 1).otherwise(0).cast("long"))
    starts = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(32))
    # the higher elements of a word are shifted further
    word = lambda s: F.aggregate(F.reverse(F.slice(bits, s + 1, 32)), F.lit(0).cast("long"), lambda a, b: a * 2 + b)
    return F.transform(starts, word)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def phash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hex digits; null where either is none."""
    valid = lambda c: F.when(c.rlike("^[0-9a-fA-F]{16}$"), F.conv(c, 16, -10).cast("long"))
    return F.bit_count(valid(a).bitwiseXOR(valid(b)))


def cap_evenly(items: Column, most: int) -> Column:
    """At most `most` items, at indexes floor(k * size / most)."""
    n = F.size(items)
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.element_at(items, (F.floor(k * n / F.lit(most)) + 1).cast("int")))
    return F.when(n <= most, items).otherwise(picked)


def chunk_starts(text: Column, size: int = 1200, stride: int = 1000) -> Column:
    """Start offsets (code points, from 0) of overlapping windows; none for empty text."""
    n = F.length(text)
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - (size - stride) - 1, F.lit(0)), F.lit(stride))).otherwise(F.array().cast("array<int>"))


# Kernels over numpy arrays

def perceptual_hash(luma: np.ndarray) -> str:
    """64-bit hash of a grey image (rows by columns): 32 x 32 triangle resize, cosine transform,
    the 8 x 8 low frequencies against the mean of the two values around the middle of the 63."""

    def resize(a: np.ndarray, n: int) -> np.ndarray:
        scale = a.shape[0] / n
        support = max(scale, 1.0)
        centre = (np.arange(n) + 0.5) * scale
        w = np.maximum(0, 1 - np.abs((np.arange(a.shape[0])[None, :] + 0.5 - centre[:, None]) / support))
        return (w / w.sum(axis=1, keepdims=True)) @ a

    small = resize(resize(np.asarray(luma, float), 32).T, 32).T
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ small @ basis.T)[:8, :8].ravel()
    rest = np.sort(low[1:])
    middle = (rest[30] + rest[31]) / 2
    return f"{int(''.join('1' if x > middle else '0' for x in low), 2):016x}"


def quality(luma: np.ndarray) -> dict[str, float]:
    """Sharpness (variance of the Laplacian), mean, and shares of very dark and very bright pixels."""
    a = np.asarray(luma, float)
    lap = a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]
    var = float(lap.var()) if lap.size else 0.0
    dark, bright = float((a <= 16).mean()), float((a >= 239).mean())
    return {"sharpness": round(var, 3), "luma": round(float(a.mean()), 3), "dark": round(dark, 3), "bright": round(bright, 3), "blurred": var < 100, "underexposed": dark > 0.5, "overexposed": bright > 0.5}


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap of boxes (x, y, w, h) of a with those of b."""
    x1, y1 = np.maximum(a[:, None, 0], b[None, :, 0]), np.maximum(a[:, None, 1], b[None, :, 1])
    x2, y2 = np.minimum((a[:, 0] + a[:, 2])[:, None], (b[:, 0] + b[:, 2])[None]), np.minimum((a[:, 1] + a[:, 3])[:, None], (b[:, 1] + b[:, 3])[None])
    inter = np.clip(x2 - x1, 0, None) * np.clip(y2 - y1, 0, None)
    union = (a[:, 2] * a[:, 3])[:, None] + (b[:, 2] * b[:, 3])[None] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def suppress(boxes: np.ndarray, scores: np.ndarray, most: float = 0.3) -> list[int]:
    """Indexes kept: by falling score, each overlapping all kept ones by less than most."""
    kept: list[int] = []
    for i in np.argsort(-scores, kind="stable").tolist():
        if not kept or iou(boxes[i : i + 1], boxes[kept]).max() < most:
            kept.append(i)
    return kept
