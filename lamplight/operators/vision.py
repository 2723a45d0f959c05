"""Aggregation of what models saw in images and frames; the models themselves are plugged in."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamplight.schemas import FACES, VISION


def objects_per_image(detections: DataFrame, image: str, label: str, confidence: str, least: float = 0.5) -> DataFrame:
    """(image, label, n, confidence) above the least confidence."""
    hit = detections.filter(F.col(confidence) >= least)
    return hit.groupBy(image, label).agg(F.count("*").alias("n"), F.max(confidence).alias("confidence"))


def objects_per_video(frames: DataFrame, video: str, label: str, count: str, confidence: str) -> DataFrame:
    return frames.groupBy(video, label).agg(F.sum(count).alias("n"), F.max(confidence).alias("confidence"))


def tags_per_video(tags: DataFrame, video: str, tag: str, score: str, k: int = 8) -> DataFrame:
    best = tags.groupBy(video, tag).agg(F.max(score).alias("score"))
    rank = F.row_number().over(Window.partitionBy(video).orderBy(F.desc("score"), tag))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def first_faces(faces: DataFrame, video: str, frame: str, order: str, most: int = 20) -> DataFrame:
    """The first faces of each video in order of frame and place, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(video).orderBy(frame, order))
    return faces.withColumn("rank", rank).filter(F.col("rank") <= most)


def mean_pool(vectors: DataFrame, group: str, embedding: str) -> DataFrame:
    """(group, dim, mean) over the vectors of each group's most frequent width (the larger on ties)."""
    v = vectors.filter(F.col(embedding).isNotNull() & (F.size(embedding) > 0)).withColumn("w", F.size(embedding))
    mode = v.groupBy(group, "w").agg(F.count("*").alias("n")).groupBy(group).agg(F.max(F.struct("n", "w")).alias("m")).select(group, F.col("m.w").alias("w"))
    e = v.join(mode, [group, "w"]).select(group, F.posexplode(embedding).alias("dim", "x"))
    return e.groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def score_tags(images: DataFrame, vocabulary: list[tuple[str, list[float]]], id: str, embedding: str, least: float = 0.22, k: int = 8) -> DataFrame:
    """(id, tag, score): the k best tags of each image; the vocabulary is a bounded list of the caller."""
    names = [t for t, _ in vocabulary]
    m = np.array([v for _, v in vocabulary], np.float64)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if len(m) else m

    @F.pandas_udf("array<struct<tag:string,score:double>>")
    def best(vs):
        out = []
        for v in vs:
            x = None if v is None else np.asarray(v, np.float64)
            if x is None or not len(m) or len(x) != m.shape[1] or not np.linalg.norm(x) > 0:
                out.append([])
                continue
            s = m @ (x / np.linalg.norm(x))
            order = sorted(np.flatnonzero(s >= least).tolist(), key=lambda i: (-s[i], names[i]))[:k]
            out.append([{"tag": names[i], "score": float(s[i])} for i in order])
        return pd.Series(out)

    return images.select(F.col(id).alias("id"), F.explode(best(F.col(embedding))).alias("t")).select("id", "t.tag", "t.score")


def near_hashes(images: DataFrame, id: str = "id", phash: str = "phash", most: int = 3) -> DataFrame:
    """(id_a, id_b, distance; a < b): hashes that differ in at most 3 bits.

    By pigeonhole such hashes agree in three of six segments. Every choice of three is a key of about
    32 bits, so a bucket stays small among billions of hashes; images of equal hash are joined once as a
    group, through its lowest id, and listed with distance 0 to it.
    """
    if most > 3:
        raise ValueError("three of six segments find at most three differing bits")
    from lamplight.functions.vectors import phash_distance

    bounds = [64 * i // 6 for i in range(7)]
    masks = [sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in c) for c in itertools.combinations(range(6), 3)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    h = images.filter(F.col(phash).rlike("^[0-9a-fA-F]{16}$")).select(F.col(id).alias("id"), F.lower(phash).alias("h"))
    groups = h.groupBy("h").agg(F.min("id").alias("id"))
    value = F.conv("h", 16, -10).cast("long")
    keys = groups.select("id", "h", F.posexplode(F.array(*(value.bitwiseAND(F.lit(m).cast("long")) for m in signed))).alias("q", "part"))
    a, b = keys.alias("a"), keys.alias("b")
    near = a.join(b, (F.col("a.q") == F.col("b.q")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.id") < F.col("b.id")))
    d = phash_distance(F.col("a.h"), F.col("b.h"))
    pairs = near.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), d.alias("distance")).filter(F.col("distance") <= most).distinct()
    copies = h.join(groups.select("h", F.col("id").alias("first")), "h").filter(F.col("id") != F.col("first")).select(F.col("first").alias("id_a"), F.col("id").alias("id_b"), F.lit(0).alias("distance"))
    return pairs.unionByName(copies)


def analysed(files: DataFrame, look: Callable[[str, str], dict | None], mode: str, faces_model: str | None = None) -> DataFrame:
    """(path, vision, faces): what a model function (path, mode) saw in each file.

    It gives a dict with the fields of schemas.VISION and, under found_faces, rows of schemas.FACES; None
    or an error leaves both null, so that stored rows of unchanged bytes stay. The mode reached is recorded.
    """
    seen = T.StructType([f for f in T.StructType.fromDDL(VISION).fields if f.name != "file_id"])
    face = T.StructType([f for f in T.StructType.fromDDL(FACES).fields if f.name != "file_id"])

    @F.pandas_udf("string")
    def run(paths):
        out = []
        for path in paths:
            try:
                got = look(path, mode)
            except Exception:  # noqa: BLE001
                got = None
            out.append(None if got is None else json.dumps({"mode": mode, "faces_model": faces_model} | got, default=float))
        return pd.Series(out)

    made = files.select("path", run("path").alias("j"))
    found = F.get_json_object("j", "$.found_faces")
    return made.select("path", F.from_json("j", seen).alias("vision"), F.from_json(found, T.ArrayType(face)).alias("faces"))


def with_files(vision: DataFrame, files: DataFrame) -> DataFrame:
    """Vision rows with the path, name and folder of their files; rows of no file vanish."""
    return vision.join(files.select(F.col("id").alias("file_id"), "path", "name", "dir"), "file_id")


def frames_summary(frames: DataFrame, video: str, order: str, columns: list[str], mode: str = "mode") -> DataFrame:
    """(video, columns, mode): of each column the first value that is not null, in order of the frames, and the
    least mode of any frame (off, meta, tags, captions)."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    rank = F.coalesce(F.array_position(F.array(*(F.lit(m) for m in MODES)), F.col(mode)), F.lit(0))
    return frames.groupBy(video).agg(*first, F.min_by(mode, F.when(F.col(mode).isNotNull(), rank)).alias(mode))


#: Vision modes, from least to most.
MODES = ("off", "meta", "tags", "captions")


def content_block(vision: DataFrame) -> DataFrame:
    """Searchable text of caption, objects, tags and camera; faces never enter it."""
    line = lambda name, value: F.when(F.length(value) > 0, F.concat(F.lit(f"{name}: "), value))
    objects = F.array_join(F.transform("objects", lambda o: F.concat(o["label"], F.lit(" x"), o["count"].cast("string"))), ", ")
    tags = F.array_join(F.transform("tags", lambda t: t["tag"]), ", ")
    body = F.concat_ws("\n", line("caption", F.col("caption")), line("objects", objects), line("tags", tags), line("camera", F.element_at("exif", "camera")))
    return vision.select("file_id", F.when(F.length(body) > 0, F.concat(F.lit("[vision]\n"), body)).alias("block"))
