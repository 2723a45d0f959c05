"""What images and model outputs say, as numpy kernels: metadata, detections, faces, frames, model files."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from lamplight.functions.vectors import suppress

# Tags of image metadata, and where a 112 x 112 face has eyes, nose and mouth corners.
MAKE, MODEL, ORIENTATION, CHANGED, EXIF_AT, GPS_AT, TAKEN = 0x010F, 0x0110, 0x0112, 0x0132, 0x8769, 0x8825, 0x9003
LATITUDE_REF, LATITUDE, LONGITUDE_REF, LONGITUDE = 1, 2, 3, 4
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
FACE_POINTS = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])
FACE_SIZE, LEAST_FACE = 112, 24


# ---- metadata ----------------------------------------------------------------------------


def _tiff(raw: bytes) -> bytes | None:
    """The metadata block of a JPEG, or the bytes themselves if they are one."""
    if raw[:4] in (b"II*\0", b"MM\0*"):
        return raw
    if raw[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != 0xDA:
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        if raw[at + 1] == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
            return raw[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def _entries(block: bytes, order: str, at: int) -> dict[int, object]:
    """Values of a directory by tag; entries that point outside the block are left out."""
    out: dict[int, object] = {}
    if at + 2 > len(block):
        return out
    for k in range(struct.unpack_from(f"{order}H", block, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(block):
            break
        tag, kind, n = struct.unpack_from(f"{order}HHI", block, entry)
        size = SIZES.get(kind, 0) * n
        start = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", block, entry + 8)[0]
        if not size or start + size > len(block):
            continue
        data = block[start : start + size]
        if kind == 2:
            out[tag] = data.split(b"\0")[0].decode(errors="replace").strip()
        elif kind in (5, 10):
            pairs = struct.unpack(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", data)
            out[tag] = [a / b if b else float("nan") for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        elif kind in (3, 4, 9):
            out[tag] = struct.unpack(f"{order}{n}{ {3: 'H', 4: 'I', 9: 'i'}[kind] }", data)[0]
    return out


def exif(raw: bytes) -> dict | None:
    """camera, datetime (YYYY-MM-DDTHH:MM), latitude and longitude in degrees, orientation: those that are
    there; None where a file holds none of them or no readable block."""
    block = _tiff(raw)
    if block is None or len(block) < 8:
        return None
    order = "<" if block[:2] == b"II" else ">"
    first = _entries(block, order, struct.unpack_from(f"{order}I", block, 4)[0])
    more = {k: _entries(block, order, first[k]) if isinstance(first.get(k), int) else {} for k in (EXIF_AT, GPS_AT)}
    out: dict = {}
    make, model = first.get(MAKE), first.get(MODEL)
    name = model if make and model and str(model).lower().startswith(str(make).lower()) else " ".join(str(x) for x in (make, model) if x)
    if name:
        out["camera"] = name
    stamp = re.match(r"(\d{4}):(\d\d):(\d\d) (\d\d):(\d\d)", str(more[EXIF_AT].get(TAKEN) or first.get(CHANGED) or ""))
    if stamp:
        out["datetime"] = "{}-{}-{}T{}:{}".format(*stamp.groups())
    place = {}
    for field, tag, ref, back in (("latitude", LATITUDE, LATITUDE_REF, "S"), ("longitude", LONGITUDE, LONGITUDE_REF, "W")):
        dms = more[GPS_AT].get(tag)
        if isinstance(dms, list) and len(dms) >= 3 and np.isfinite(dms[:3]).all():
            sign = -1 if str(more[GPS_AT].get(ref, "")).upper().startswith(back) else 1
            place[field] = sign * (dms[0] + dms[1] / 60 + dms[2] / 3600)
    if len(place) == 2:
        out |= place
    if isinstance(first.get(ORIENTATION), int):
        out["orientation"] = first[ORIENTATION]
    return out or None


# ---- model outputs -----------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows without a length stay."""
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.array(x, float), where=n > 0)


def detections(logits: np.ndarray, labels: dict[int, str] | list[str], least: float = 0.5) -> list[tuple[str, float]]:
    """(label, confidence) of each query whose best class has at least the confidence and a label.

    logits: (queries, classes). One object a query, so nothing is suppressed.
    """
    if logits.size == 0:
        return []
    score = sigmoid(logits)
    best = score.argmax(axis=1)
    conf = score[np.arange(len(best)), best]
    names = labels if isinstance(labels, dict) else dict(enumerate(labels))
    return [(names[int(k)], float(c)) for k, c in zip(best, conf, strict=True) if c >= least and int(k) in names]


def faces(outputs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], size: int, least: float = 0.9, overlap: float = 0.3, most: int = 20, least_side: int = LEAST_FACE) -> list[dict]:
    """Faces of a grid detector: box (x, y, w, h), quality and five points (5, 2), best first.

    outputs: by stride (class, object, box, points), a row a grid cell of a size x size image. The
    quality is the geometric mean of class and object; boxes that overlap a better one are left out, as are
    those with a side below least_side.
    """
    boxes, quality, points = [np.zeros((0, 4))], [np.zeros(0)], [np.zeros((0, 5, 2))]
    for stride, (cls, obj, box, kps) in outputs.items():
        columns = size // stride
        n = min(columns * columns, len(cls), len(obj), len(box), len(kps))
        q = np.sqrt(np.clip(cls[:n], 0, 1) * np.clip(obj[:n], 0, 1)).ravel()
        keep = np.flatnonzero(q >= least)
        cell = np.stack([keep % columns, keep // columns], axis=1).astype(float)
        middle, side = (cell + box[keep, :2]) * stride, np.exp(box[keep, 2:4]) * stride
        boxes.append(np.concatenate([middle - side / 2, side], axis=1))
        quality.append(q[keep])
        points.append((kps[keep].reshape(-1, 5, 2) + cell[:, None, :]) * stride)
    b, q, p = np.concatenate(boxes), np.concatenate(quality), np.concatenate(points)
    fit = [i for i in suppress(b, q, overlap) if np.rint(b[i, 2:]).min() >= least_side][:most]
    return [{"box": b[i], "quality": float(q[i]), "points": p[i]} for i in fit]


def similarity(points: np.ndarray, target: np.ndarray = FACE_POINTS) -> np.ndarray | None:
    """The 2 x 3 turn, scale and shift that brings points nearest to the target; None for points in one place."""
    a, b = points - points.mean(axis=0), target - target.mean(axis=0)
    spread = (a**2).sum()
    if spread <= 1e-12:
        return None
    c, s = (a * b).sum() / spread, (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum() / spread
    turn = np.array([[c, -s], [s, c]])
    return np.concatenate([turn, (target.mean(axis=0) - turn @ points.mean(axis=0))[:, None]], axis=1)


def aligned(image: np.ndarray, matrix: np.ndarray, size: int = FACE_SIZE) -> np.ndarray:
    """size x size crop of an image (rows, columns, channels) under a transform, sampled bilinearly; outside is 0."""
    turn, shift = matrix[:, :2], matrix[:, 2]
    y, x = np.mgrid[0:size, 0:size]
    at = (np.stack([x.ravel(), y.ravel()], axis=1) - shift) @ np.linalg.inv(turn).T
    low = np.floor(at).astype(int)
    out = np.zeros((size * size, *image.shape[2:]))
    for dx in (0, 1):
        for dy in (0, 1):
            c = low + (dx, dy)
            w = np.abs(1 - dx - (at[:, 0] - low[:, 0])) * np.abs(1 - dy - (at[:, 1] - low[:, 1]))
            inside = (c >= 0).all(axis=1) & (c[:, 0] < image.shape[1]) & (c[:, 1] < image.shape[0])
            out[inside] += w[inside].reshape(-1, *[1] * (image.ndim - 2)) * image[c[inside, 1], c[inside, 0]]
    return out.reshape(size, size, *image.shape[2:])


def chosen_frames(scenes: list, spaced: list, most: int, least: int = 3) -> list:
    """Frames of a video: those at scene cuts if there are enough, else the longer of both, at most so many, evenly."""
    frames = scenes if len(scenes) >= least or len(scenes) > len(spaced) else spaced
    return frames if len(frames) <= most else [frames[k * len(frames) // most] for k in range(most)]


def within_limits(width: int, height: int, channels: int = 4, most_pixels: int = 250_000_000, most_bytes: int = 1 << 30) -> str | None:
    """Why an image must not be decoded, None if it may."""
    return "decode-limit" if width * height > most_pixels or width * height * channels > most_bytes else None


def ladder(mode: str, tiers: dict, image: object) -> dict:
    """What each tier up to the asked one sees; a tier that fails adds its error, and the mode reached is that of
    the last tier that did not. tiers: function by mode, from meta to captions."""
    order = ("meta", "tags", "captions")
    out: dict = {"mode": "off", "errors": {}}
    for tier in order[: order.index(mode) + 1] if mode in order else ():
        try:
            out |= tiers[tier](image)
            out["mode"] = tier
        except Exception as e:  # noqa: BLE001
            out["errors"][tier] = "unsupported" if isinstance(e, KeyError) and tier not in tiers else str(e)
    return out


@dataclass
class Registry:
    """Model files of a folder, by the tier that needs them."""

    folder: str
    tiers: dict[str, tuple[str, ...]]

    def missing(self, tier: str) -> list[str]:
        return [f for f in self.tiers[tier] if not os.path.isfile(os.path.join(self.folder, f))]

    def available(self) -> dict[str, bool]:
        return {t: not self.missing(t) for t in self.tiers}

    def hashes(self) -> Iterator[tuple[str, str]]:
        """(file, sha256) of the files that are there."""
        for f in sorted({x for fs in self.tiers.values() for x in fs}):
            at = os.path.join(self.folder, f)
            if os.path.isfile(at):
                with open(at, "rb") as h:
                    yield f, hashlib.file_digest(h, "sha256").hexdigest()
