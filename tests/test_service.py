import json
import os
import struct
import threading
import time
import urllib.error
import urllib.request

import numpy as np
import pytest

from lamplight.functions import media
from lamplight.service import Service, server, with_headroom
from lamplight.settings import InvalidSetting, Settings


@pytest.fixture(scope="module")
def http(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("root")
    (root / "d").mkdir()
    (root / "d/a.txt").write_text("a deposit ledger of the bank")
    (root / "b.txt").write_text("another text")
    s = Service(spark, str(tmp_path_factory.mktemp("corpora")), [str(root)], token="secret")
    web = server(s, port=0)
    threading.Thread(target=web.serve_forever, daemon=True).start()

    def ask(path, body=None, token="secret", method=None):
        r = urllib.request.Request(f"http://127.0.0.1:{web.server_port}{path}", None if body is None else json.dumps(body).encode(), {"X-Submit-Token": token} if token else {}, method=method)
        try:
            with urllib.request.urlopen(r) as x:
                return x.status, json.loads(x.read() or b"null")
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    yield ask, str(root)
    web.shutdown()
    s.close()


def test_a_job_over_http(http):
    ask, root = http
    assert ask("/health")[1]["status"] == "ok" and ask("/settings")[1]["ranges"]["workers"] == [1, 64] and ask("/nowhere")[0] == 404
    assert ask("/index", {"paths": [root], "output": "mine"}, token=None)[0] == 401 and ask("/index", {"paths": [root], "output": "mine"}, token="wrong")[0] == 401
    for bad in ({"paths": ["/etc"], "output": "mine"}, {"paths": [root], "output": "../x"}, {"paths": [], "output": "mine"}, {"paths": [root], "output": "mine", "settings": {"workers": 999}}, [1]):
        assert ask("/index", bad)[0] == 400
    assert ask("/corpus/status?output=mine")[0] == 404
    code, made = ask("/index", {"paths": [root], "output": "mine"})
    assert code == 200 and made["status"] == "queued"
    until = time.time() + 120
    while (job := ask(f"/jobs/{made['id']}")[1])["status"] in ("queued", "running") and time.time() < until:
        time.sleep(0.5)
    assert job["status"] == "complete" and job["result"]["files"] == 2 and job["progress"]["processed"] == 2
    assert ask(f"/jobs/{made['id']}/cancel", {})[1]["cancelled"] is False and ask("/jobs/none")[0] == 404
    found = ask("/corpus/search?output=mine&mode=text&q=ledger")[1]
    assert found["status"] == "ready" and len(found["hits"]) == 1
    near = ask("/corpus/search?output=mine&q=deposit%20ledger&limit=900")[1]
    assert near["limit"] == 100 and near["path"] == "scan" and near["hits"][0]["name"] == "a.txt"
    assert ask("/corpus/search?output=mine&q=%20")[0] == 400 and ask("/corpus/search?output=mine&q=x&mode=odd")[0] == 400 and ask("/corpus/search?output=mine&q=x&limit=y")[0] == 400
    assert ask(f"/corpus/documents/{found['hits'][0]['id']}/text?output=mine")[1]["text"].startswith("a deposit") and ask("/corpus/documents/99/text?output=mine")[0] == 404
    assert ask("/corpus/status?output=mine")[1]["indexed_files"] == 2
    rows = ask(f"/corpus/tree?output=mine&path={root}")[1]
    assert [(r["name"], r["is_dir"], r["indexed"]) for r in rows] == [("d", True, False), ("b.txt", False, True)] and ask("/corpus/tree?output=mine&path=/etc")[0] == 400
    assert ask("/runtime", {"extract": 900})[1]["extract"] == 64 and ask("/runtime", {"nope": 1})[0] == 400 and ask("/runtime")[1]["extract"] == 64


def test_a_service_beyond_the_machine_needs_a_token(http, spark, tmp_path):
    s = Service(spark, str(tmp_path), [str(tmp_path)])
    with pytest.raises(InvalidSetting):
        server(s, "0.0.0.0", 0)
    s.close()
    assert with_headroom(Settings(headroom=50, workers=8), 8).workers == 4


def jpeg(order="<"):
    """A JPEG head with camera, times, place and orientation."""
    data, heap = b"", b""
    base = 8

    def directory(at, rows):
        nonlocal heap
        body, extra, start = struct.pack(f"{order}H", len(rows)), b"", at + 2 + 12 * len(rows) + 4
        for tag, kind, n, value in rows:
            raw = value if isinstance(value, bytes) else struct.pack(f"{order}{'H' if kind == 3 else 'I'}", value)
            if len(raw) > 4:
                body += struct.pack(f"{order}HHII", tag, kind, n, start + len(extra))
                extra += raw
            else:
                body += struct.pack(f"{order}HHI", tag, kind, n) + raw.ljust(4, b"\0")
        return body + b"\0" * 4 + extra

    text = lambda t: t.encode() + b"\0"
    ratio = lambda *x: b"".join(struct.pack(f"{order}II", a, b) for a, b in x)
    taken = [(0x9003, 2, 20, text("2024:05:06 07:08:09"))]
    place = [(1, 2, 2, text("S")), (2, 5, 3, ratio((10, 1), (30, 1), (3600, 100))), (3, 2, 2, text("E")), (4, 5, 3, ratio((20, 1), (0, 1), (0, 1)))]
    first = lambda a, b: [(0x010F, 2, 6, text("Kamra")), (0x0110, 2, 10, text("Kamra X 9")), (0x0112, 3, 1, 6), (0x8769, 4, 1, a), (0x8825, 4, 1, b)]
    one = len(directory(base, first(0, 0)))
    two = len(directory(base + one, taken))
    block = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", 8) + directory(base, first(base + one, base + one + two)) + directory(base + one, taken) + directory(base + one + two, place) + data + heap
    app = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xda"


@pytest.mark.parametrize("order", ["<", ">"])
def test_image_metadata(order):
    got = media.exif(jpeg(order))
    assert (got["camera"], got["datetime"], got["orientation"]) == ("Kamra X 9", "2024-05-06T07:08", 6)
    assert got["latitude"] == pytest.approx(-10.51) and got["longitude"] == 20
    whole = jpeg(order)
    for k in range(0, len(whole), 7):
        media.exif(whole[:k])  # a cut file never fails
    assert media.exif(b"") is None and media.exif(b"\x89PNG") is None


def test_model_outputs():
    logits = np.full((3, 4), -9.0)
    logits[0, 2], logits[1, 1], logits[2, 0] = 3.0, 0.0, -1.0
    assert [(a, round(b, 3)) for a, b in media.detections(logits, ["a", "b", "c", "d"])] == [("c", 0.953), ("b", 0.5)]
    assert media.detections(logits, {2: "c"}) == [("c", pytest.approx(0.9526, abs=1e-3))] and media.detections(np.zeros((0, 4)), []) == []
    n = 4 * 4
    cls, obj, box, kps = np.zeros(n), np.zeros(n), np.zeros((n, 4)), np.zeros((n, 10))
    for cell, q in ((5, 0.98), (6, 0.95), (15, 0.99)):
        cls[cell] = obj[cell] = q
        box[cell, 2:] = np.log(2.0)
    box[15, 2:] = np.log(0.5)  # too small
    got = media.faces({16: (cls, obj, box, kps)}, 64)
    assert len(got) == 1  # the second overlaps it by a third
    assert got[0]["quality"] == pytest.approx(0.98) and got[0]["box"].tolist() == [0, 0, 32, 32] and got[0]["points"][0].tolist() == [16, 16]
    turned = media.FACE_POINTS @ np.array([[0, 1], [-1, 0]]) * 2 + 7
    m = media.similarity(turned)
    assert np.allclose(turned @ m[:, :2].T + m[:, 2], media.FACE_POINTS) and media.similarity(np.ones((5, 2))) is None
    image = np.arange(112 * 112, dtype=float).reshape(112, 112, 1)
    assert np.allclose(media.aligned(image, np.array([[1, 0, 0], [0, 1, 0]], float)), image)
    assert media.aligned(image, np.array([[1, 0, -0.5], [0, 1, 0]], float))[3, 4, 0] == pytest.approx((image[3, 4, 0] + image[3, 5, 0]) / 2)
    assert media.chosen_frames([1, 2, 3], list(range(9)), 12) == [1, 2, 3] and media.chosen_frames([1], list(range(9)), 3) == [0, 3, 6] and media.chosen_frames([1, 2], [5], 9) == [1, 2]
    assert media.within_limits(100, 100) is None and media.within_limits(20_000, 20_000) == "decode-limit"
    assert np.allclose(media.unit_rows(np.array([[3.0, 4.0], [0, 0]])), [[0.6, 0.8], [0, 0]]) and media.sigmoid(np.array([-1000.0, 0, 1000])).tolist() == [0, 0.5, 1]

    def broken(_):
        raise ValueError("no model")

    seen = media.ladder("captions", {"meta": lambda i: {"phash": "00"}, "tags": broken}, None)
    assert seen["mode"] == "meta" and seen["errors"] == {"tags": "no model", "captions": "unsupported"}


def test_registry(tmp_path):
    (tmp_path / "a.onnx").write_bytes(b"x")
    r = media.Registry(str(tmp_path), {"tags": ("a.onnx",), "faces": ("a.onnx", "b.onnx")})
    assert r.available() == {"tags": True, "faces": False} and r.missing("faces") == ["b.onnx"] and len(dict(r.hashes())["a.onnx"]) == 64
    assert os.path.isdir(r.folder)
