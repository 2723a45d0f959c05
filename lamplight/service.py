"""HTTP access to corpora below one folder: jobs, status, search and texts, over the standard library's server.

Reads are open; what changes something needs the submit token where one is set.
"""

from __future__ import annotations

import hmac
import json
import os
import re
import threading
from collections.abc import Callable
from dataclasses import asdict, replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lamplight.operators import stats
from lamplight.operators.corpus import Corpus
from lamplight.operators.embedding import HashingEmbedder, LazyEmbedder, query_vector
from lamplight.operators.jobs import FINAL, JobQueue, QueueFull
from lamplight.operators.search import clamp_limit
from lamplight.operators.vector_search import VectorIndex, hydrate
from lamplight.plans.indexer import index, summary
from lamplight.settings import RANGES, InvalidSetting, Runtime, Settings, corpus_name, merged

# The header of the token, and the modes of a search.
TOKEN_HEADER = "X-Submit-Token"
MODES = ("text", "semantic", "semantic_fast")


class Refused(Exception):
    """An answer other than 200."""

    def __init__(self, code: int, error: str):
        super().__init__(error)
        self.code, self.error = code, error


class Service:
    """The routes as methods; a thread runs one job at a time."""

    def __init__(self, spark: SparkSession, folder: str, roots: list[str], token: str | None = None, config: dict | None = None, load: Callable = HashingEmbedder, tools: dict | None = None):
        self.spark, self.folder, self.roots, self.token = spark, folder.rstrip("/"), [os.path.realpath(r) for r in roots], token
        self.config, self.runtime, self.tools = config or {}, Runtime(), tools
        self.model, self.queue = LazyEmbedder(load), JobQueue(self._index)
        self.wake, self.stopping = threading.Event(), False
        self.worker = threading.Thread(target=self._work, daemon=True)
        self.worker.start()

    def _work(self) -> None:
        while not self.stopping:
            if self.queue.step() is None:
                self.wake.wait(0.2)
                self.wake.clear()

    def close(self) -> None:
        self.stopping = True
        self.wake.set()
        self.worker.join(timeout=60)

    def _index(self, request: dict) -> dict:
        job = next(r for r in self.queue.records.values() if r["request"] is request)
        roots = [os.path.realpath(p) for p in request["paths"]]
        return summary(index(
            self.spark, roots, f"{self.folder}/{request['output']}", self.model.get(), merged(self.config, request.get("settings")), request.get("resume", True), request.get("overwrite", False), self.tools,
            cancelled=lambda: job["status"] == "cancelling", include=request.get("include_paths"), progress=lambda p: job.update(progress=asdict(p)),
        ))

    def _corpus(self, name: str) -> Corpus:
        c = Corpus(self.spark, f"{self.folder}/{self._name(name)}")
        if not c.exists():
            raise Refused(404, f"there is no corpus {name}")
        return c

    @staticmethod
    def _name(name: str) -> str:
        try:
            return corpus_name(name)
        except InvalidSetting as e:
            raise Refused(400, str(e)) from e

    # ---- routes

    def health(self) -> dict:
        states = [r["status"] for r in self.queue.records.values()]
        return {"status": "ok", "busy": any(s not in FINAL for s in states), "jobs": len(states), "model": self.model.state}

    def settings(self) -> dict:
        return {"values": asdict(merged(self.config)), "ranges": RANGES, "built_in": asdict(Settings())}

    def submit(self, body: dict) -> dict:
        paths, name = body.get("paths"), self._name(str(body.get("output", "")))
        if not isinstance(paths, list) or not paths or not all(isinstance(p, str) for p in paths):
            raise Refused(400, "paths is a list of folders")
        for p in map(os.path.realpath, paths):
            if not any(p == r or p.startswith(r.rstrip("/") + "/") for r in self.roots):
                raise Refused(400, f"{p} is not below a root of this service")
        try:
            merged(self.config, body.get("settings"))
            job = self.queue.submit(body | {"output": name})
        except InvalidSetting as e:
            raise Refused(400, str(e)) from e
        except QueueFull as e:
            raise Refused(429, str(e)) from e
        self.wake.set()
        return {"id": job, "status": "queued"}

    def job(self, id: str) -> dict:
        record = self.queue.records.get(id)
        if record is None:
            raise Refused(404, f"there is no job {id}")
        return {k: v for k, v in record.items()}

    def cancel(self, id: str) -> dict:
        self.job(id)
        return {"id": id, "cancelled": self.queue.cancel(id), "status": self.queue.records[id]["status"]}

    def set_runtime(self, body: dict) -> dict:
        try:
            return self.runtime.apply(body)
        except InvalidSetting as e:
            raise Refused(400, str(e)) from e

    def status(self, name: str) -> dict:
        c = self._corpus(name)
        m = c.meta()
        counts = stats.status(c.table("files"), c.table("chunks"), int(m.get("last_discovered_files", 0))).first().asDict()
        return counts | {"schema_version": int(m["schema_version"]), "indexes": VectorIndex(self.spark, f"{c.root}/vectors").describe()}

    def tree(self, name: str, folder: str) -> list[dict]:
        """Folders and files right below a folder, folders first, as far as the corpus knows them."""
        real = os.path.realpath(folder)
        if not any(real == r or real.startswith(r.rstrip("/") + "/") for r in self.roots) or not os.path.isdir(real):
            raise Refused(400, f"{folder} is no folder below a root of this service")
        rows = [(e.path, e.name, real, e.is_dir()) for e in os.scandir(real)]
        listing = self.spark.createDataFrame(rows, "path string, name string, dir string, is_dir boolean")
        return [r.asDict() for r in stats.tree(listing, self._corpus(name).table("files")).collect()]

    def text(self, name: str, id: str) -> dict:
        found = self._corpus(name).text(int(id))
        if found is None:
            raise Refused(404, f"there is no document {id}")
        return {"id": int(id), "text": found}

    def search(self, name: str, q: str, mode: str = "semantic", limit: int = 20) -> dict:
        """Hits with how they were found; no embeddings and a model that fails are states of their own."""
        if mode not in MODES:
            raise Refused(400, f"mode is one of {', '.join(MODES)}")
        if not q.strip():
            raise Refused(400, "q must not be blank")
        c, k = self._corpus(name), clamp_limit(limit)
        out = {"query": q, "mode": mode, "limit": k, "status": "ready", "hits": []}
        if mode == "text":
            return out | {"path": "index", "hits": [r.asDict() for r in c.search(q, k).collect()]}
        try:
            model = self.model.get()
        except Exception as e:  # noqa: BLE001
            return out | {"status": "unavailable", "reason": str(e)}
        chunks = c.table("chunks")
        if not chunks.filter(F.col("embedding").isNotNull()).take(1):
            return out | {"status": "no_embeddings", "reason": "the corpus has no vectors"}
        hits, how = VectorIndex(self.spark, f"{c.root}/vectors").search(chunks, query_vector(q, model), k, model.name, c.meta().get("last_job_started_at"), exact=mode == "semantic")
        found = hydrate(hits, chunks, c.table("files"))
        return out | how | {"hits": [r.asDict() for r in found.collect()]}

    # ---- dispatch

    def answer(self, method: str, target: str, headers: dict, body: bytes = b"") -> tuple[int, object]:
        """(code, value) of a request; every error is a value with an error."""
        url = urlsplit(target)
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        try:
            if method not in ("GET", "HEAD") and self.token and not hmac.compare_digest(str(headers.get(TOKEN_HEADER, "")).encode(), self.token.encode()):
                raise Refused(401, f"this request needs the header {TOKEN_HEADER}")
            given = json.loads(body) if body else {}
            if not isinstance(given, dict):
                raise Refused(400, "the body is an object")
            name = q.get("output", "corpus")
            routes: list[tuple[str, str, Callable]] = [
                ("GET", "/health", self.health), ("GET", "/settings", self.settings), ("GET", "/runtime", lambda: self.runtime.stages), ("POST", "/runtime", lambda: self.set_runtime(given)), ("POST", "/index", lambda: self.submit(given)),
                ("GET", r"/jobs/(\w+)", self.job), ("POST", r"/jobs/(\w+)/cancel", self.cancel), ("GET", "/corpus/status", lambda: self.status(name)), ("GET", "/corpus/tree", lambda: self.tree(name, q.get("path", ""))),
                ("GET", r"/corpus/documents/(\d+)/text", lambda i: self.text(name, i)), ("GET", "/corpus/search", lambda: self.search(name, q.get("q", ""), q.get("mode", "semantic"), int(q.get("limit", 20)))),
            ]
            for verb, pattern, act in routes:
                if (m := re.fullmatch(pattern, url.path)) and verb == ("GET" if method == "HEAD" else method):
                    return 200, act(*m.groups())
            raise Refused(404, f"no route {method} {url.path}")
        except Refused as e:
            return e.code, {"status": "error", "error": e.error}
        except (ValueError, TypeError) as e:
            return 400, {"status": "error", "error": str(e)}
        except Exception as e:  # noqa: BLE001
            return 503, {"status": "error", "error": str(e)[:500]}


def server(service: Service, host: str = "127.0.0.1", port: int = 8787) -> ThreadingHTTPServer:
    """Without a token only the own machine may be served."""
    if service.token is None and host not in ("127.0.0.1", "localhost", "::1"):
        raise InvalidSetting("a service beyond this machine needs a submit token")

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > 1 << 20:
                code, value = 413, {"status": "error", "error": "the body is too large"}
            else:
                code, value = service.answer(self.command, self.path, self.headers, self.rfile.read(size))
            data = json.dumps(value, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(data)

        do_GET = do_HEAD = do_POST = _reply

        def log_message(self, *args) -> None:
            """Nothing: requests hold queries."""

    return ThreadingHTTPServer((host, port), Handler)


def with_headroom(s: Settings, cores: int) -> Settings:
    """Settings whose workers leave the headroom free."""
    return replace(s, workers=min(s.workers, s.cores(cores)), embed_workers=min(s.embed_workers, s.cores(cores)))
