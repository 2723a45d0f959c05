"""Command line: python -m lamplight index|search|vector-search|vector-index|top-folder|analyze|status|compact|serve."""

from __future__ import annotations

import argparse
import json
import sys

from lamplight.operators import sinks, stats
from lamplight.operators.corpus import Corpus
from lamplight.operators.embedding import HashingEmbedder, query_vector
from lamplight.operators.vector_search import VectorIndex, clamp_limit, hydrate
from lamplight.session import local_session
from lamplight.settings import load, merged


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lamplight", description=__doc__)
    p.add_argument("--corpus", required=True, help="folder of the corpus")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("roots", nargs="+")
    i.add_argument("--overwrite", action="store_true")
    i.add_argument("--no-resume", action="store_true")
    i.add_argument("--config", help="YAML file of settings")
    i.add_argument("--include", action="append", help="a file relative to a root; only these are taken")
    i.add_argument("--set", action="append", default=[], metavar="NAME=JSON")
    for name, limit in (("search", 20), ("vector-search", 10), ("top-folder", 10)):
        s = sub.add_parser(name)
        s.add_argument("query")
        s.add_argument("--limit", type=int, default=limit)
        s.add_argument("--fuzzy", action="store_true")
    v = sub.add_parser("vector-index")
    v.add_argument("--status", action="store_true")
    v.add_argument("--tier", choices=("float", "int8", "bit"), default="int8")
    v.add_argument("--drop", action="store_true")
    w = sub.add_parser("serve", help="HTTP access to the corpora below the folder")
    w.add_argument("roots", nargs="+")
    w.add_argument("--host", default="127.0.0.1")
    w.add_argument("--port", type=int, default=8787)
    w.add_argument("--config", help="YAML file of settings")
    w.add_argument("--token", help="what requests that change something must show")
    sub.add_parser("analyze")
    sub.add_parser("status")
    sub.add_parser("compact", help="merge all parts and delete what the newest snapshot does not name; no other run may write")
    return p


def main(args: list[str]) -> int:
    a = parser().parse_args(args)
    spark = local_session()
    model = HashingEmbedder()
    out: object
    if a.command == "index":
        from lamplight.plans.indexer import index, summary

        request = {k: json.loads(v) for k, _, v in (x.partition("=") for x in a.set)}
        out = summary(index(spark, a.roots, a.corpus, model, merged(load(a.config), request), not a.no_resume, a.overwrite, include=a.include))
    elif a.command == "serve":
        from lamplight.service import Service, server

        server(Service(spark, a.corpus, a.roots, a.token, load(a.config)), a.host, a.port).serve_forever()
        out = None
    else:
        corpus = Corpus(spark, a.corpus)
        chunks = corpus.table("chunks")
        job = corpus.meta().get("last_job_started_at")
        if a.command == "search":
            out = [r.asDict() for r in corpus.search(a.query, a.limit, a.fuzzy).collect()]
        elif a.command == "top-folder":
            out = [r.asDict() for r in corpus.top_folders(a.query, a.limit).collect()]
        elif a.command == "vector-search":
            hits, how = VectorIndex(spark, f"{a.corpus}/vectors").search(chunks, query_vector(a.query, model), clamp_limit(a.limit), model.name, job)
            out = {"how": how, "hits": [r.asDict() for r in hydrate(hits, chunks, corpus.table("files")).collect()]}
        elif a.command == "vector-index":
            v = VectorIndex(spark, f"{a.corpus}/vectors")
            out = v.describe() if a.status else v.drop() if a.drop else json.loads(v.build(chunks, model.name, model.width, a.tier, job).to_json())
        elif a.command == "compact":
            out = {"merged": corpus.compact(everything=True), "deleted": corpus.expire(keep=1)}
        elif a.command == "analyze":
            out = sinks.report(corpus.table("files"))
        else:
            out = stats.status(corpus.table("files"), chunks, int(corpus.meta().get("last_discovered_files", 0))).first().asDict()
    print(json.dumps(out, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
