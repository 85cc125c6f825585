"""Command line: ingest a folder, search, show the status of a collection, list collections, delete documents, run an evaluation."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from lexigrid import defaults as D
from lexigrid.errors import LexigridError
from lexigrid.functions.text import snippet
from lexigrid.plans.engine import Engine
from lexigrid.providers import HashEmbedder
from lexigrid.session import session
from lexigrid.sources.files import load_directory
from lexigrid.sources.judgments import load_judgments


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexigrid")
    parser.add_argument("--root", required=True, help="folder of the collections")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("ingest", "search", "status", "list", "eval", "delete"):
        one = verbs.add_parser(verb)
        if verb != "list":
            one.add_argument("collection")
        if verb in {"ingest", "eval"}:
            one.add_argument("folder")
        if verb == "eval":
            one.add_argument("judgments")
            one.add_argument("--out", help="a new folder for the report")
        if verb == "delete":
            one.add_argument("document_ids", nargs="+")
        if verb == "search":
            one.add_argument("query")
            one.add_argument("--mode", choices=D.MODES, default="bm25")
            one.add_argument("--top-k", type=int, default=D.TOP_K)
        if verb in {"ingest", "search"}:
            one.add_argument("--hash-embedder", action="store_true")
    args = parser.parse_args(argv)
    spark = session()
    engine = Engine(spark, args.root)
    embedder = HashEmbedder() if getattr(args, "hash_embedder", False) else None
    try:
        if args.verb == "ingest":
            print(json.dumps(engine.ingest_directory(args.collection, args.folder, embedder=embedder)))
        elif args.verb == "search":
            queries = spark.createDataFrame([(0, args.query)], "query_id long, query string")
            hits = engine.search(args.collection, queries, args.mode, args.top_k, embedder=embedder)
            for r in hits.select("rank", "score", "citation.source", "citation.start_offset", "citation.end_offset", snippet(F.col("content")).alias("text")).orderBy("rank").collect():
                print(json.dumps(r.asDict(), ensure_ascii=False))
        elif args.verb == "status":
            print(json.dumps(engine.status(args.collection)))
        elif args.verb == "list":
            print(json.dumps(engine.collections()))
        elif args.verb == "delete":
            print(json.dumps(engine.delete(args.collection, args.document_ids)))
        else:
            report = engine.evaluate(args.collection, load_judgments(spark, args.judgments), load_directory(spark, args.folder), args.folder)
            for r in report.means.orderBy("stage", "category").collect():
                print(json.dumps(r.asDict()))
            if args.out:
                report.write(args.out)
    except LexigridError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
