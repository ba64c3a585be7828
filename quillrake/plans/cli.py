"""Command line: ingest, ingest-dir, search, list, info, delete, stats, reprocess."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quillrake.plans.engine import Engine


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillrake")
    top.add_argument("--data", default="./data", help="folder of the store")
    sub = top.add_subparsers(dest="command", required=True)
    for name, words in (("ingest", ["path"]), ("ingest-dir", ["path"]), ("search", ["query"]), ("list", []), ("info", ["document_id"]), ("delete", ["document_id"]), ("stats", []), ("reprocess", [])):
        one = sub.add_parser(name)
        for w in words:
            one.add_argument(w)
        if name == "ingest-dir":
            one.add_argument("--recursive", action="store_true")
        if name == "search":
            one.add_argument("--top-k", type=int, default=5)
            one.add_argument("--hybrid", action="store_true")
            one.add_argument("--document")
        if name == "info":
            one.add_argument("--outline", action="store_true")
            one.add_argument("--chunks", action="store_true")
        if name == "delete":
            one.add_argument("--yes", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    engine = Engine(spark or SparkSession.builder.appName("quillrake").getOrCreate(), args.data)
    say = print
    if args.command in ("ingest", "ingest-dir"):
        for r in engine.ingest(args.path, recursive=getattr(args, "recursive", False)).orderBy("file_path").select("document_id", "status", "child_count", "error_message").collect():
            say(f"{r.document_id}  {r.status}  {r.child_count} chunks" + (f"  {r.error_message}" if r.error_message else ""))
    elif args.command == "search":
        hits = engine.hybrid_search(args.query, args.top_k, args.document) if args.hybrid else engine.search(args.query, args.top_k, args.document)
        for i, r in enumerate(hits.collect(), 1):
            say(f"{i}. [{r.score:.4f}] {r.document_id}\n   {r.text[:200]}")
    elif args.command == "list":
        for r in engine.documents().orderBy("file_path").select("document_id", "file_path", "status", "child_count").collect():
            say(f"{r.document_id}  {r.status}  {r.child_count} chunks  {r.file_path}")
    elif args.command == "info":
        found = engine.documents(document_id=args.document_id).collect()
        if not found:
            say(f"no document {args.document_id}", file=sys.stderr)
            return 1
        for k, v in found[0].asDict().items():
            say(f"{k}: {v}")
        if args.outline:
            for r in engine.outline(args.document_id).collect():
                say("  " * r.depth + r.title)
        if args.chunks:
            rows = engine.children(args.document_id)
            for r in rows.limit(10).collect():
                say(f"[{r.chunk_idx}] {r.token_count} tokens: {r.text[:100]}")
            if (more := rows.count() - 10) > 0:
                say(f"... and {more} more")
    elif args.command == "delete":
        if not args.yes:
            say("add --yes to delete", file=sys.stderr)
            return 1
        say(engine.delete(args.document_id))
    elif args.command == "stats":
        for k, v in engine.statistics().first().asDict().items():
            say(f"{k}: {v}")
    else:
        say(f"{engine.reprocess_all().count()} documents")
    return 0


if __name__ == "__main__":
    sys.exit(main())
