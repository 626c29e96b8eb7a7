"""Command line: ``python -m lodestone [INPUT...]`` ingests; subcommands search and look after a store.

Events are JSON lines on standard output. Exit codes: 0 done, 1 done in part, 2 wrong arguments, 3 failed, 4 locked.
"""

from __future__ import annotations

import argparse
import functools
import importlib
import json
import os
import shutil
import sys

COMMANDS = ("search", "serve", "migrate", "status", "sources", "remove", "rebuild", "doctor")


class Arguments(argparse.ArgumentParser):
    def error(self, message):
        raise SystemExit(fatal("invalid_arguments", message, 2))


def emit(kind: str, /, **fields) -> None:
    print(json.dumps({"type": kind, **fields}, default=str), flush=True)


def fatal(code: str, message: str, exit_code: int) -> int:
    emit("fatal", error_code=code, message=message)
    return exit_code


def parser() -> Arguments:
    shared = Arguments(add_help=False)
    shared.add_argument("--db", default=os.environ.get("LODESTONE_DB", "lodestone-store"))
    shared.add_argument("--embedder", default=os.environ.get("LODESTONE_EMBEDDER"), help="module:function, texts to unit vectors")
    shared.add_argument("--dimensions", type=int, default=768)
    shared.add_argument("--chunk-size", type=int, default=512)
    shared.add_argument("--overlap", type=int, default=64)
    shared.add_argument("--max-file-size", default="64MiB")
    shared.add_argument("--fail-fast", action="store_true")
    shared.add_argument("--quiet", action="store_true")
    p = Arguments(prog="lodestone", parents=[shared])
    sub = p.add_subparsers(dest="command", required=True, parser_class=Arguments)
    sub.add_parser("ingest", parents=[shared]).add_argument("inputs", nargs="+")
    s = sub.add_parser("search", parents=[shared])
    s.add_argument("query")
    s.add_argument("--mode", choices=("semantic", "lexical", "hybrid"), default="semantic")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--root")
    s.add_argument("--media-type")
    v = sub.add_parser("serve", parents=[shared])
    v.add_argument("requests")
    v.add_argument("--checkpoint", required=True)
    sub.add_parser("remove", parents=[shared]).add_argument("source")
    for name in ("migrate", "status", "sources", "rebuild", "doctor"):
        sub.add_parser(name, parents=[shared])
    return p


def embedder(args):
    from .plans.engine import hashed_embedder

    if not args.embedder:
        return hashed_embedder(args.dimensions)
    module, _, name = args.embedder.partition(":")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str], spark=None) -> int:
    if argv and argv[0] not in (*COMMANDS, "ingest") and not argv[0].startswith("-"):
        argv = ["ingest", *argv]
    try:
        args = parser().parse_args(argv)
        from .functions.text import parse_size

        most = parse_size(args.max_file_size)
        if args.chunk_size < 3 or not 0 <= args.overlap < args.chunk_size - 2:
            raise ValueError("overlap must be smaller than the window")
    except SystemExit as e:
        return e.code if isinstance(e.code, int) else 2
    except ValueError as e:
        return fatal("invalid_arguments", str(e), 2)
    from .plans.engine import Engine
    from .plans.store import StoreError

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lodestone").getOrCreate()
    try:
        engine = Engine(spark, args.db, embedder(args), args.dimensions, args.chunk_size - 2, args.overlap, most_bytes=most)
        return run(args, engine, spark)
    except StoreError as e:
        return fatal("store", str(e), 4 if "lock" in str(e) else 3)
    except ValueError as e:
        return fatal("invalid_arguments", str(e), 2)
    except Exception as e:  # noqa: BLE001  the last resort of a command line
        return fatal("runtime", f"{type(e).__name__}: {e}"[:2000], 3)


def run(args, engine, spark) -> int:
    if args.command == "ingest":
        counts = engine.ingest(args.inputs, stdin=sys.stdin.buffer, fail_fast=args.fail_fast)
        now = engine.store.snapshot().manifest
        for source, code, message in now["failures"].get(now["runs"][-1]["id"], []):
            emit("failed", source=source, error_code=code, message=message)
        if not args.quiet:
            emit("completed", run_id=now["runs"][-1]["id"], **counts)
        return 1 if counts["failed"] else 0
    if args.command == "search":
        rows = engine.search(args.query, args.mode, args.limit, args.root, args.media_type).collect()  # at most the limit
        for r in rows:
            emit("search_result", **r.asDict())
        emit("search_completed", mode=args.mode, results=len(rows), generation=engine.store.snapshot().generation())
    elif args.command == "serve":
        from .streaming.serve import MOST_RESPONSE, serve

        find = functools.partial(engine.search, budget=MOST_RESPONSE)
        serve(spark, args.requests, find, lambda lines: print("\n".join(lines), flush=True), args.checkpoint).awaitTermination()
    elif args.command == "status":
        emit("status", **engine.status())
    elif args.command == "sources":
        for root in engine.sources():
            emit("source", **root)
    elif args.command == "remove":
        emit("removed", source=args.source, roots=engine.remove(args.source))
    elif args.command == "migrate":
        engine.store.migrate()
        emit("migrated", schema_version=engine.store.snapshot().manifest["schema_version"])
    elif args.command == "rebuild":
        emit("completed", operation="rebuild", generation=engine.rebuild())
    elif args.command == "doctor":
        from .plans.store import StoreError

        try:
            state = engine.status()
        except StoreError as e:
            emit("doctor", database=str(e), helpers={})
            return 1
        emit("doctor", database=state, spark=spark.version, helpers={h: shutil.which(h) is not None for h in ("pandoc", "pdftotext", "pdfinfo", "pdftoppm", "tesseract", "git")})
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
