"""Command line: python -m deltaloom --root FOLDER apply STATEMENT | source NAME PARQUET KEY... | run | status | check | release NAME KEY=VALUE... | dump | restore FILE."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from deltaloom.errors import EngineError
from deltaloom.sources.changelog import ChangeLog
from deltaloom.streaming.engine import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="deltaloom", description="Maintain derived tables of definitions under a folder.")
    p.add_argument("--root", required=True, help="the engine's folder, on storage that driver and executors share")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("apply", help="run one statement").add_argument("statement")
    s = sub.add_parser("source", help="register a source")
    s.add_argument("name")
    s.add_argument("parquet")
    s.add_argument("key", nargs="+")
    r = sub.add_parser("run", help="build what waits and drain the change log")
    r.add_argument("--stream", metavar="CHECKPOINT", help="keep draining, with this checkpoint folder")
    sub.add_parser("status", help="status of every transform").add_argument("name", nargs="?")
    sub.add_parser("check", help="compare targets with full recomputes").add_argument("name", nargs="*")
    x = sub.add_parser("release", help="try a held key again")
    x.add_argument("name")
    x.add_argument("key", nargs="+", help="column=value")
    sub.add_parser("dump", help="all definitions as statements")
    sub.add_parser("restore", help="apply dumped statements").add_argument("file")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> object:
    e = Engine(spark, args.root)
    if args.verb == "apply":
        return e.apply(args.statement)
    if args.verb == "source":
        e.source(args.name, spark.read.parquet(args.parquet), args.key)
        return {"source": args.name}
    if args.verb == "run":
        built = e.build()
        if args.stream:
            ChangeLog(e).stream(args.stream).awaitTermination()
        return {"built": built, "seq": ChangeLog(e).drain()}
    if args.verb == "status":
        return {n: e.status(n) for n in ([args.name] if args.name else e.definitions())}
    if args.verb == "check":
        return [e.self_check(n) for n in args.name or e.definitions()]
    if args.verb == "release":
        return {"released": e.release_key(args.name, **dict(x.split("=", 1) for x in args.key))}
    if args.verb == "dump":
        return e.dump_definitions_sql()
    with open(args.file) as f:
        return {"restored": e.restore_definitions_sql(f.read())}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("deltaloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        out = run(spark, args)
    except EngineError as e:
        print(e, file=sys.stderr)
        return 1
    print(out if isinstance(out, str) else json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
