"""Command line: make tables from a source tree and ask them."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leanspan", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    make = sub.add_parser("index", help="make tables from a source tree")
    make.add_argument("root")
    make.add_argument("directory")
    ask = sub.add_parser("ask", help="call a tool; further arguments are name=value, values as JSON or text")
    ask.add_argument("directory")
    ask.add_argument("tool")
    ask.add_argument("arguments", nargs="*")
    sub.add_parser("status", help="what a directory's tables hold").add_argument("directory")
    run = sub.add_parser("query", help="run a registered query on a directory's tables")
    run.add_argument("directory")
    run.add_argument("name")
    run.add_argument("--limit", type=int, default=20, help="rows to print")
    return p


def arguments_of(pairs: list[str]) -> dict:
    out = {}
    for pair in pairs:
        name, sep, value = pair.partition("=")
        if not sep:
            raise SystemExit(f"{pair}: expected name=value")
        try:
            out[name] = json.loads(value)
        except ValueError:
            out[name] = value
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from leanspan.plans import queries, tools
    from leanspan.plans.ship import ship
    from leanspan.sources.discovery import to_json

    spark = spark or SparkSession.builder.appName("leanspan").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    if a.command == "index":
        print(json.dumps(tools.make_tables(spark, a.root, a.directory), sort_keys=True))
    elif a.command == "ask":
        print(tools.answer(tools.Tools(spark, a.directory), a.tool, arguments_of(a.arguments)))
    elif a.command == "status":
        print(tools.answer(tools.Tools(spark, a.directory), "status", {}))
    else:
        known = queries.queries()
        if a.name not in known:
            print(f"no query {a.name}", file=sys.stderr)
            return 2
        print(to_json(known[a.name](spark, a.directory), a.limit))
    return 0


if __name__ == "__main__":
    sys.exit(main())
