"""python -m siftwood search|index|stats|init: a thin command line over the engine."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from siftwood import __version__
from siftwood.functions.embed import EMBEDDERS
from siftwood.plans.engine import Engine
from siftwood.sources.sinks import print_results


def main() -> None:
    top = argparse.ArgumentParser(prog="siftwood", description="Search a project's files.")
    top.add_argument("-v", "--version", action="version", version=f"siftwood {__version__}")
    sub = top.add_subparsers(dest="command")
    search = sub.add_parser("search", help="find the chunks that answer a query")
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=5)
    search.add_argument("--format", choices=["text", "json"], default="text")
    search.add_argument("--detail", choices=["full", "outline"], default="full")
    init = sub.add_parser("init", help="choose the model of a project's index, and build it")
    init.add_argument("--model", choices=sorted(EMBEDDERS))
    for p in (search, init, sub.add_parser("index", help="bring the index up to date"), sub.add_parser("stats", help="show what the index holds")):
        p.add_argument("--root")
    a = top.parse_args()
    if a.command is None:
        top.print_help()
        return
    spark = SparkSession.builder.appName("siftwood").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, a.root)
    if a.command == "search":
        rows = engine.search(a.query, a.top_k, a.detail).orderBy("place").collect()
        drop = ("query_id", "place")
        print(print_results(rows) if a.format == "text" else json.dumps([{k: v for k, v in r.asDict().items() if k not in drop and v is not None} for r in rows], indent=2))
    elif a.command == "init":
        if a.model:
            engine.configure(model=a.model)
        engine = Engine(spark, a.root)
        print(json.dumps({"model": engine.model, **engine.build()}, indent=2))
    else:
        print(json.dumps({**engine.build(), "throughput": engine.throughput} if a.command == "index" else engine.stats(), indent=2))


if __name__ == "__main__":
    main()
