"""Retrieval evaluation end to end: cases of several projects searched, ranked, costed and reported."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwood.functions import text as tx
from siftwood.operators import evaluate
from siftwood.plans.engine import Engine
from siftwood.sources import corpus


def _searched(spark: SparkSession, cases: DataFrame, targets: DataFrame, root: str | Path, top_k: int) -> DataFrame:
    """One row a case of one project: rank, the tokens full, outline, hit and file, and whether the hit's outline shows the target."""
    engine = Engine(spark, root)
    engine.build()
    asked = cases.select(F.xxhash64("case_id").alias("query_id"), F.col("q").alias("query"))
    named = cases.select(F.xxhash64("case_id").alias("query_id"), "case_id")
    found = {d: engine.search(asked, top_k, d, refresh=False).join(named, "query_id") for d in ("full", "outline")}
    # the lines of the targets' files: where patterns match, and what an outline is to show
    texts = corpus.texts_of(corpus.read_files(root, targets.select("path").distinct()))
    lines = texts.select("path", F.posexplode(tx.text_lines(F.col("text"))).alias("n", "text")).select("path", (F.col("n") + 1).alias("ln"), "text")
    at = evaluate.resolve_targets(targets, lines)
    ranks = evaluate.rank_of(cases, at, found["full"])
    numbered = lines.select("path", F.col("ln").alias("line"), F.col("text").alias("said"))
    wanted = at.filter("line IS NOT NULL").join(numbered, ["path", "line"]).groupBy("case_id").agg(F.collect_list("said").alias("wanted"))
    tokens = lambda d, name: found[d].groupBy("case_id").agg(F.sum(tx.byte_tokens(F.col("snippet"))).alias(name))
    first = Window.partitionBy("case_id").orderBy("path")
    sizes = texts.select("path", tx.byte_tokens(F.col("text")).alias("file"))
    file = targets.select("case_id", "path").distinct().join(sizes, "path").withColumn("n", F.row_number().over(first)).filter("n = 1").select("case_id", "file")
    hit = lambda d: found[d].join(ranks.filter("rank IS NOT NULL"), "case_id").filter("place = rank")
    chunk = hit("full").select("case_id", tx.byte_tokens(F.col("snippet")).alias("hit"))
    shown = hit("outline").join(wanted, "case_id").select("case_id", evaluate.outline_shows(F.col("snippet"), F.col("wanted")).alias("shows"))
    parts = [ranks, tokens("full", "full"), tokens("outline", "outline"), chunk, file, shown]
    rows = reduce(lambda a, b: a.join(b, "case_id", "left"), parts, cases.select("case_id", "split", "repo"))
    return evaluate.token_costs(rows.fillna(0, ["full", "outline", "hit", "file"]))


def evaluated(spark: SparkSession, cases: DataFrame, repos: DataFrame, roots: dict[str, str | Path], top_k: int = 5) -> DataFrame:
    """Cases (repo, q, targets, split) of repositories (name, url, commit), searched in the folders that roots names.

    One row a case: (case_id, split, repo, rank, full, outline, hit, file, shows, full_read,
    outline_read).  The folders, one per repository, hold it at its commit; a repository
    without one raises an error.  shows is null where nothing was found or no line is asked for.
    """
    known = corpus.cases_of_repos(cases, repos).withColumn("case_id", tx.case_id(F.col("repo"), F.col("q"))).withColumn("split", tx.split_of(F.col("q"), F.col("split")))
    typed = corpus.typed_targets(known, ("case_id", "repo"))
    names = [r.repo for r in known.select("repo").distinct().collect()]  # a name per project
    if missing := sorted(set(names) - set(roots)):
        raise ValueError(f"no folder for {', '.join(missing)}")
    rows = [_searched(spark, known.filter(F.col("repo") == name), typed.filter(F.col("repo") == name).drop("repo"), roots[name], top_k) for name in sorted(names)]
    return reduce(DataFrame.unionByName, rows)


def report(rows: DataFrame, top_k: int = 5) -> DataFrame:
    """Quality, mean tokens and the share of visible outlines per split and repository, and per split."""
    means = [F.avg(c).cast("int").alias(c) for c in ("full_read", "outline", "outline_read", "file")]
    return evaluate.quality_report(rows, top_k, [*means, evaluate.shown_share()])
