"""Evaluation: retrieval quality, context size, and paired comparison of two arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwood.functions.text import byte_tokens, sign_test

from .median import medians

# An answer of this many lines or more locates nothing; characters of a target line to look for.
MAX_RANGE, SHOWN_CHARS = 150, 80


def resolve_targets(targets: DataFrame, lines: DataFrame) -> DataFrame:
    """(case_id, path, line) of targets (case_id, path, line, pattern).

    A pattern resolves to its first matching line of lines (path, ln, text); one that matches
    nothing raises an error, so that a stale case can't pass unnoticed.
    """
    asked = targets.filter("pattern IS NOT NULL")
    found = asked.join(lines.select("path", "ln", F.col("text").alias("_t")), "path", "left")
    first = found.groupBy("case_id", "path", "pattern").agg(F.min(F.when(F.rlike(F.col("_t"), F.col("pattern")), F.col("ln"))).alias("line"))
    told = F.when(F.col("line").isNull(), F.raise_error(F.concat(F.lit("target not found: "), "path", F.lit(" /"), "pattern", F.lit("/")))).otherwise(F.col("line"))
    return targets.filter("pattern IS NULL").select("case_id", "path", "line").unionByName(first.select("case_id", "path", told.alias("line")))


def rank_of(cases: DataFrame, targets: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, rank): the first result (case_id, place, path, line_start, line_end) that covers a target; null if none."""
    t = targets.select("case_id", F.col("path").alias("t_path"), F.col("line").alias("t_line"))
    inside = F.col("t_line").isNull() | F.col("t_line").between(F.col("line_start"), F.col("line_end"))
    hits = results.join(t, (results["case_id"] == t["case_id"]) & (F.col("path") == F.col("t_path")) & inside).groupBy(results["case_id"]).agg(F.min("place").alias("rank"))
    return cases.select("case_id").join(hits, "case_id", "left")


def grade_answers(answers: DataFrame, spans: DataFrame) -> DataFrame:
    """(run_id, status, rank) of runs with answers array<struct<path, start, end>> against spans (run_id, path, lo, hi).

    Answers that overlap a span and aren't too wide are hits; the first hit is the rank.
    """
    a = answers.select("run_id", F.posexplode("answers").alias("pos", "a")).filter(F.col("a.end") - F.col("a.start") < MAX_RANGE)
    s = spans.select(F.col("run_id").alias("s_run"), F.col("path").alias("s_path"), "lo", "hi")
    meets = F.col("lo").isNull() | ((F.col("a.start") <= F.col("hi")) & (F.col("a.end") >= F.col("lo")))
    hits = a.join(s, (F.col("run_id") == F.col("s_run")) & (F.col("a.path") == F.col("s_path")) & meets).groupBy("run_id").agg((F.min("pos") + 1).alias("rank"))
    status = F.when(F.size("answers") == 0, "no_answer").when(F.col("rank").isNotNull(), "correct").otherwise("wrong")
    return answers.join(hits, "run_id", "left").select("run_id", status.alias("status"), "rank")


def token_costs(rows: DataFrame) -> DataFrame:
    """Adds full_read and outline_read to rows with rank and the tokens full, outline, hit and file: a miss pays for the file."""
    miss = F.col("rank").isNull()
    return rows.withColumn("full_read", F.col("full") + F.when(miss, F.col("file")).otherwise(0)).withColumn("outline_read", F.col("outline") + F.when(miss, F.col("file")).otherwise(F.col("hit")))


def outline_shows(snippet: Column, target_lines: Column) -> Column:
    """Whether one of the target lines (stripped, shortened) is in the outline; true without target lines."""
    short = F.transform(target_lines, lambda x: F.left(F.trim(x), F.lit(SHOWN_CHARS)))
    return (F.size(short) == 0) | F.exists(short, lambda x: F.contains(snippet, x))


def quality_measures(k: int = 5) -> list[Column]:
    hit = lambda n: F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0)).alias(f"hit_{n}")
    return [F.count(F.lit(1)).alias("n"), *[hit(n) for n in sorted({1, 3, k})], (F.sum(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))) / F.count(F.lit(1))).alias("mrr")]


def shown_share() -> Column:
    """The share of rows whose outline shows its target, of those where that is known; null if it is known of none."""
    return F.avg(F.col("shows").cast("int")).alias("shown")


def quality_report(rows: DataFrame, k: int = 5, more: list[Column] | None = None) -> DataFrame:
    """Measures per (split, repo), and per split with repo ALL."""
    out = rows.rollup("split", "repo").agg(F.grouping("repo").alias("_r"), F.grouping("split").alias("_s"), *quality_measures(k), *(more or []))
    return out.filter("_s = 0").withColumn("repo", F.when(F.col("_r") == 1, "ALL").otherwise(F.col("repo"))).drop("_r", "_s")


def arm_report(runs: DataFrame) -> DataFrame:
    """Per arm of runs (arm, status, rank, input_tokens, output_tokens, turns, seconds, cost_usd): shares, tokens, turns, time, cost."""
    tokens = F.col("input_tokens") + F.col("output_tokens")
    share = lambda s: F.avg(F.when(F.col("status") == s, 1.0).otherwise(0.0)).alias(s)
    means = runs.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), *[share(s) for s in ("correct", "wrong", "no_answer", "error")], F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("first"),
        F.avg(tokens).alias("tokens_mean"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost"),
    )
    middles = medians(runs, ["arm"], {"tokens_median": tokens, "turns_median": F.coalesce("turns", F.lit(0)), "seconds_median": F.col("seconds")}).withColumnRenamed("arm", "_arm")
    both = means.join(middles, F.col("arm").eqNullSafe(F.col("_arm")), "left")
    return both.select("arm", "n", "correct", "wrong", "no_answer", "error", "first", "tokens_median", "tokens_mean", "turns_median", "seconds_median", "cost")


def tool_calls(runs: DataFrame, tool: str | None = None) -> DataFrame:
    """(arm, name, calls_per_run, runs_using) from the map column tools."""
    n = runs.groupBy("arm").agg(F.count(F.lit(1)).alias("n"))
    calls = runs.select("arm", F.explode("tools").alias("name", "calls")).groupBy("arm", "name").agg(F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("runs_using"))
    out = calls.join(F.broadcast(n), "arm").select("arm", "name", (F.col("calls") / F.col("n")).alias("calls_per_run"), "runs_using")  # a row per arm
    return out if tool is None else out.filter(F.col("name") == tool)


def models_of(runs: DataFrame) -> DataFrame:
    return runs.agg(F.array_join(F.sort_array(F.collect_set("model")), ", ").alias("models"))


def pairs_of(runs: DataFrame) -> DataFrame:
    """Complete pairs of both arms per (case, rep), one shuffle: the columns of each arm side by side.

    The last run of an arm counts, by run_no; where there is none, or it is equal, the one of the greatest status, tokens and turns.
    """
    fields = F.struct("status", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.coalesce("turns", F.lit(0)).alias("turns"))
    order = F.struct(F.col("run_no") if "run_no" in runs.columns else F.lit(0), fields)
    arm = lambda a: F.max_by(F.when(F.col("arm") == a, fields), F.when(F.col("arm") == a, order)).alias(a)
    both = runs.groupBy("case", "rep").agg(arm("on"), arm("off")).filter("on IS NOT NULL AND off IS NOT NULL")
    return both.select("case", "rep", (F.col("on.status") == "correct").alias("ok_on"), (F.col("off.status") == "correct").alias("ok_off"), F.col("on.tokens").alias("tokens_on"), F.col("off.tokens").alias("tokens_off"), F.col("on.turns").alias("turns_on"), F.col("off.turns").alias("turns_off"))


def pair_report(pairs: DataFrame) -> DataFrame:
    """One row: tallies, sign test, and token ratio where both arms were right."""
    on, off = F.col("ok_on"), F.col("ok_off")
    ratio = F.when(on & off, F.col("tokens_on") / F.greatest(F.col("tokens_off"), F.lit(1)))
    right = lambda c: F.when(on & off, c)
    tally = pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(on & off).alias("both"), F.count_if(on & ~off).alias("only_on"), F.count_if(off & ~on).alias("only_off"), F.count_if(~on & ~off).alias("neither"),
        F.count_if(ratio < 1).alias("cheaper"),
    )
    middles = medians(pairs, [], {"ratio_median": ratio, "turns_on_median": right(F.col("turns_on")), "turns_off_median": right(F.col("turns_off"))})
    tally = tally.crossJoin(F.broadcast(middles))  # both are one row
    tally = tally.select("pairs", "both", "only_on", "only_off", "neither", "ratio_median", "cheaper", "turns_on_median", "turns_off_median")
    return tally.withColumn("p_value", sign_test(F.col("only_on"), F.col("only_off")))


def still_to_do(cases: DataFrame, done: DataFrame, repeats: int) -> DataFrame:
    """(case, rep, arm) of all repeats and arms without those in done."""
    plan = cases.select("case", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")).select("case", "rep", F.explode(F.array(F.lit("off"), F.lit("on"))).alias("arm"))
    return plan.join(done, ["case", "rep", "arm"], "left_anti")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def file_tokens(text: Column) -> Column:
    return byte_tokens(text)
