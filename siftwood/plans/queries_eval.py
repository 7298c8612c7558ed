"""Registered queries over the evaluation layer, with their SQL.

The tables hold no evaluation runs, so these stand in: nearest vectors of the same label are
relevant results, conversations are documents with lines, and events are runs of two arms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions import outline as outlines
from siftwood.functions import text as tx
from siftwood.operators import chunk, evaluate, vector
from siftwood.operators.token_counts import count_columns
from siftwood.sources import corpus

from .queries_retrieval import query_vectors, read, vectors
from .queries_text import LINES, STRIPPED

VOCABULARY = "byte_bpe_50k.tiktoken"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    return t.select("path", (F.col("n") + 1).alias("ln"), "text")


def target_resolve(spark, d):
    """For each document: a plain path, a line, or a pattern (the first line with an e, then any line)."""
    t = read(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 3 == 1, F.lit(2)).alias("line"), F.when(F.col("doc_id") % 3 == 2, F.lit("e[a-z]*n|^")).alias("pattern"))
    return evaluate.resolve_targets(t, _lines(spark, d))


def _spans(spark, d):
    """Chunks of each document as results of the case of the same id, best first, and a target line."""
    docs = read(spark, d, "documents")
    results = docs.select(F.col("doc_id").alias("case_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("place"), "n_chars").select(
        "case_id", "place", F.concat(F.lit("f"), (F.col("case_id") % 5 + F.col("place") % 2).cast("string")).alias("path"), (F.col("place") * 10 + F.col("n_chars") % 7).cast("int").alias("line_start"), (F.col("place") * 10 + 9 + F.col("n_chars") % 7).cast("int").alias("line_end")
    )
    targets = docs.select(F.col("doc_id").alias("case_id"), F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string")).alias("path"), F.when(F.col("doc_id") % 6 > 0, (F.col("n_chars") % 60).cast("int")).alias("line"))
    return docs.select(F.col("doc_id").alias("case_id")), targets, results


def rank_of(spark, d):
    return evaluate.rank_of(*_spans(spark, d))


def answer_overlap(spark, d):
    docs = read(spark, d, "documents")
    reply = F.when(F.col("doc_id") % 4 == 0, "no idea").otherwise(F.concat(F.lit("ANSWER: ./a.py:"), (F.col("n_chars") % 300).cast("string"), F.lit("-"), (F.col("n_chars") % 300 + F.col("doc_id") % 200).cast("string"), F.lit("\nANSWER: b.py:"), (F.col("doc_id") % 90).cast("string")))
    runs = docs.select(F.col("doc_id").alias("run_id"), tx.parse_answers(reply).alias("answers"))
    spans = docs.select(F.col("doc_id").alias("run_id"), F.when(F.col("doc_id") % 2 == 0, "a.py").otherwise("b.py").alias("path"), F.when(F.col("doc_id") % 8 > 0, F.lit(40)).alias("lo"), F.when(F.col("doc_id") % 8 > 0, F.lit(90)).alias("hi"))
    return evaluate.grade_answers(runs, spans)


def _label_ranks(spark, d):
    """Rank of the first neighbour with the query's label: (query_id, rank, split, repo)."""
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    near = vector.nearest_batch(vectors(spark, d), query_vectors(spark, d), 6).filter("query_id <> chunk_id").join(labels, "chunk_id")
    asked = labels.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("own")).filter("query_id % 50 = 0")
    hits = near.join(asked, "query_id").filter("label = own").groupBy("query_id").agg(F.min("rank").alias("rank"))
    rows = asked.join(hits, "query_id", "left")
    return rows.select("query_id", F.when(F.col("rank") > 1, F.col("rank") - 1).otherwise(F.col("rank")).alias("rank"), F.when(F.col("query_id") % 100 == 0, "dev").otherwise("test").alias("split"), F.concat(F.lit("r"), (F.col("own") % 2).cast("string")).alias("repo"))


def hit_at_k(spark, d):
    q = _label_ranks(spark, d).agg(*evaluate.quality_measures(5))
    return q.select("n", *[F.round(c, 9).alias(c) for c in ("hit_1", "hit_3", "hit_5")])


def mrr(spark, d):
    return _label_ranks(spark, d).agg(*evaluate.quality_measures(5)).select(F.round("mrr", 9).alias("mrr"))


def eval_rollup(spark, d):
    q = evaluate.quality_report(_label_ranks(spark, d), 5)
    return q.select("split", "repo", "n", *[F.round(c, 9).alias(c) for c in ("hit_1", "hit_3", "hit_5", "mrr")])


def token_cost(spark, d):
    lines = outlines.stripped_lines(F.col("text"))
    head = F.array_join(outlines.prose_head(lines), "\n")
    rows = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 5 + 1).cast("int")).alias("rank"), tx.byte_tokens(F.left("text", F.lit(400))).alias("full"), tx.byte_tokens(head).alias("outline"), tx.byte_tokens(F.left("text", F.lit(200))).alias("hit"), tx.byte_tokens(F.col("text")).alias("file"))
    cost = evaluate.token_costs(rows)
    return cost.groupBy((F.col("doc_id") % 4).alias("g")).agg(*[F.avg(c).cast("int").alias(c) for c in ("full_read", "outline", "outline_read", "file")])


def _whole_costs(spark, d, counted):
    """Costs by source of whole windows as the results of their document, which look for one of its lines.

    counted(df, names) turns the text columns of these names into counts.
    """
    docs = read(spark, d, "documents").select("doc_id", "source", "text", (F.col("n_chars") % 9 + 1).alias("target"))
    outline = F.array_join(outlines.prose_head(outlines.stripped_lines(F.col("text"))), "\n")
    covers = F.col("target").between(F.col("line_start"), F.col("line_end"))
    chunks = chunk.line_windows(docs, size=5).select("doc_id", covers.alias("covers"), ((F.col("line_start") + 4) / 5).cast("int").alias("place"), F.col("text").alias("tokens"), outline.alias("short"))
    found = lambda c: F.when(F.col("covers"), F.col(c))
    cases = counted(chunks, ["tokens", "short"]).groupBy("doc_id").agg(F.sum("tokens").alias("full"), F.sum("short").alias("outline"), F.sum(found("tokens")).alias("hit"), F.min(found("place")).alias("rank"))
    files = counted(docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("file")), ["file"])
    rows = files.join(cases, "doc_id", "left").fillna(0, ["full", "outline", "hit"])
    means = [F.avg(c).cast("int").alias(c) for c in ("full_read", "outline", "outline_read", "file")]
    return evaluate.token_costs(rows).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("rank").alias("hits"), *means)


def token_cost_whole(spark, d):
    return _whole_costs(spark, d, lambda df, names: df.withColumns({n: tx.byte_tokens(F.col(n)) for n in names}))


def token_cost_bpe(spark, d):
    """token_cost_whole in tokens of a vocabulary, where its file is present."""
    import public_tokenizers

    return _whole_costs(spark, d, lambda df, names: count_columns(df, names, public_tokenizers.path(VOCABULARY)))


def outline_visible(spark, d):
    lines = outlines.stripped_lines(F.col("text"))
    split = F.split("text", "\n", -1)
    wanted = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.slice(split, F.least((F.col("doc_id") % 3 + 1).cast("int"), F.size(split)), 1))
    return read(spark, d, "documents").select("doc_id", evaluate.outline_shows(F.array_join(outlines.prose_head(lines), "\n"), wanted).alias("shows"))


def shown_rollup(spark, d):
    """Measures with the share of visible outlines per split and source; every fifth document has no line to look for."""
    shows = outline_visible(spark, d).withColumn("shows", F.when(F.col("doc_id") % 5 > 0, F.col("shows")))
    split = F.when(F.col("doc_id") % 2 == 0, "dev").otherwise("test")
    rows = read(spark, d, "documents").select("doc_id", split.alias("split"), F.col("source").alias("repo"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7 + 1).alias("rank")).join(shows, "doc_id")
    out = evaluate.quality_report(rows, 5, [evaluate.shown_share()])
    return out.select("split", "repo", "n", F.round("mrr", 9).alias("mrr"), F.round("shown", 9).alias("shown"))


def case_repos(spark, d):
    """Questions as cases of repositories that the region table names."""
    cases = read(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.concat(F.lit("r"), (F.col("item_id") % 4).cast("string")).alias("repo"))
    repos = read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_name").alias("url"), F.md5("r_name").alias("commit"))
    return corpus.cases_of_repos(cases, repos)


def _runs(spark, d):
    e, i = read(spark, d, "events"), F.col("event_id")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "wrong").when(i % 13 == 0, "no_answer").otherwise("correct")
    on = i % 2 == 0
    tools = F.map_from_arrays(F.array(F.lit("grep"), F.lit("read")), F.array((i % 3).cast("int"), (i % 4).cast("int")))
    return e.select(
        i.alias("run_no"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("case"), (i % 6 / 2).cast("int").alias("rep"), F.when(on, "on").otherwise("off").alias("arm"), F.concat(F.lit("m"), (i % 2).cast("string")).alias("model"),
        status.alias("status"), F.when(status == "correct", (i % 4 + 1).cast("int")).alias("rank"), F.floor(F.col("value") * 100).cast("long").alias("input_tokens"), (i % 500).alias("output_tokens"),
        F.when(i % 7 > 0, (i % 11).cast("int")).alias("turns"), F.col("value").alias("seconds"), F.when(i % 5 > 0, F.col("value") / 1000).alias("cost_usd"),
        F.when(on & (i % 10 > 0), F.map_concat(tools, F.map_from_arrays(F.array(F.lit("search")), F.array(F.lit(2))))).otherwise(tools).alias("tools"),
    )


def ab_arm_report(spark, d):
    r = evaluate.arm_report(_runs(spark, d))
    return r.select("arm", "n", *[F.round(c, 6).alias(c) for c in r.columns if c not in ("arm", "n")])


def ab_tool_calls(spark, d):
    return evaluate.tool_calls(_runs(spark, d)).select("arm", "name", F.round("calls_per_run", 9).alias("calls_per_run"), "runs_using")


def ab_models(spark, d):
    return evaluate.models_of(_runs(spark, d))


def ab_pairs(spark, d):
    return evaluate.pairs_of(_runs(spark, d))


def ab_sign_test(spark, d):
    r = evaluate.pair_report(evaluate.pairs_of(_runs(spark, d)))
    return r.select(*[F.round(c, 9).alias(c) if c in ("ratio_median", "p_value", "turns_on_median", "turns_off_median") else c for c in r.columns])


def sign_tests(spark, d):
    """The sign test of every pair of tallies up to 40."""
    n = spark.range(41)
    both = n.select(F.col("id").alias("a")).crossJoin(F.broadcast(n.select(F.col("id").alias("b"))))  # 41 rows each
    return both.select("a", "b", F.round(tx.sign_test(F.col("a"), F.col("b")) + 1e-12, 9).alias("p"))  # off the halves that rounding would decide by the last bit


def resume_todo(spark, d):
    runs = _runs(spark, d)
    return evaluate.still_to_do(runs.select("case").distinct(), runs.filter("run_no % 4 < 3").select("case", "rep", "arm").distinct(), 3)


def agent_events(spark, d):
    """Tool uses and outcomes of event streams made of the events table, with broken lines among them."""
    i = F.col("event_id")
    use = F.format_string('{"type":"assistant","message":{"content":[{"type":"tool_use","name":"%s"},{"type":"text"}]}}', "event_type")
    end = F.format_string('{"type":"result","result":"r%s","num_turns":%s,"usage":{"input_tokens":%s}}', i, i % 9, i % 1000)
    lines = read(spark, d, "events").select(F.col("user_id").alias("run_id"), i.alias("pos"), F.when(i % 11 == 0, "{broken").when(i % 10 == 3, end).otherwise(use).alias("value"))
    tools, results = corpus.read_events(lines)
    calls = tools.groupBy("run_id").agg(F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("tools"))
    return calls.join(results, "run_id", "left").select("run_id", "calls", "tools", "result", "turns", "input_tokens", "failed")


QUERIES = {
    f.__name__: f
    for f in (
        target_resolve, rank_of, answer_overlap, hit_at_k, mrr, eval_rollup, token_cost, token_cost_whole, token_cost_bpe, outline_visible, shown_rollup, case_repos, ab_arm_report, ab_tool_calls, ab_models, ab_pairs, ab_sign_test, sign_tests, resume_todo, agent_events,
    )
}

# ---- SQL ---------------------------------------------------------------------------------

_SIM = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_RANKS = f"""near AS (SELECT a.vec_id AS query_id, a.label AS own, b.vec_id AS id, b.label AS label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 6),
h AS (SELECT query_id, min(rank) AS rank FROM near WHERE id <> query_id AND label = own GROUP BY query_id),
r AS (SELECT vec_id AS query_id, CASE WHEN rank > 1 THEN rank - 1 ELSE rank END AS rank, CASE WHEN vec_id % 100 = 0 THEN 'dev' ELSE 'test' END AS split, concat('r', label % 2) AS repo FROM embeddings LEFT JOIN h ON query_id = vec_id WHERE vec_id % 50 = 0)"""
_HITS = ", ".join(f"round(avg((coalesce(rank, 99) <= {k})::INT), 9) AS hit_{k}" for k in (1, 3, 5))
_MRR = "round(sum(coalesce(1.0 / rank, 0)) / count(*), 9) AS mrr"
_STRIPPED_HEAD = "(SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY ln) FILTER (WHERE k <= 2), '') AS head FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS k FROM (SELECT doc_id, unnest(range(len(a))) AS ln, unnest(list_transform(a, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) WHERE s <> '') GROUP BY doc_id)"
_RUNS = """runs AS (SELECT *, CASE WHEN status = 'correct' THEN run_no % 4 + 1 END AS rank FROM (SELECT event_id AS run_no, concat('c', user_id) AS "case", (event_id % 6 // 2)::INT AS rep, CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END AS arm, concat('m', event_id % 2) AS model,
 CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'wrong' WHEN event_id % 13 = 0 THEN 'no_answer' ELSE 'correct' END AS status, floor(value * 100)::BIGINT + event_id % 500 AS tokens,
 CASE WHEN event_id % 7 > 0 THEN event_id % 11 ELSE 0 END AS turns, value AS seconds, CASE WHEN event_id % 5 > 0 THEN value / 1000 ELSE 0 END AS cost FROM events))"""
_PAIRS = """pairs AS (SELECT "case", rep, o.status = 'correct' AS ok_on, f.status = 'correct' AS ok_off, o.tokens AS tokens_on, f.tokens AS tokens_off, o.turns::INT AS turns_on, f.turns::INT AS turns_off FROM
 (SELECT * FROM runs WHERE arm = 'on' QUALIFY row_number() OVER (PARTITION BY "case", rep ORDER BY run_no DESC) = 1) o JOIN (SELECT * FROM runs WHERE arm = 'off' QUALIFY row_number() OVER (PARTITION BY "case", rep ORDER BY run_no DESC) = 1) f USING ("case", rep))"""
_SIGN = "(CASE WHEN a + b = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, (least(a, b) + 1)::BIGINT), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2.0))))) END)"

ORACLES = {
    "target_resolve": r"""SELECT doc_id AS case_id, concat('f', doc_id) AS path, CASE doc_id % 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END::INT AS line FROM documents""",
    "rank_of": """SELECT doc_id AS case_id, min(place)::INT AS rank FROM documents LEFT JOIN (SELECT unnest(range(1, 5)) AS place) p
        ON place % 2 = 0 AND (doc_id % 6 = 0 OR n_chars % 60 BETWEEN place * 10 + n_chars % 7 AND place * 10 + 9 + n_chars % 7) GROUP BY doc_id""",
    "answer_overlap": """WITH x AS (SELECT doc_id, doc_id % 8 = 0 AS anywhere, n_chars % 300 AS s, n_chars % 300 + doc_id % 200 AS e, doc_id % 90 AS o FROM documents),
        y AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN e - s < 150 AND (anywhere OR (s <= 90 AND e >= 40)) THEN 1 END ELSE CASE WHEN anywhere OR (o <= 90 AND o >= 40) THEN 2 END END AS rank FROM x)
        SELECT doc_id AS run_id, CASE WHEN doc_id % 4 = 0 THEN 'no_answer' WHEN rank IS NULL THEN 'wrong' ELSE 'correct' END AS status, CASE WHEN doc_id % 4 > 0 THEN rank END::INT AS rank FROM y""",
    "hit_at_k": f"WITH {_RANKS} SELECT count(*) AS n, {_HITS} FROM r",
    "mrr": f"WITH {_RANKS} SELECT {_MRR} FROM r",
    "eval_rollup": f"WITH {_RANKS} SELECT split, CASE WHEN grouping(repo) = 1 THEN 'ALL' ELSE repo END AS repo, count(*) AS n, {_HITS}, {_MRR} FROM r GROUP BY GROUPING SETS ((split, repo), (split))",
    "token_cost": f"""WITH t AS (SELECT doc_id, doc_id % 3 = 0 AS miss, strlen(left(text, 400)) // 4 AS full, strlen(head) // 4 AS outline, strlen(left(text, 200)) // 4 AS hit, strlen(text) // 4 AS file FROM documents JOIN {_STRIPPED_HEAD} USING (doc_id))
        SELECT doc_id % 4 AS g, trunc(avg("full" + CASE WHEN miss THEN file ELSE 0 END))::INT AS full_read, trunc(avg(outline))::INT AS outline, trunc(avg(outline + CASE WHEN miss THEN file ELSE hit END))::INT AS outline_read, trunc(avg(file))::INT AS file FROM t GROUP BY 1""",
    "token_cost_whole": f"""WITH l AS {LINES.format(t='documents')}, c AS (SELECT doc_id, ln // 5 AS w, max(ln) + 1 AS line_end, string_agg(line, chr(10) ORDER BY ln) AS chunk FROM l GROUP BY ALL HAVING regexp_matches(string_agg(line, chr(10)), '\\S')),
        s AS (SELECT doc_id, ln // 5 AS w, ln, {STRIPPED} AS s FROM l), o AS (SELECT doc_id, w, string_agg(s, chr(10) ORDER BY ln) AS head FROM (SELECT * FROM s WHERE s <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, w ORDER BY ln) <= 2) GROUP BY ALL),
        p AS (SELECT doc_id, sum(strlen(chunk) // 4) AS full, sum(strlen(head) // 4) AS outline, sum(CASE WHEN n_chars % 9 + 1 BETWEEN 5 * w + 1 AND line_end THEN strlen(chunk) // 4 END) AS hit FROM c JOIN o USING (doc_id, w) JOIN documents USING (doc_id) GROUP BY doc_id),
        r AS (SELECT source, hit, coalesce("full", 0) AS full, coalesce(outline, 0) AS outline, coalesce(strlen(text) // 4, 0) AS file FROM documents LEFT JOIN p USING (doc_id))
        SELECT source, count(*) AS n, count(hit) AS hits, trunc(avg("full" + CASE WHEN hit IS NULL THEN file ELSE 0 END))::INT AS full_read, trunc(avg(outline))::INT AS outline, trunc(avg(outline + coalesce(hit, file)))::INT AS outline_read, trunc(avg(file))::INT AS file FROM r GROUP BY source""",
    "outline_visible": f"""SELECT doc_id, doc_id % 4 = 0 OR contains(head, left(trim(a[least(doc_id % 3 + 1, len(a))]), 80)) AS shows FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) JOIN {_STRIPPED_HEAD} USING (doc_id)""",
    "shown_rollup": f"""WITH s AS (SELECT doc_id, source, CASE WHEN doc_id % 5 > 0 THEN (doc_id % 4 = 0 OR contains(head, left(trim(a[least(doc_id % 3 + 1, len(a))]), 80)))::INT END AS shows FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents) JOIN {_STRIPPED_HEAD} USING (doc_id)),
        r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, source AS repo, CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 + 1 END AS rank, shows FROM s)
        SELECT split, CASE WHEN grouping(repo) = 1 THEN 'ALL' ELSE repo END AS repo, count(*) AS n, {_MRR}, round(avg(shows), 9) AS shown FROM r GROUP BY GROUPING SETS ((split, repo), (split))""",
    "case_repos": "SELECT item_id AS case_id, concat('r', item_id % 4) AS repo, r_name AS url, md5(r_name) AS commit FROM benchmark JOIN region ON r_regionkey = item_id % 4",
    "ab_arm_report": f"""WITH {_RUNS} SELECT arm, count(*) AS n, {", ".join(f"round(avg((status = '{s}')::INT), 6) AS {s}" for s in ("correct", "wrong", "no_answer", "error"))}, round(avg((coalesce(rank, 0) = 1)::INT), 6) AS first,
        round(median(tokens), 6) AS tokens_median, round(avg(tokens), 6) AS tokens_mean, round(median(turns), 6) AS turns_median, round(median(seconds), 6) AS seconds_median, round(sum(cost), 6) AS cost FROM runs GROUP BY arm""",
    "ab_tool_calls": """WITH r AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END AS arm, event_id FROM events), n AS (SELECT arm, count(*) AS n FROM r GROUP BY arm),
        c AS (SELECT arm, 'grep' AS name, event_id % 3 AS calls FROM r UNION ALL SELECT arm, 'read', event_id % 4 FROM r UNION ALL SELECT arm, 'search', 2 FROM r WHERE arm = 'on' AND event_id % 10 > 0)
        SELECT arm, name, round(sum(calls) / n, 9) AS calls_per_run, count(*) AS runs_using FROM c JOIN n USING (arm) GROUP BY arm, name, n""",
    "ab_models": "SELECT string_agg(DISTINCT concat('m', event_id % 2), ', ' ORDER BY concat('m', event_id % 2)) AS models FROM events",
    "ab_pairs": f"WITH {_RUNS}, {_PAIRS} SELECT * FROM pairs",
    "ab_sign_test": f"""WITH {_RUNS}, {_PAIRS}, t AS (SELECT count(*) AS pairs, count_if(ok_on AND ok_off) AS both, count_if(ok_on AND NOT ok_off) AS only_on, count_if(ok_off AND NOT ok_on) AS only_off, count_if(NOT ok_on AND NOT ok_off) AS neither,
        round(median(tokens_on / greatest(tokens_off, 1)) FILTER (WHERE ok_on AND ok_off), 9) AS ratio_median, count_if(ok_on AND ok_off AND tokens_on / greatest(tokens_off, 1) < 1) AS cheaper,
        round(median(turns_on) FILTER (WHERE ok_on AND ok_off), 9) AS turns_on_median, round(median(turns_off) FILTER (WHERE ok_on AND ok_off), 9) AS turns_off_median FROM pairs)
        SELECT *, round({_SIGN.replace('a + b', 'only_on + only_off').replace('least(a, b)', 'least(only_on, only_off)')}, 9) AS p_value FROM t""",
    "sign_tests": f"SELECT a, b, round({_SIGN} + 1e-12, 9) AS p FROM (SELECT unnest(range(41)) AS a), (SELECT unnest(range(41)) AS b)",
    "resume_todo": """SELECT "case", rep::INT AS rep, arm FROM (SELECT DISTINCT concat('c', user_id) AS "case" FROM events), (SELECT unnest(range(3)) AS rep), (SELECT unnest(['off', 'on']) AS arm)
        EXCEPT SELECT concat('c', user_id), (event_id % 6 // 2)::INT, CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END FROM events WHERE event_id % 4 < 3""",
    "agent_events": """WITH u AS (SELECT user_id, event_type FROM events WHERE event_id % 11 > 0 AND event_id % 10 <> 3), r AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_id % 11 > 0 AND event_id % 10 = 3 GROUP BY user_id)
        SELECT u.user_id AS run_id, count(*)::BIGINT AS calls, count(DISTINCT event_type) AS tools, CASE WHEN e IS NOT NULL THEN concat('r', e) END AS result, (e % 9)::INT AS turns, e % 1000 AS input_tokens, CASE WHEN e IS NOT NULL THEN false END AS failed
        FROM u LEFT JOIN r ON r.user_id = u.user_id GROUP BY u.user_id, e""",
}
