"""Registered queries over text functions, path predicates and chunkers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions import outline as outlines
from siftwood.functions import text as tx
from siftwood.functions.embed import HashedEmbedder
from siftwood.operators import chunk, code, rank
from siftwood.sources import corpus

#: A path for each document, of every class the path predicates know (the tables hold none).
PATH = """CASE doc_id % 9 WHEN 0 THEN concat('src/', source, '/mod_', doc_id, '.py') WHEN 1 THEN concat('tests/', source, '_', doc_id, '.py')
 WHEN 2 THEN concat('Docs/', source, '/', doc_id, '.rst') WHEN 3 THEN concat('latest/contest_', doc_id, '.go') WHEN 4 THEN concat('lib/', doc_id, '.spec.ts')
 WHEN 5 THEN concat('README_', doc_id, '.MD') WHEN 6 THEN concat('pkg/', doc_id, '_test.go') WHEN 7 THEN concat('web/', source, '.min.js') ELSE concat('img/', doc_id, '-lock.json') END"""
IDENTIFIERS = "(VALUES (1, 'refreshToken store_id'), (2, 'HTTPServer getURL2Path'), (3, 'snake_case_name x1Y2'), (4, ''), (5, 'plain words'), (6, 'éÀccent aB_cD'))"
QUESTIONS = "(VALUES (1, 'how do I refresh a token'), (2, 'SessionStore'), (3, 'session store'), (4, 'where is parse_line used in the tests'), (5, 'a of the'), (6, 'explain fooBar and Baz qux'), (7, 'is it'), (8, 'documentation for x'))"
MARKDOWN = "(VALUES (1, 'intro\n\n# One\ntext\n```\n# not a head\n```\n## Two\nmore\n'), (2, '# A\n~~~\n# swallowed\n## also\n'), (3, 'no heads\nat all'), (4, ''), (5, '# H\n\n\n# I\n \n# J\nx'), (6, '![a](b.png)\n<IMG src=x>\n# K\n![](c) <img>'))"
AGES = "(VALUES (0), (1), (119), (120), (7199), (7200), (172799), (172800), (1000000))"
REPLIES = "(VALUES (1, 'Found.\nANSWER: ./src/a.py:10-20\nANSWER: `b.py`:5'), (2, 'none'), (3, '* ANSWER: c/d.ts:7 - 9\nANSWER:e.go:1-2'), (4, ''))"
_W = r"[\p{L}\p{N}_]+"


def docs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(*(cols or ("doc_id", "text")))


def values(spark: SparkSession, rows: str, cols: str) -> DataFrame:
    # a line break inside a literal is the same in both dialects once written as a character
    return spark.sql(f"SELECT * FROM VALUES {rows.strip()[len('(VALUES'):-1]} AS t({cols})".replace("\n", "\\n"))


def sql_values(rows: str, cols: str) -> str:
    return f"(SELECT * FROM {rows} AS t({cols}))"


#: Rows of a table beside the literal ones that show the edges of a function, in words that both dialects share; the ids of the table's rows are moved.
MORE_IDENTIFIERS = "SELECT doc_id + 100 AS id, replace(replace(text, ' a', 'A'), ' e', '_E') AS s FROM documents"
MORE_QUESTIONS = "SELECT item_id + 100 AS id, text AS q FROM benchmark"
MORE_AGES = "SELECT event_id * 97 AS s FROM events"
MORE_REPLIES = """SELECT doc_id + 100 AS id, CASE WHEN doc_id % 4 = 0 THEN text ELSE concat(text, '\nANSWER: ./a.py:', n_chars % 300, '-', n_chars % 300 + doc_id % 200, '\n ANSWER: b.py:', doc_id % 90) END AS reply FROM documents"""


def values_and(spark: SparkSession, d: str, rows: str, cols: str, table: str, more: str) -> DataFrame:
    spark.read.parquet(f"{d}/{table}.parquet").createOrReplaceTempView(f"siftwood_{table}")
    return values(spark, rows, cols).unionAll(spark.sql(more.replace(f"FROM {table}", f"FROM siftwood_{table}").replace("\n", "\\n")))


def sql_text(form: str, *parts: str) -> str:
    """A message with its places filled, as SQL."""
    said = form.split("{}")
    return "concat(" + ", ".join(x for pair in zip((f"'{t}'" for t in said), [*parts, None], strict=True) for x in pair if x) + ")"


def sql_values_and(rows: str, cols: str, more: str) -> str:
    return f"(SELECT * FROM {rows} AS t({cols}) UNION ALL {more})"


def questions(spark: SparkSession, d: str) -> DataFrame:
    return values_and(spark, d, QUESTIONS, "id, q", "benchmark", MORE_QUESTIONS)


def tokenize_counts(spark, d):
    w = tx.words(F.col("text"))
    return docs(spark, d).select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))


def fold_tokens(spark, d):
    return docs(spark, d).select(F.explode(tx.index_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def camel_snake_split(spark, d):
    t = values_and(spark, d, IDENTIFIERS, "id, s", "documents", MORE_IDENTIFIERS)
    return t.select("id", tx.split_identifiers(F.col("s")).alias("spaced"), F.array_join(tx.words(F.col("s")), "|").alias("words"))


def stopword_terms(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    return b.select("item_id", F.array_join(tx.query_terms(F.col("text")), " ").alias("terms"))


def query_terms_qtf(spark, d):
    from siftwood.operators.lexical import terms_of_queries

    b = spark.read.parquet(f"{d}/benchmark.parquet")
    return terms_of_queries(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


def symbol_names(spark, d):
    q = questions(spark, d)
    return q.select("id", F.array_join(tx.symbol_names(F.col("q")), "|").alias("names"), tx.wants_tests(F.col("q")).alias("tests"), tx.wants_docs(F.col("q")).alias("docs"))


CODE_TEXTS = "(VALUES ('class SessionStore:'), ('def session_store(x):'), ('const fooBar = 1'), ('let  sessionstore = 2'), ('SessionStore()'), ('interface fooBarBaz'), ('fn parse_line()'))"


def definition_boost(spark, d):
    q, t = questions(spark, d), values(spark, CODE_TEXTS, "text")
    pairs = q.crossJoin(F.broadcast(t))  # seven literal texts
    return pairs.select("id", "text", F.round(rank.reweigh(F.lit(0.5), F.col("q"), F.lit("src/a.py"), F.col("text")), 9).alias("score"))


def path_class(spark, d):
    p = docs(spark, d, "doc_id", "source").select("doc_id", F.expr(PATH).alias("path"))
    return p.select("doc_id", "path", tx.is_test_path(F.col("path")).alias("is_test"), tx.is_prose_path(F.col("path")).alias("is_prose"), chunk.dispatch(F.col("path")).alias("chunker"))


def path_penalty(spark, d):
    p = docs(spark, d, "doc_id", "source", "text").select("doc_id", F.expr(PATH).alias("path"), "text")
    q = values(spark, QUESTIONS, "id, q")
    pairs = p.crossJoin(F.broadcast(q))  # eight literal questions
    return pairs.select("doc_id", "id", F.round(rank.reweigh(F.lit(1.0), F.col("q"), F.col("path"), F.lit("")), 9).alias("score"))


def skip_filter(spark, d):
    p = docs(spark, d, "doc_id", "source").select("doc_id", F.expr(PATH).alias("path"))
    return p.filter(~tx.is_skipped_path(F.col("path")) & ~F.col("path").startswith(corpus.INDEX_DIR + "/")).select("doc_id", "path")


def size_cap(spark, d):
    p = docs(spark, d, "doc_id", "n_chars").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "a.PDF").otherwise("a.txt").alias("path"), (F.col("n_chars") * 1000).alias("size"))
    return p.filter(tx.within_size(F.col("path"), F.col("size"))).select("doc_id", "path", "size")


def binary_sniff(spark, d):
    html = F.col("html").cast("binary")
    mixed = F.when(F.col("page_id") % 5 == 0, F.concat(F.substring(html, 1, 2000), F.lit(b"\x00"), html)).otherwise(html)
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.when(F.col("page_id") % 10 == 0, "x.pdf").otherwise("x.html").alias("path"), mixed.alias("content"))
    return p.select("page_id", tx.looks_binary(F.col("path"), F.col("content")).alias("is_binary"))


def image_counts(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", tx.image_count(F.concat("html", F.lit("<img src=a> ![x](y)"))).alias("images"), tx.byte_tokens(F.col("html")).alias("tokens"))


def line_windows(spark, d):
    c = chunk.line_windows(docs(spark, d), size=5)
    return c.select("doc_id", "line_start", "line_end", "kind", F.md5(F.col("text").cast("binary")).alias("text_md5"), "images")


def blank_chunk_filter(spark, d):
    t = docs(spark, d).select("doc_id", F.concat(F.lit("  \n\n \n\n"), F.regexp_replace("text", "\n", "\n\n\n")).alias("text"))
    return chunk.line_windows(t, size=2).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("line_start").alias("first_line"))


def markdown_sections(spark, d):
    return chunk.markdown_sections(values(spark, MARKDOWN, "doc_id, text"), size=3).select("doc_id", "line_start", "line_end", "kind", "text", "images")


def markdown_documents(spark, d):
    t = docs(spark, d).select("doc_id", F.regexp_replace("text", r"(?m)^([A-M])", "# $1").alias("text"))
    c = chunk.markdown_sections(t)
    return c.select("doc_id", "line_start", "line_end", F.length("text").alias("chars"))


def pdf_pages(spark, d):
    p = spark.read.parquet(f"{d}/conversations.parquet")
    pages = p.select(F.concat(F.lit("doc"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("path"), F.col("turn").cast("int").alias("page"), F.when(F.col("turn") % 3 == 2, " ").otherwise(F.col("text")).alias("text"), (F.col("turn") % 2).cast("int").alias("n_images"))
    c = chunk.pdf_pages(pages, size=3)
    return c.select("path", "line_start", "line_end", "kind", F.length("text").alias("chars"), "images", rank.note(F.col("kind"), F.col("images")).alias("note"))


def clip_lines(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))
    return lines.select("doc_id", "ln", tx.clip(F.col("line")).alias("clipped"))


def outline_prose(spark, d):
    lines = outlines.stripped_lines(F.col("text"))
    return docs(spark, d).select("doc_id", F.array_join(F.transform(outlines.prose_head(lines), lambda x: tx.clip(x)), "\n").alias("outline"))


MATCH_QUERY = "the thand ofthe einung lichkeit éeau ciónra tionthe der and que los"


def matching_lines(spark, d):
    lines = outlines.stripped_lines(F.col("text"))
    found = outlines.matching_lines(lines, F.lit(MATCH_QUERY + " und les for las was"), outlines.prose_head(lines))
    return docs(spark, d).select("doc_id", F.array_join(found, "\n").alias("lines"))


def relative_age(spark, d):
    return values_and(spark, d, AGES, "s", "events", MORE_AGES).select("s", tx.relative_age(F.col("s")).alias("age"))


def answer_parse(spark, d):
    t = values_and(spark, d, REPLIES, "id, reply", "documents", MORE_REPLIES).select("id", F.posexplode(tx.parse_answers(F.col("reply"))).alias("pos", "a"))
    return t.select("id", "pos", "a.path", F.col("a.start").alias("first_line"), F.col("a.end").alias("last_line"))


PY_SOURCE = "import os\nX = 1\n\n# doc of f\n@deco\ndef f(a):\n    '''says'''\n    return a\n\n\nclass K(Base):\n    def one(self):\n        pass\n\n    async def two(self):\n        return 2\n"


def outline_code(spark, d):
    t = spark.createDataFrame([(1, PY_SOURCE, "class_definition"), (2, "/* Adds.\n * more */\nexport function add(a, b) {\n  return a + b;\n}\n", "function_declaration"), (3, "x = 1\ny = 2\nz = 3", "block")], "id int, text string, kind string")
    return t.select("id", outlines.outline(F.col("text"), F.col("kind"), F.lit("returns two things of add")).alias("outline"))


def code_chunks(spark, d):
    """Every document as a Python and as a brace-language source: unreadable ones give an error row."""
    t = docs(spark, d)
    as_py = t.select(F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit(PY_SOURCE), F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("# "), x)), "\n"), F.lit("\n")).alias("text"))
    as_js = t.select(F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), F.concat(F.lit("function f() {\n"), "text", F.lit("\n}\n")).alias("text"))
    return code.chunk_code(as_py.unionByName(as_js)).select("path", "line_start", "line_end", "kind", "context", "error")


def hash_embed(spark, d):
    return docs(spark, d).select("doc_id", HashedEmbedder(64).documents(F.col("text")).alias("vec"))


def split_of(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", tx.split_of(F.col("text")).alias("split"))


def case_id(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", tx.case_id(F.lit("repo"), F.col("text")).alias("case_id"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_counts, fold_tokens, camel_snake_split, stopword_terms, query_terms_qtf, symbol_names, definition_boost, path_class, path_penalty, skip_filter, size_cap, binary_sniff,
        image_counts, line_windows, blank_chunk_filter, markdown_sections, markdown_documents, pdf_pages, clip_lines, outline_prose, matching_lines, relative_age, answer_parse,
        outline_code, code_chunks, hash_embed, split_of, case_id,
    )
}

# ---- SQL ---------------------------------------------------------------------------------

STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"


def sql_split(c: str) -> str:
    return rf"replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' ')"


def sql_words(c: str) -> str:
    return rf"regexp_extract_all(lower({sql_split(c)}), '{_W}')"


def sql_tokens(c: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({sql_split(c)})), '[\p{{L}}\p{{N}}]+')"


def sql_terms(c: str) -> str:
    return rf"flatten(list_transform(list_filter({sql_words(c)}, lambda w: NOT list_contains({STOP}, w)), lambda w: regexp_extract_all(strip_accents(w), '[\p{{L}}\p{{N}}]+')))"


_TEST = r"regexp_matches(path, '(^|/)(tests?|__tests__|spec)/|(^|/)test_|_test\.[A-Za-z0-9_]+$|\.(test|spec)\.[A-Za-z0-9_]+$')"
_PROSE = r"regexp_matches(path, '(?i)\.(md|mdx|markdown|rst|txt)$|(^|/)docs?/')"
_WANTS_TESTS, _WANTS_DOCS = r"regexp_matches(q, '(?i)\btest')", r"regexp_matches(q, '(?i)\b(how (do|can|to)|docs?|documentation|guide|example|tutorial|explain|why)\b')"
_NAMES = r"""list_concat(list_filter(f, lambda w: length(w) > 2 AND (contains(w, '_') OR regexp_matches(w, '[a-z][A-Z]') OR len(f) = 1)),
 CASE WHEN len(f) BETWEEN 2 AND 3 THEN [array_to_string(f, ''), array_to_string(f, '_')] ELSE [] END)"""
_ASKED = rf"(SELECT id, q, {_NAMES} AS names FROM (SELECT id, q, regexp_extract_all(q, '[A-Za-z_][\p{{L}}\p{{N}}_]*') AS f FROM {sql_values_and(QUESTIONS, 'id, q', MORE_QUESTIONS)}))"
_DEF = r"regexp_matches(text, concat('(?i)\b(?:" + "|".join(tx.DEFINING) + r")\s+(?:', array_to_string(names, '|'), ')\b'))"
# lines of a text, without an empty last one
LINES = "(SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS ln FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS a FROM {t} WHERE text <> ''))"
STRIPPED = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
CLIP = "CASE WHEN length({c}) > 160 THEN concat(left({c}, 159), '…') ELSE {c} END"
_SECTIONS = """
WITH l AS {lines}, g AS (SELECT *, sum((regexp_matches(line, '^\\s*(```|~~~)'))::INT) OVER (PARTITION BY doc_id ORDER BY ln) % 2 = 1 AS fenced FROM l),
s AS (SELECT *, sum((ln > 0 AND starts_with(line, '#') AND NOT fenced)::INT) OVER (PARTITION BY doc_id ORDER BY ln) AS sec FROM g),
w AS (SELECT *, (ln - min(ln) OVER (PARTITION BY doc_id, sec)) // {size} AS win FROM s),
c AS (SELECT doc_id, (min(ln) + 1)::INT AS line_start, (max(ln) + 1)::INT AS line_end, string_agg(line, chr(10) ORDER BY ln) AS text FROM w GROUP BY doc_id, sec, win)
"""

#: The checksum's table by its rule, and the checksum of a string's bytes.
_CRC = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"""


def sql_crc32(c: str) -> str:
    data = f"list_transform(range(strlen({c})), lambda i: concat('0x', substr(hex({c}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])))"


ORACLES = {
    "hash_embed": f"""WITH {_CRC}, tok AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents), codes AS (SELECT term, {sql_crc32('term')} AS c FROM (SELECT DISTINCT term FROM tok), crc),
        n AS (SELECT doc_id, c % 64 AS b, sum(CASE WHEN (c >> 16) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS n FROM tok JOIN codes USING (term) GROUP BY ALL),
        v AS (SELECT d.doc_id, list(coalesce(n, 0) ORDER BY g.b) AS v FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS b) g LEFT JOIN n ON n.doc_id = d.doc_id AND n.b = g.b GROUP BY d.doc_id)
        SELECT doc_id, list_transform(v, lambda x: (x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-9))::FLOAT) AS vec FROM v""",
    "split_of": f"WITH {_CRC} SELECT item_id, CASE WHEN {sql_crc32('text')} % 5 < 2 THEN 'dev' ELSE 'test' END AS split FROM benchmark, crc",
    "case_id": f"WITH {_CRC} SELECT item_id, concat('repo-', lpad(lower(to_hex({sql_crc32('text')})), 8, '0')) AS case_id FROM benchmark, crc",
    "tokenize_counts": f"SELECT doc_id, len(w)::INT AS n_words, len(list_distinct(w))::INT AS n_distinct FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents)",
    "fold_tokens": f"SELECT term, count(*) AS n FROM (SELECT unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY term",
    "camel_snake_split": f"SELECT id, {sql_split('s')} AS spaced, array_to_string({sql_words('s')}, '|') AS words FROM {sql_values_and(IDENTIFIERS, 'id, s', MORE_IDENTIFIERS)}",
    "stopword_terms": f"SELECT item_id, array_to_string({sql_terms('text')}, ' ') AS terms FROM benchmark",
    "query_terms_qtf": f"SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({sql_terms('text')}) AS term FROM benchmark) GROUP BY ALL",
    "symbol_names": f"SELECT id, array_to_string(names, '|') AS names, {_WANTS_TESTS} AS tests, {_WANTS_DOCS} AS docs FROM {_ASKED}",
    "definition_boost": f"SELECT id, text, round(0.5 + CASE WHEN len(names) > 0 AND {_DEF} THEN 1.0::DOUBLE / 61 ELSE 0 END, 9) AS score FROM {_ASKED}, {sql_values(CODE_TEXTS, 'text')}",
    "path_class": f"""SELECT doc_id, path, {_TEST} AS is_test, {_PROSE} AS is_prose, CASE WHEN regexp_matches(path, '(?i)\\.(md|mdx|markdown)$') THEN 'markdown'
        WHEN regexp_matches(path, '(?i)\\.(py|jsx?|mjs|cjs|tsx?|go|rs|java|c|h|cc|cpp|hpp|rb)$') THEN 'code' ELSE 'text' END AS chunker FROM (SELECT doc_id, {PATH} AS path FROM documents)""",
    "path_penalty": f"""SELECT doc_id, id, round(1.0::DOUBLE * CASE WHEN NOT {_WANTS_TESTS} AND {_TEST} THEN 0.8 ELSE 1 END * CASE WHEN NOT {_WANTS_DOCS} AND {_PROSE} THEN 0.8 ELSE 1 END, 9) AS score
        FROM (SELECT doc_id, {PATH} AS path FROM documents), {sql_values(QUESTIONS, 'id, q')}""",
    "skip_filter": f"SELECT * FROM (SELECT doc_id, {PATH} AS path FROM documents) WHERE NOT regexp_matches(path, '{tx.SKIP_PATH}') AND NOT starts_with(path, '.siftwood/')",
    "size_cap": "SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'a.PDF' ELSE 'a.txt' END AS path, n_chars * 1000 AS size FROM documents) WHERE size <= CASE WHEN path = 'a.PDF' THEN 25000000 ELSE 1000000 END",
    "binary_sniff": "SELECT page_id, page_id % 5 = 0 AND page_id % 10 <> 0 AS is_binary FROM pages",
    "image_counts": r"SELECT page_id, len(regexp_extract_all(concat(html, '<img src=a> ![x](y)'), '(?i)!\[[^\]]*\]\(|<img\b'))::INT AS images, (strlen(html) // 4)::BIGINT AS tokens FROM pages",
    "line_windows": f"""SELECT doc_id, (5 * w + 1)::INT AS line_start, (max(ln) + 1)::INT AS line_end, 'text' AS kind, md5(string_agg(line, chr(10) ORDER BY ln)) AS text_md5, 0 AS images
        FROM (SELECT *, ln // 5 AS w FROM {LINES.format(t='documents')}) GROUP BY doc_id, w HAVING regexp_matches(string_agg(line, chr(10)), '\\S')""",
    "blank_chunk_filter": f"""SELECT doc_id, count(*) AS chunks, min(first)::INT AS first_line FROM (SELECT doc_id, 2 * w + 1 AS first FROM (SELECT *, ln // 2 AS w FROM
        {LINES.format(t="(SELECT doc_id, concat('  ', chr(10), chr(10), ' ', chr(10), chr(10), replace(text, chr(10), repeat(chr(10), 3))) AS text FROM documents)")})
        GROUP BY doc_id, w HAVING regexp_matches(string_agg(line, chr(10)), '\\S')) GROUP BY doc_id""",
    "markdown_sections": _SECTIONS.format(lines=LINES.format(t=sql_values(MARKDOWN, "doc_id, text")), size=3)
    + r"SELECT doc_id, line_start, line_end, 'section' AS kind, text, len(regexp_extract_all(text, '(?i)!\[[^\]]*\]\(|<img\b'))::INT AS images FROM c WHERE regexp_matches(text, '\S')",
    "markdown_documents": _SECTIONS.format(lines=LINES.format(t=r"(SELECT doc_id, regexp_replace(text, '(?m)^([A-M])', '# \1', 'g') AS text FROM documents)"), size=60)
    + r"SELECT doc_id, line_start, line_end, length(text)::INT AS chars FROM c WHERE regexp_matches(text, '\S')",
    "pdf_pages": f"""WITH p AS (SELECT concat('doc', conv_id, '.pdf') AS path, turn::INT AS page, CASE WHEN turn % 3 = 2 AND turn % 2 = 1 THEN {sql_text(chunk.EMPTY_PAGE, 'turn')}
        WHEN turn % 3 = 2 THEN ' ' ELSE text END AS text, (turn % 2)::INT AS n FROM conversations),
        l AS {LINES.format(t="(SELECT {'path': path, 'page': page, 'n': n} AS doc_id, text FROM p)")}
        SELECT doc_id.path AS path, doc_id.page AS line_start, doc_id.page AS line_end, 'pdf_page' AS kind, length(string_agg(line, chr(10) ORDER BY ln))::INT AS chars, doc_id.n AS images,
        CASE WHEN doc_id.n > 0 THEN {sql_text(rank.IMAGE_NOTE, "'page'", 'doc_id.n')} END AS note
        FROM l GROUP BY doc_id, ln // 3 HAVING regexp_matches(string_agg(line, chr(10)), '\\S')""",
    "clip_lines": f"SELECT doc_id, ln, {CLIP.format(c='line')} AS clipped FROM (SELECT doc_id, unnest(a) AS line, unnest(range(len(a)))::INT AS ln FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))",
    "outline_prose": f"""SELECT doc_id, coalesce(string_agg({CLIP.format(c='s')}, chr(10) ORDER BY ln) FILTER (WHERE n <= 2), '') AS outline FROM
        (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS n FROM (SELECT doc_id, ln, {STRIPPED} AS s FROM {LINES.format(t='documents')}) WHERE s <> '') GROUP BY doc_id""",
    "matching_lines": f"""WITH t AS (SELECT list_distinct(list_filter({sql_words(f"'{MATCH_QUERY} und les for las was'")}, lambda w: length(w) > 2 AND NOT list_contains({STOP}, w))) AS terms),
        s AS (SELECT doc_id, ln, {STRIPPED} AS s FROM {LINES.format(t='documents')}),
        h AS (SELECT doc_id, list(s ORDER BY ln)[:2] AS head FROM s WHERE s <> '' GROUP BY doc_id),
        m AS (SELECT s.doc_id, ln, s, len(list_intersect(list_distinct({sql_words('s')}), terms)) AS hits FROM s JOIN h USING (doc_id), t WHERE NOT list_contains(head, s)),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, ln) AS n FROM m WHERE hits >= 2)
        SELECT d.doc_id, coalesce(string_agg(concat('… ', s), chr(10) ORDER BY ln) FILTER (WHERE n <= 2), '') AS lines FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id GROUP BY d.doc_id""",
    "relative_age": f"SELECT s, CASE WHEN s < 120 THEN concat(s, 's') WHEN s < 7200 THEN concat(s // 60, 'm') WHEN s < 172800 THEN concat(s // 3600, 'h') ELSE concat(s // 86400, 'd') END AS age FROM {sql_values_and(AGES, 's', MORE_AGES)}",
    "answer_parse": rf"""SELECT id, pos::INT AS pos, regexp_replace(a[1], '^\./', '') AS path, a[2]::INT AS first_line, (CASE WHEN a[3] = '' THEN a[2] ELSE a[3] END)::INT AS last_line FROM
        (SELECT id, unnest(range(len(l))) AS pos, unnest(list_transform(l, lambda x: [regexp_extract(x, 'ANSWER:\s*`?([^`\s:]+):', 1), regexp_extract(x, ':([0-9]+)(\s*-\s*[0-9]+)?$', 1), regexp_extract(x, '-\s*([0-9]+)$', 1)])) AS a FROM
        (SELECT id, regexp_extract_all(reply, '(?m)^[^\p{{L}}\p{{N}}_]*ANSWER:\s*`?[^`\s:]+:[0-9]+(?:\s*-\s*[0-9]+)?') AS l FROM {sql_values_and(REPLIES, 'id, reply', MORE_REPLIES)}))""",
}
