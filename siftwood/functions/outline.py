"""Outlines of chunks as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOPWORDS, WORD, clip, split_identifiers, text_lines, words

# What opens a definition, what is a nested one, and the limits of an outline.
SIGNATURE = (
    r"\b(def|class|function|fn|func|struct|interface|trait|type|enum|impl|module|const|let|var)\b|=>"
    r"|^((public|private|protected|static|async|override|readonly)\s+)*(?!(if|for|while|switch|catch|return)\b)#?[\p{L}\p{N}_]+\s*\(.*\)\s*(:[^={]+)?\{?$"
)
NESTED = r"^(export |pub |public |private |protected |static |async |override )*(def|class|function|fn|func|interface|struct|impl|trait|enum)\s+[\p{L}\p{N}_]"
PROSE_KINDS = ("section", "text", "pdf_page")
MAX_NESTED, MAX_MATCHES, SIGNATURE_LINES = 8, 2, 8
_NONE = "array<string>"


def stripped_lines(text: Column) -> Column:
    # the pattern looks at every place of a line, so only lines with something to strip at an end meet it
    strip = lambda x: F.regexp_replace(x, r"^\p{Z}*\s*|\s*\p{Z}*$", "")
    edge = lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(r"[\s\p{Z}\x85]")
    return F.transform(text_lines(text), lambda x: F.when(edge(x), strip(x)).otherwise(x))


def matching_lines(lines: Column, query: Column, shown: Column) -> Column:
    """Up to two lines, in order, that share most query words (two at least) and aren't shown yet."""
    terms = F.array_distinct(F.filter(words(query), lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS)))
    # identifiers are split and lowered once for the whole text, not line by line
    plain = F.split(F.lower(split_identifiers(F.array_join(lines, "\n"))), "\n", -1)
    shared = lambda x: F.size(F.array_intersect(F.regexp_extract_all(x, F.lit(WORD), 0), terms))
    scored = F.zip_with(lines, F.transform(plain, lambda x, i: F.struct((-shared(x)).alias("neg"), i.alias("at"))), lambda x, s: F.struct(s["neg"].alias("neg"), s["at"].alias("at"), x.alias("line")))
    best = F.slice(F.array_sort(F.filter(scored, lambda s: (s["neg"] <= -2) & ~F.array_contains(shown, s["line"]))), 1, MAX_MATCHES)
    ordered = F.array_sort(F.transform(best, lambda s: F.struct(s["at"].alias("at"), s["line"].alias("line"))))
    marked = F.transform(ordered, lambda s: F.concat(F.lit("… "), s["line"]))
    return F.when(F.size(terms) < 2, F.array().cast(_NONE)).otherwise(marked)


def prose_head(lines: Column) -> Column:
    return F.slice(F.filter(lines, lambda x: x != ""), 1, 2)


def code_head(lines: Column) -> Column:
    """First text of a leading comment, decorators, signature, the line after it, nested definitions."""
    n = F.size(lines)
    # a leading block comment ends with the line that closes it
    closing = F.aggregate(F.transform(lines, lambda x, i: F.when(F.contains(x, F.lit("*/")), i)), n, lambda a, i: F.least(a, i))
    block = F.when((n > 0) & F.element_at(lines, 1).startswith("/*"), closing + 1).otherwise(0)
    in_block = F.slice(lines, 1, F.greatest(block - 1, F.lit(0)))
    after = F.slice(lines, block + 1, F.greatest(n - block, F.lit(0)))
    is_comment = lambda x: x.startswith("//") | x.startswith("# ") | x.isin("", "#")
    first_code = F.aggregate(F.transform(after, lambda x, i: F.when(~is_comment(x), i)), F.size(after), lambda a, i: F.least(a, i))
    comments = F.slice(after, 1, first_code)
    said = F.concat(F.transform(in_block, lambda x: F.regexp_replace(x, "^[/* ]+|[/* ]+$", "")), F.transform(comments, lambda x: F.regexp_replace(x, "^[/# ]+", "")))
    doc = F.slice(F.filter(said, lambda x: x != ""), 1, 1)
    rest = F.filter(F.slice(after, first_code + 1, F.greatest(F.size(after) - first_code, F.lit(0))), lambda x: F.regexp_replace(x, r"[\"'/*{}()\[\];, ]", "") != "")
    sig = F.array_min(F.filter(F.transform(F.slice(rest, 1, SIGNATURE_LINES), lambda x, i: F.when(x.rlike(SIGNATURE), i)), lambda i: i.isNotNull()))
    decorators = F.slice(F.filter(F.slice(rest, 1, F.coalesce(sig, F.lit(0))), lambda x: x.startswith("@")), 1, 2)
    nested = F.slice(F.filter(F.slice(rest, F.coalesce(sig, F.lit(0)) + 3, F.greatest(F.size(rest), F.lit(1))), lambda x: x.rlike(NESTED)), 1, MAX_NESTED)
    with_sig = F.concat(doc, decorators, F.slice(rest, F.coalesce(sig, F.lit(0)) + 1, 2), nested)
    return F.when(sig.isNotNull(), with_sig).otherwise(F.concat(doc, F.slice(rest, 1, 2 - F.size(doc))))


def outline(text: Column, kind: Column, query: Column) -> Column:
    """What a chunk is, without its body, and the lines that best match the query."""
    lines = stripped_lines(text)
    head = F.when(kind.isin(*PROSE_KINDS), prose_head(lines)).otherwise(code_head(lines))
    return F.array_join(F.transform(F.concat(head, matching_lines(lines, query, head)), lambda x: clip(x)), "\n")
