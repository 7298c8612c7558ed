"""Text functions as column builders: tokens, identifiers, path and query classes, counts."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word list, patterns and weights that define the results.
STOPWORDS = tuple("a an and are as at be by can do does for from how i if in is it of on or should so that the this to use used we what when where which who why will with".split())
SKIP_PATH = r"(?i)(\.(lock|min\.js|min\.css|map|svg|png|jpe?g|gif|ico|webp|zip|gz|tar|whl|so|dll|exe|bin|pyc)$|-lock\.json$)"
TEST_PATH = r"(^|/)(tests?|__tests__|spec)/|(^|/)test_|_test\.[A-Za-z0-9_]+$|\.(test|spec)\.[A-Za-z0-9_]+$"
PROSE_PATH = r"(?i)\.(md|mdx|markdown|rst|txt)$|(^|/)docs?/"
DOC_QUERY = r"(?i)\b(how (do|can|to)|docs?|documentation|guide|example|tutorial|explain|why)\b"
TEST_QUERY = r"(?i)\btest"
DEFINING = "def class function fn func struct interface trait type enum const let var".split()
IMAGE = r"(?i)!\[[^\]]*\]\(|<img\b"
WORD = r"[\p{L}\p{N}_]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
MAX_BYTES, MAX_PDF_BYTES, SNIFF_BYTES = 1_000_000, 25_000_000, 8192


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition is one ASCII letter and marks, and those letters."""
    pairs = []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(cp))
        base = parts[0]
        if len(parts) > 1 and base.isascii() and base.isalpha() and all(unicodedata.combining(c) for c in parts[1:]):
            pairs.append((chr(cp), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()


def split_identifiers(s: Column) -> Column:
    """A space at each lower-case-or-digit to capital boundary, and for each underscore."""
    return F.translate(F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2"), "_", " ")


def words(s: Column) -> Column:
    """Lower-case words of split identifiers: runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(split_identifiers(s)), F.lit(WORD), 0)


def fold(s: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(s), _FROM, _TO)


def index_tokens(s: Column) -> Column:
    """Tokens as the full-text index sees them: identifiers split, accents folded."""
    return F.regexp_extract_all(fold(split_identifiers(s)), F.lit(r"[\p{L}\p{N}]+"), 0)


def query_terms(s: Column) -> Column:
    """Terms of a query: its words without stopwords, repeats kept, then as the index sees them."""
    kept = F.filter(words(s), lambda w: ~w.isin(*STOPWORDS))
    return F.flatten(F.transform(kept, lambda w: F.regexp_extract_all(F.translate(w, _FROM, _TO), F.lit(r"[\p{L}\p{N}]+"), 0)))


def symbol_names(q: Column) -> Column:
    """Names a query may ask for: marked identifiers or a lone word, and two or three words joined."""
    found = F.regexp_extract_all(q, F.lit(r"[A-Za-z_][\p{L}\p{N}_]*"), 0)
    n = F.size(found)
    marked = F.filter(found, lambda w: (F.length(w) > 2) & (F.contains(w, F.lit("_")) | w.rlike("[a-z][A-Z]") | (n == 1)))
    joined = F.when(n.between(2, 3), F.array(F.array_join(found, ""), F.array_join(found, "_"))).otherwise(F.array().cast("array<string>"))
    return F.concat(marked, joined)


def definition_pattern(names: Column) -> Column:
    """A pattern for a line that defines one of the names; null without names."""
    quoted = F.transform(names, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?i)\b(?:" + "|".join(DEFINING) + r")\s+(?:"), F.array_join(quoted, "|"), F.lit(r")\b"))
    return F.when(F.size(names) > 0, pattern)


def is_skipped_path(path: Column) -> Column:
    return path.rlike(SKIP_PATH)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_prose_path(path: Column) -> Column:
    return path.rlike(PROSE_PATH)


def wants_tests(query: Column) -> Column:
    return query.rlike(TEST_QUERY)


def wants_docs(query: Column) -> Column:
    return query.rlike(DOC_QUERY)


def within_size(path: Column, size: Column) -> Column:
    return size <= F.when(F.lower(path).endswith(".pdf"), MAX_PDF_BYTES).otherwise(MAX_BYTES)


def looks_binary(path: Column, content: Column) -> Column:
    return ~F.lower(path).endswith(".pdf") & F.contains(F.substring(content, 1, SNIFF_BYTES), F.lit(b"\x00"))


def decode(content: Column) -> Column:
    """UTF-8 text; invalid bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def text_lines(s: Column) -> Column:
    """Lines at any line break, without an empty last one.

    Most texts have no break but \\n, which needs no pattern.  The text is named by a
    one-entry array, so that it is made once however long its own expression is.
    """

    def lines(x: Column) -> Column:
        plain = F.split(F.when(F.endswith(x, F.lit("\n")), F.left(x, F.length(x) - 1)).otherwise(x), "\n", -1)
        rest = F.split(F.regexp_replace(x, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK, -1)
        other = reduce(lambda a, b: a | b, [F.contains(x, F.lit(c)) for c in OTHER_BREAKS])
        return F.when(F.length(x) == 0, F.array().cast("array<string>")).when(other, rest).otherwise(plain)

    return F.transform(F.array(s), lines)[0]


def image_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(IMAGE))


def byte_tokens(s: Column) -> Column:
    """A token per four bytes of UTF-8, rounded down."""
    return F.floor(F.octet_length(s) / 4).cast("long")


def clip(line: Column, width: int = 160) -> Column:
    return F.when(F.length(line) > width, F.concat(F.left(line, F.lit(width - 1)), F.lit("…"))).otherwise(line)


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def l2_normalise(v: Column) -> Column:
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)) + 1e-9
    return let(v.cast("array<double>"), lambda a: let(norm(a), lambda n: F.transform(a, lambda x: x / n)))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in order of the components."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def split_of(question: Column, pinned: Column | None = None) -> Column:
    """dev for two fifths of the questions, by checksum, else test; a pinned split wins."""
    own = F.when(F.crc32(question.cast("binary")) % 5 < 2, "dev").otherwise("test")
    return own if pinned is None else F.coalesce(F.when(pinned != "", pinned), own)


def case_id(repo: Column, question: Column) -> Column:
    return F.concat(repo, F.lit("-"), F.lpad(F.lower(F.hex(F.crc32(question.cast("binary")))), 8, "0"))


def relative_age(seconds: Column) -> Column:
    """Whole seconds, minutes, hours or days."""
    steps = ((120, 1, "s"), (7200, 60, "m"), (172_800, 3600, "h"))
    text = lambda unit, name: F.concat(F.floor(seconds / unit).cast("string"), F.lit(name))
    return reduce(lambda rest, s: F.when(seconds < s[0], text(s[1], s[2])).otherwise(rest), reversed(steps), text(86_400, "d"))


def sign_test(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided sign test: min(1, 2 * sum of C(m, i) for i up to k, over 2^m); 1 without pairs.

    Term and sum are kept in units of 2^(up - m), and up grows with them, so that neither the
    2^-m of many pairs nor C(m, k) leaves the range of a double; what is below 1e-170 may be 0.
    """
    k, m = F.least(only_a, only_b).cast("long"), (only_a + only_b).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"), F.lit(0).cast("long").alias("up"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (m - i + 1) / i
        large = term > 2.0**500
        unit = F.when(large, 2.0**-500).otherwise(1.0)
        return F.struct((term * unit).alias("term"), ((acc["total"] + term) * unit).alias("total"), (acc["up"] + F.when(large, 500).otherwise(0)).alias("up"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    share = F.aggregate(steps, start, step, lambda acc: acc["total"] * F.pow(F.lit(2.0), acc["up"] - m))
    return F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * share))


def parse_answers(reply: Column) -> Column:
    """array<struct<path, start, end>> of the reply's answer lines; a missing end is the start."""
    pattern = r"(?m)^[^\p{L}\p{N}_]*ANSWER:\s*`?([^`\s:]+):([0-9]+)(?:\s*-\s*([0-9]+))?"
    part = lambda i: F.regexp_extract_all(reply, F.lit(pattern), i)
    rows = F.arrays_zip(part(1).alias("p"), part(2).alias("s"), part(3).alias("e"))
    clean = lambda x: F.struct(F.regexp_replace(x["p"], r"^\./", "").alias("path"), x["s"].cast("int").alias("start"), F.coalesce(F.when(x["e"] != "", x["e"]), x["s"]).cast("int").alias("end"))
    return F.transform(rows, clean)
