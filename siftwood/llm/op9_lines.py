"""Operator 9: line dedup by a deletion-neighbourhood join.

A line is its sequence of words; the edit bound is one word inserted, deleted or replaced.
Lines within it share a variant: both with the word at the same place taken out (replaced),
or one of them with a word taken out equal to the other whole (inserted, deleted).  Variants
are emitted as hashed keys, equal keys are joined through the earliest line of each key
(never as pairs), the edit distance is verified, and the later line goes.

Most lines share no variant with any other.  Two lines within the bound agree on their first
or their last half, so lines whose halves nobody shares are left out first, by their hashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions.text import let

from . import common

#: Lines of fewer words than MIN_WORDS stay, unless the caller takes them in; from EDIT_WORDS on near-equal lines count, below only equal ones.
MIN_WORDS, EDIT_WORDS = 3, 8
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_W, _S = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
#: Letters of scripts that put no blanks between words: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF"
UNITS = re.compile(f"[{_UNSPACED}]|[^\\x20\\x09-\\x0D{_UNSPACED}]+").findall
HAS_UNSPACED = re.compile(f"[{_UNSPACED}]").search
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_rows(text: str | None, min_words: int = MIN_WORDS, units=WORDS, edit_words: int = EDIT_WORDS) -> list[tuple[int, int, int, list[int]]]:
    """(line number, 128-bit hash as two longs, half keys) of each line of min_words or more words.

    Edits are of units, which are words or what the caller puts for them.  A line of n has half keys for itself and for the lines of n - 1 words it may have
    grown from: both name the shorter length, and which half.
    """
    out = []
    if units is UNITS and not HAS_UNSPACED(text or ""):
        units = WORDS
    for i, line in enumerate((text or "").split("\n")):
        words = WORDS(line)
        if len(words) < min_words:
            continue
        whole = xxhash.xxh3_128_intdigest(" ".join(words))
        words = words if units is WORDS else units(line)
        n = len(words)
        keys = []
        if n >= edit_words:
            for m in (n, n - 1):
                h = m // 2
                keys.append(_signed(xxhash.xxh3_64_intdigest(" ".join(words[:h]), 2 * m)))
                keys.append(_signed(xxhash.xxh3_64_intdigest(" ".join(words[n - m + h :]), 2 * m + 1)))
        out.append((i, _signed(whole >> 64), _signed(whole & _MASK), keys))
    return out


def _mix(x: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    x = x ^ (np.asarray(salt).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def variants(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed keys of a line and its one-deletion variants, and their roles.

    Role 0: the whole line; role 1: the line with a word taken out, to equal a whole line;
    role 2: the same, with the place of the word, to equal another line's variant there.
    The hash is a polynomial of word hashes, so all variants cost one pass.
    """
    n = len(words)
    with np.errstate(over="ignore"):
        w = np.array([xxhash.xxh64_intdigest(x) for x in words], np.uint64)
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE)])
        terms = w * powers
        before = np.r_[np.uint64(0), np.cumsum(terms)]
        whole = before[-1]
        cut = before[:-1] + (whole - before[1:]) * _INVERSE
        masked = whole - terms
        place = np.arange(n, dtype=np.uint64)
        keys = np.concatenate([_mix(np.array([whole]), 2 * n), _mix(cut, 2 * (n - 1)), _mix(_mix(masked, 2 * n + 1), place)])
    return keys.view(np.int64), np.repeat(np.array([0, 1, 2], np.int8), [1, n, n])


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether the word sequences are at most one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    n, i = min(len(a), len(b)), 0
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _distinct_lines(docs: DataFrame, min_words: int, units, edit_words: int) -> DataFrame:
    """(h1, h2, doc, line, keys): each distinct line with its earliest place."""

    def run(batches):
        for batch in batches:
            doc, line, h1, h2, keys = [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, a, b, ks in line_rows(text, min_words, units, edit_words):
                    doc.append(d)
                    line.append(i)
                    h1.append(a)
                    h2.append(b)
                    keys.append(ks)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(line, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc", "line", "h1", "h2", "keys"])

    lines = common.map_arrow(docs.filter("id IS NOT NULL"), run, "doc long, line int, h1 long, h2 long, keys array<long>")
    at = F.min(F.struct("doc", "line", "keys")).alias("at")
    return lines.groupBy("h1", "h2").agg(at).select("h1", "h2", "at.doc", "at.line", "at.keys")


def _with_partners(lines: DataFrame) -> DataFrame:
    """(doc, line) of the distinct lines that share a half with another line in its place."""
    halves = lines.filter(F.size("keys") > 0).select("h1", "doc", "line", F.explode("keys").alias("key"))
    shared = halves.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key")
    return halves.join(shared, "key", "left_semi").select("doc", "line").distinct()


def _near_equal(docs: DataFrame, lines: DataFrame, units) -> DataFrame:
    """(doc, line) of distinct lines with an earlier line at most one edit away."""

    def cut(batches):
        for batch in batches:
            doc, line, text = [], [], []
            for d, t, nos in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                all_lines = (t or "").split("\n")
                for i in nos:
                    if i < len(all_lines):
                        doc.append(d)
                        line.append(i)
                        text.append(" ".join(units(all_lines[i])))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(line, pa.int32()), pa.array(text, pa.string())], ["doc", "line", "words"])

    def emit(batches):
        for batch in batches:
            for ids, texts in _slices(batch):
                keys, roles, sizes = [], [], []
                for t in texts:
                    k, r = variants(t.split(" "))
                    keys.append(k)
                    roles.append(r)
                    sizes.append(len(k))
                own = np.repeat(np.array(ids, np.int64), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(roles)), pa.array(own)], ["key", "role", "ord"])

    def verify(batches):
        for batch in batches:
            a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            good = [within_one(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_()))], ["ord"])

    wanted = _with_partners(lines).groupBy("doc").agg(F.collect_list("line").alias("nos"))
    texts = common.map_arrow(docs.join(wanted, docs["id"] == wanted["doc"]).select("doc", "text", "nos"), cut, "doc long, line int, words string")
    # ids that rise with (doc, line): the earlier line has the smaller one; an id of several rows counts once
    texts = texts.repartitionByRange("doc", "line").sortWithinPartitions("doc", "line").withColumn("ord", F.monotonically_increasing_id())
    texts = common.materialise(texts, "line-texts")
    keys = common.map_arrow(texts.select("ord", "words"), emit, "key long, role byte, ord long")
    keys = common.materialise(keys, "line-variants")
    least = [F.min(F.when(F.col("role") == r, F.col("ord"))).alias(f"m{r}") for r in range(3)]
    groups = keys.groupBy("key").agg(*least, F.max("ord").alias("last"), F.count(F.lit(1)).alias("n")).filter("(m0 IS NOT NULL AND m1 IS NOT NULL) OR m2 < last")
    groups = common.materialise(groups, "line-groups")
    witness = F.when(F.col("role") == 0, F.col("m1")).when(F.col("role") == 1, F.col("m0")).otherwise(F.col("m2"))
    met = common.join_unique(keys, groups.drop("n"), ["key"], common.hot_keys(groups.select("key", "n")))
    # every key's witness is verified, so that one that only its hash has brought hides no other
    pairs = common.materialise(met.select("ord", witness.alias("witness")).filter("witness < ord").distinct(), "line-pairs")
    common.release(keys, groups)
    hot = common.hot_keys(pairs.groupBy("witness").agg(F.count(F.lit(1)).alias("n")))
    sides = pairs.join(texts.select("ord", F.col("words").alias("a")), "ord")
    sides = common.join_unique(sides, texts.select(F.col("ord").alias("witness"), F.col("words").alias("b")), ["witness"], hot)
    return common.map_arrow(sides.select("ord", "a", "b"), verify, "ord long").distinct().join(texts.select("ord", "doc", "line"), "ord").select("doc", "line").distinct()


def _slices(batch, chars: int = 200_000):
    """Parts of a batch of (id, text) of about so many characters, as variants are many."""
    ids, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
    while at < len(texts):
        end, room = at, chars
        while end < len(texts) and room > 0:
            room -= len(texts[end])
            end += 1
        yield ids[at:end], texts[at:end]
        at = end


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, every: bool = False, drop_emptied: bool = False, min_words: int = MIN_WORDS, edit_words: int = EDIT_WORDS) -> DataFrame:
    """Texts without lines that repeat an earlier line: the columns id, text, *keep, n_lines, n_removed.

    Earlier means a smaller (doc_id, line number).  A line goes if an earlier one has the same
    words, or, from edit_words words on, words at most one edit away; what becomes of the
    earlier line does not matter.  Lines of under min_words words stay,
    unless `every` line with a word is to take part; then a letter of a script without blanks
    is also a word of its own in the edit bound.  With `every`, drop_emptied leaves out
    documents that had a word and have none left.  White space counts
    only between words.  A null text stays null (0 lines); rows with a null id stay as they
    are; rows that share an id stand at the same place, so repeats of a whole row are treated
    alike.  An empty table gives an empty result.  Columns of docs that are not named are not
    read, and kept ones may have any name but those of the result.
    """
    keep = keep or []
    min_words, units = (1, UNITS) if every else (min_words, WORDS)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    texts = docs.select("id", "text")
    lines = common.materialise(_distinct_lines(texts, min_words, units, edit_words), "lines")
    gone = common.materialise(_near_equal(texts, lines, units), "lines-near")
    kept = lines.select("doc", "line").join(gone, ["doc", "line"], "left_anti").groupBy("doc").agg(F.collect_list("line").alias("kept"))
    joined, split = docs.join(kept, docs["id"] == kept["doc"], "left"), F.split("text", "\n", -1)
    if drop_emptied:
        left = F.coalesce(F.array_min("kept") < F.size(split), F.lit(False))
        joined = joined.filter(F.col("id").isNull() | F.col("text").isNull() | left | ~F.col("text").rlike(_W))
    long_enough = f"{_W}+{_S}+" * (min_words - 1) + _W
    positions = F.coalesce("kept", F.array().cast("array<int>"))

    def staying(lines):
        # the places of what stays, sorted, and then the lines at those places: no search for each line
        short = F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(long_enough), i)), lambda i: i.isNotNull())
        own = F.filter(positions, lambda i: i < F.size(lines))  # another row of the id may have more lines
        return F.transform(F.sort_array(F.array_union(short, own)), lambda i: F.element_at(lines, i + 1))

    # bound by let, so that no plan that moves a filter below can split the text again for each line
    rest = F.when(F.col("id").isNull(), split).otherwise(let(split, staying))
    out = joined.withColumn("all", split).withColumn("rest", rest)
    return out.select(
        F.col("id").alias(id_col),
        F.array_join("rest", "\n").alias(text_col),
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("all")).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("all") - F.size("rest")).cast("long").alias("n_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT doc_id, line, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM d)),
f AS (SELECT w, min({'d': doc_id, 'i': i}) AS pos FROM l WHERE len(w) >= 3 GROUP BY w),
e AS (SELECT w, pos, unnest(range(1, len(w) + 1)) AS j FROM f WHERE len(w) >= 8),
v AS (SELECT w, pos, j, list_concat(w[:j-1], w[j+1:]) AS v FROM e),
sub AS (SELECT pos, min(pos) OVER (PARTITION BY v, j) AS first FROM v),
whole AS (SELECT v.pos AS a, f.pos AS b FROM v JOIN f ON f.w = v.v WHERE len(f.w) >= 8),
gone AS (SELECT pos FROM sub WHERE first < pos UNION SELECT a FROM whole WHERE b < a UNION SELECT b FROM whole WHERE a < b),
kept AS (SELECT pos FROM f WHERE pos NOT IN (SELECT pos FROM gone)),
r AS (SELECT l.doc_id, l.i, l.line, len(l.w) < 3 OR kept.pos IS NOT NULL AS stays FROM l LEFT JOIN kept ON kept.pos = {'d': l.doc_id, 'i': l.i})
SELECT d.doc_id, coalesce(len(a), 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(g.t, '')) AS text_sha256
FROM d LEFT JOIN (SELECT doc_id, sum((NOT stays)::INT) AS n, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '') AS t FROM r GROUP BY doc_id) g USING (doc_id)
"""
