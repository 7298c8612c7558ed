"""Operator 4: personal data by candidate gradient boosting, in DataFrame functions only.

Base spans are matches of four fixed patterns that pass a check.  Beyond them, generators of
high recall propose further, overlapping spans (written-out emails, phone numbers without a
country code, grouped or mistyped cards, national ids, bank accounts, secrets).  Boosted trees
judge each from its format and the words around it; the trees are fitted here, on examples
made from the templates below, and run as a column expression.  A threshold on the calibrated
probability selects; what overlaps a base span or a better candidate is left out.

Match offsets come from cutting a text at a pattern: pieces and matches alternate, so the
running lengths are the offsets, in code points.  Patterns are possessive and start at the
edge of a run, so that no text makes them backtrack over and over.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions.text import let

from . import common
from .boost import Boosted

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, each made free of backtracking (same matches).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern to be tried.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Generators: kind proposed, what a text must hold, pattern.  They may overlap each other and the base spans.
#: Runs of the characters of a secret or a local part are taken whole, however long.
GENERATORS = (
    ("email", r"(?i)[\x20\[({](?:at|@)[\x20\])}]", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+(?: ?[\[({] ?(?:at|@) ?[\])}] ?[A-Za-z0-9-]{2,63}+(?:(?: ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot |\.)[A-Za-z]{2,24}+){1,3}| at [A-Za-z0-9-]{2,63}+(?: dot [A-Za-z]{2,24}+){1,3})(?![A-Za-z0-9])"),
    ("phone", r"[0-9]{3,4}[ ./-][0-9]{3}|\([0-9]{2,4}\)", r"(?<![0-9A-Za-z+.])\(?[0-9]{2,5}+\)?(?:[ ./-]{1,2}+[0-9]{2,8}+){1,4}(?![0-9A-Za-z])"),
    ("card", r"[0-9]{4}[ .-]?[0-9]{4}", r"(?<![0-9A-Za-z])[0-9]{4}(?:[ .-]?[0-9]{3,8}+){2,4}(?![0-9A-Za-z])"),
    ("national_id", r"[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}", r"(?<![0-9A-Za-z-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z-])"),
    ("account", r"[A-Z]{2}[0-9]{2}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])"),
    ("secret", r"(?i)(?:password|passwd|secret|token|api_?key)[\"']? ?[=:]", r"(?i)(?<![A-Za-z])(?:password|passwd|secret|token|api_?key)[\"']? ?[=:] ?[\"']?[A-Za-z0-9+/_.~!@#$%^&*-]{6,}+"),
    ("secret", r"[A-Za-z0-9_-]{20}", r"(?<![A-Za-z0-9_-])(?:AKIA|ASIA|ghp_|gho_|xox[bp]-|sk-|sk_live_|AIza)[A-Za-z0-9_-]{12,}+"),
)
ALL_KINDS = (*KINDS, "national_id", "account", "secret")
#: Probability from which a candidate is redacted.
THRESHOLD = 0.9
#: Characters looked at on either side.
BEFORE, AFTER = 24, 12
#: Items of a group, of groups of groups, and code points of a block.
GROUP, GROUPS, BLOCK = 256, (4096, 64), 1024
_NEAR = {"email": "mail|contact|write|reach", "phone": "phone|tel|call|mobile|cell|fax|whatsapp|dial", "card": "card|visa|master|amex|credit|debit|payment", "national_id": "ssn|social|security|national|tax", "account": "iban|account|bank|transfer", "secret": "pass|secret|token|key|credential|login|aws"}
_AGAINST = "version|isbn|order|invoice|page|ticket|item|part|serial|model|chapter|section|line|room|year|date|build|release|total|price|sku|ref"
FEATURES = ("kind", "digits", "length", "seps", "parens", "near", "against", "luhn", "groups", "first", "joined", "at_words", "dot_words", "year", "mixed", "dotted")


def _py_features(kind: str, before: str, m: str, after: str) -> list[float]:
    """The features of a candidate, for fitting; _features says the same in columns."""
    digits = re.sub("[^0-9]", "", m)
    groups = re.findall("[0-9]+", m)
    return [
        float(ALL_KINDS.index(kind)), len(digits), len(m), len(re.findall("[ ./-]", m)), len(re.findall("[()]", m)),
        len(re.findall(f"(?i){_NEAR[kind]}", before)), len(re.findall(f"(?i){_AGAINST}", before)), float(_py_luhn(digits)),
        len(groups), len(groups[0]) if groups else 0, float(bool(re.match("[A-Za-z0-9%€$£]", after))),
        len(re.findall(r"(?i)[ \[({](?:at|@)[ \])}]", m)), len(re.findall(r"(?i)[ \[({]dot[ \])}]", m)),
        float(bool(re.search("(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])", m))),
        float(bool(re.search("[0-9]", m) and re.search("[A-Za-z]", m))), len(re.findall(r"[0-9]\.[0-9]", m)),
    ]


def _py_luhn(digits: str) -> bool:
    if not 13 <= len(digits) <= 19:
        return False
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def luhn(digits: Column) -> Column:
    """Whether a string of digits has 13 to 19 of them and a right check digit."""
    doubled = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), doubled), F.lit(0), lambda a, b: a + b)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def _features(kind: Column, before: Column, m: Column, after: Column) -> list[Column]:
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    flag = lambda c: c.cast("int").cast("double")
    digits = F.regexp_replace(m, "[^0-9]", "")
    by_kind = reduce(lambda rest, k: F.when(kind == k, count(before, f"(?i){_NEAR[k]}")).otherwise(rest), _NEAR, F.lit(0.0))
    number = reduce(lambda rest, k: F.when(kind == k, float(ALL_KINDS.index(k))).otherwise(rest), ALL_KINDS, F.lit(0.0))
    return [
        number, F.length(digits).cast("double"), F.length(m).cast("double"), count(m, "[ ./-]"), count(m, "[()]"),
        by_kind, count(before, f"(?i){_AGAINST}"), flag(luhn(digits)),
        count(m, "[0-9]+"), F.length(F.regexp_extract(m, "[0-9]+", 0)).cast("double"), flag(after.rlike("^[A-Za-z0-9%€$£]")),
        count(m, r"(?i)[ \[({](?:at|@)[ \])}]"), count(m, r"(?i)[ \[({]dot[ \])}]"),
        flag(m.rlike("(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")),
        flag(m.rlike("[0-9]") & m.rlike("[A-Za-z]")), count(m, r"[0-9]\.[0-9]"),
    ]


def examples() -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates made from templates: each kind's formats with and without its context, and look-alikes."""
    rng = np.random.default_rng(11)
    digit = lambda s: re.sub("d", lambda _: str(rng.integers(0, 10)), s)
    words = ["the", "of", "and", "der", "les", "para", "note", "see", "also", "was"]
    hints = {"email": ["mail", "contact", "write to"], "phone": ["phone", "call", "tel.", "mobile", "fax"], "card": ["card", "visa", "credit card", "payment"], "national_id": ["ssn", "social security"], "account": ["iban", "account", "bank transfer"], "secret": ["login", "key", "credentials"]}
    against = ["version", "isbn", "order", "invoice", "page", "ticket", "serial", "date", "build", "total", "ref"]

    def carded(shape: str, good: bool) -> str:
        while True:
            s = digit(shape)
            if _py_luhn(re.sub("[^0-9]", "", s)) == good:
                return s

    name = lambda: "".join(rng.choice(list("abcdeilmnorst"), 6))
    code = lambda n: "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789"), n))
    rows: list[tuple[str, str, str, str, int]] = []

    def add(kind: str, make, label_hint: int, label_plain: int, label_against: int, times: int = 14) -> None:
        for _, (mode, label) in product(range(times), (("hint", label_hint), ("plain", label_plain), ("against", label_against))):
            word = {"hint": rng.choice(hints[kind]), "plain": rng.choice(words), "against": rng.choice(against)}[mode]
            rows.append((kind, f"{rng.choice(words)} {word} ", make(), rng.choice(["", " ", ".", ", and", " the"]), label))

    for shape in ("(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "ddd ddd dddd", "(ddd) dddd dddd"):
        add("phone", lambda s=shape: digit(s), 1, 1, 0)
    for shape in ("dd dd dd dd dd", "ddd ddd ddd", "dddd dddddd", "ddd-dddd"):
        add("phone", lambda s=shape: digit(s), 1, 0, 0)
    for shape in ("20dd-dd-dd", "dd/dd/20dd", "19dd-20dd", "dd.dd.20dd", "dd.dd", "ddd-d-dd", "dddd-dddd-dddd-dddd", "dd-dd", "20dd 20dd", "dd.ddd.ddd"):
        add("phone", lambda s=shape: digit(s), 0, 0, 0)
    for sep in (" ", "-", "."):
        add("card", lambda p=sep: carded(p.join(["4ddd"] + ["dddd"] * 3), True), 1, 1, 0)
        add("card", lambda p=sep: carded(p.join(["5ddd"] + ["dddd"] * 3), False), 1, 0, 0)
    for shape in ("ddddddddddddd", "dddd dddd dddd", "20dd-20dd-20dd", "dddd.dddd.dddd", "dddddddddddddddddd"):
        add("card", lambda s=shape: carded(s, False), 0, 0, 0)
    def dealt(total: int, least: int, most: int) -> list[int]:
        """A number of digits in random groups."""
        out = []
        while total:
            size = min(total, int(rng.integers(least, most + 1)))
            size = total if 0 < total - size < least else size
            out.append(size)
            total -= size
        return out

    def any_phone(parens: bool) -> str:
        head, sep = int(rng.integers(2, 5)), str(rng.choice([" ", "-", ".", "/"]))
        rest = int(rng.integers(9, 12)) - head
        groups = [rest] if rng.random() < 0.2 else dealt(rest, 2, 4)
        first = ("0" if rng.random() < 0.5 else "d") + "d" * (head - 1)
        return digit(f"({first}) " * parens + (first + sep) * (not parens) + sep.join("d" * g for g in groups))

    def any_card() -> str:
        sep, first = str(rng.choice([" ", "-", ".", ""])), str(rng.choice(list("3456")))
        groups = dealt(int(rng.choice([15, 16, 16, 19])) - 4, 3, 8)
        return carded(sep.join([first + "ddd"] + ["d" * g for g in groups]), True)

    add("phone", lambda: any_phone(True), 1, 1, 0, 60)
    add("phone", lambda: any_phone(False), 1, 0, 0, 90)
    add("phone", lambda: digit("ddd" + str(rng.choice(list(" -./"))) + "ddd" + str(rng.choice(list(" -./"))) + "dddd"), 1, 1, 0, 40)
    add("card", any_card, 1, 1, 0, 60)
    for at, dot in ((" (at) ", "."), (" [at] ", " dot "), ("[at]", "[dot]"), (" @ ", ".")):
        add("email", lambda a=at, d=dot: name() + (a if a != " @ " else " (@) ") + d.join(name()[: int(rng.integers(3, 7))] for _ in range(rng.integers(1, 3))) + d + str(rng.choice(["com", "org", "net", "edu", "de"])), 1, 1, 1)
    add("national_id", lambda: digit("ddd-dd-dddd"), 1, 1, 0)
    add("national_id", lambda: digit("ddd dd dddd"), 1, 0, 0)
    add("account", lambda: digit("DEdd") + digit(" dddd dddd dddd dddd dd"), 1, 1, 1)
    add("account", lambda: digit("GBdd") + code(4) + digit("dddddddddddddd"), 1, 1, 0)
    add("account", lambda: "AB" + digit("dd") + " " + code(4) + " " + code(4) + " " + code(4), 1, 0, 0)
    add("secret", lambda: f"{rng.choice(['password', 'api_key', 'secret', 'token'])}={code(12).lower()}", 1, 1, 1)
    add("secret", lambda: "AKIA" + code(16), 1, 1, 1)
    add("secret", lambda: "ghp_" + code(36), 1, 1, 1)
    # letters with a digit somewhere, or long ones, of any length
    mixed = lambda: (lambda t, n: t[:n] + digit("d") + t[n:])(code(int(rng.integers(7, 60))).lower(), int(rng.integers(1, 7)))
    named = ["password", "passwd", "secret", "token", "api_key", "apikey"]
    add("secret", lambda: str(rng.choice(named)) + str(rng.choice(["=", ": ", ":", ' = "'])).replace(" = ", "=") + mixed(), 1, 1, 1, 40)
    add("secret", lambda: str(rng.choice(named)) + "=" + name() + digit("dd") + name(), 1, 1, 1, 20)
    add("secret", lambda: str(rng.choice(["AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk-", "sk_live_", "AIza"])) + (digit("d" * 12) + "-" + name() + name() if rng.random() < 0.4 else code(int(rng.integers(14, 240)))), 1, 1, 1, 40)
    add("secret", lambda: f"{rng.choice(['password', 'secret', 'token'])}: {name()}", 1, 0, 0)
    for dot in (" dot ", " [dot] ", "."):
        add("email", lambda p=dot: f"{name()}{rng.choice([' [at] ', ' (at) '])}{name()}{p}com", 1, 1, 1)
    add("email", lambda: f"{name()} at {name()} dot com", 1, 1, 1)
    add("email", lambda: f"{name()} at {name()}. {name()}", 0, 0, 0)
    add("email", lambda: f"{name()} at {name()}.{name()}", 0, 0, 0)
    x = np.array([_py_features(k, b[-BEFORE:], m, a[:AFTER]) for k, b, m, a, _ in rows], float)
    y = np.array([r[4] for r in rows], float)
    order = rng.permutation(len(y))
    return x[order], y[order]


@cache
def model() -> Boosted:
    return Boosted(*examples())


def grouped(items: Column, size: int) -> Column:
    """The items in order, in arrays of `size`; one empty array if there are none."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(size)), lambda s: F.slice(items, s, size))


def running(items: Column, step) -> Column:
    """struct<last, before> of a number that starts at 0 and becomes step(number, item): what it was before each item, and at last.

    In groups, since an array that grows by each item is copied each time.
    """
    none = F.array().cast("array<int>")

    def within(state: Column, group: Column) -> Column:
        return F.aggregate(group, F.struct(state.alias("last"), none.alias("before")), lambda acc, x: F.struct(step(acc["last"], x).alias("last"), F.concat(acc["before"], F.array(acc["last"])).alias("before")))

    def over(acc: Column, group: Column) -> Column:
        return let(within(acc["last"], group), lambda r: F.struct(r["last"].alias("last"), F.concat(acc["parts"], F.array(r["before"])).alias("parts")))

    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<array<int>>").alias("parts"))
    return F.aggregate(grouped(items, GROUP), start, over, lambda acc: F.struct(acc["last"].alias("last"), F.flatten(acc["parts"]).alias("before")))


def matches(text: Column, needs: str, pattern: str) -> Column:
    """array<struct<start, end, m>> of the matches of pattern, in code points, end exclusive."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,m:string>>")
    pairs = let(F.struct(found.alias("found"), pieces.alias("pieces")), lambda x: F.zip_with(F.slice(x["pieces"], 1, F.size(x["found"])), x["found"], lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("long"), m.alias("m"))))
    placed = let(pairs, lambda xs: F.zip_with(xs, running(xs, lambda pos, x: pos + x["gap"] + x["long"])["before"], lambda x, pos: F.struct((pos + x["gap"]).alias("start"), (pos + x["gap"] + x["long"]).alias("end"), x["m"].alias("m"))))
    return F.when(text.rlike(needs), placed).otherwise(empty)


def blocks_of(text: Column) -> Column:
    """The text in pieces of BLOCK code points: a place in a piece is found at once, one in a long text by walking up to it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start up to end, 0-based, of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(some, start - first * BLOCK + 1, end - start)).otherwise("")


def unbeaten(items: Column, rivals: Column, beats, sizes: tuple[int, ...]) -> Column:
    """The items that no rival that overlaps them beats; both have start and end, items are sorted by start.

    In groups of neighbours, and groups within groups: a group's items are held against the
    rivals that overlap the group alone.
    """
    if not sizes:
        return F.filter(items, lambda i: ~F.exists(rivals, lambda r: _overlap(r, i) & beats(r, i)))

    def of_group(group: Column) -> Column:
        reach = F.struct(F.array_min(F.transform(group, lambda i: i["start"])).alias("start"), F.array_max(F.transform(group, lambda i: i["end"])).alias("end"))
        near = let(reach, lambda g: F.filter(rivals, lambda r: _overlap(r, g)))
        return let(near, lambda rs: unbeaten(group, rs, beats, sizes[1:]))

    return F.flatten(F.transform(grouped(items, sizes[0]), of_group))


def _passes(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|(?<=0))(?:\.|$)){4}$")
    return {"email": F.lit(True), "card": luhn(digits), "phone": F.length(digits).between(9, 15)}[kind]


def _checked(kind: str):
    return lambda s: _passes(kind, s["m"])


def _named(kind: str, spans: Column, with_match: bool) -> Column:
    """Spans with their kind, and with or without what they matched."""
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *([s["m"].alias("m")] if with_match else [])))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of whole texts: (doc_id, text, base, spans), spans as array<struct<kind, start, end>>.

    base holds the checked matches of the four base patterns, spans these and the selected
    candidates, both by kind in the order of ALL_KINDS, then start; offsets are code points,
    end exclusive.  A null text counts as empty: no spans.  Rows are independent; repeated
    rows and null ids pass through one to one; other columns are not read.  No shuffle.
    """
    d = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    base = [_named(k, F.filter(matches(text, NEEDS[k], BASE[k]), _checked(k)), False) for k in KINDS]
    proposed = [_named(kind, matches(text, needs, pattern), True) for kind, needs, pattern in GENERATORS]
    by_start = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["m"].alias("m"))
    d = d.withColumn("base", F.concat(*base)).withColumn("proposed", F.array_sort(F.transform(F.concat(*proposed), by_start)))
    free = unbeaten(F.col("proposed"), F.col("base"), lambda r, i: F.lit(True), GROUPS)
    # two generators may propose the same
    once = let(free, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1))))
    d = d.withColumn("free", once).withColumn("blocks", F.when(F.size("free") > 0, blocks_of(text)))

    def describe(s: Column) -> Column:
        before = cut(F.col("blocks"), F.greatest(s["start"] - BEFORE, F.lit(0)), s["start"])
        after = cut(F.col("blocks"), s["end"], s["end"] + AFTER)
        cols = _features(s["kind"], before, s["m"], after)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *[c.alias(f"f{i}") for i, c in enumerate(cols)])

    d = d.withColumn("described", F.transform("free", describe))
    judge = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), model().column([s[f"f{i}"] for i in range(len(FEATURES))]).alias("p"))
    d = d.withColumn("judged", F.filter(F.transform("described", judge), lambda s: s["p"] >= threshold))
    better = lambda a, b: (a["p"] > b["p"]) | ((a["p"] == b["p"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & ((a["end"] > b["end"]) | ((a["end"] == b["end"]) & (a["kind"] < b["kind"]))))))
    added = F.transform(unbeaten(F.col("judged"), F.col("judged"), better, GROUPS), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    order = lambda s: reduce(lambda rest, k: F.when(s["kind"] == k, ALL_KINDS.index(k)).otherwise(rest), ALL_KINDS, F.lit(99))
    keyed = F.transform(F.concat("base", added), lambda s: F.struct(order(s).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return d.select(id_col, "text", "base", spans.alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """found with the column redacted: the text with each span replaced by its kind in brackets, outer spans first.

    Spans that overlap are replaced as one, by the kind of the first.
    """
    order = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))
    d = found.withColumn("_sorted", F.array_sort(F.transform("spans", order))).withColumn("_blocks", F.when(F.size("_sorted") > 0, blocks_of(F.col("text"))))
    d = d.withColumn("_upto", running(F.col("_sorted"), lambda end, s: F.greatest(end, -s["neg"])))
    said = F.zip_with("_sorted", "_upto.before", lambda s, end: F.when(s["start"] >= end, F.concat(cut(F.col("_blocks"), end, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
    tail = cut(F.col("_blocks"), F.col("_upto.last"), F.length("text"))
    redacted = F.when(F.size("_sorted") > 0, F.concat(F.array_join(said, ""), tail)).otherwise(F.col("text"))
    return d.withColumn("redacted", redacted).select(*[F.col(f"`{c}`") for c in found.columns], "redacted")


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_pii(common.table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
