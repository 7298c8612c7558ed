"""Joins of intervals: overlap and containment as equi-joins on the blocks of a few grids.

Positions are whole numbers; an interval holds both its ends.  A grid has blocks of a power of
two of positions.  An interval lies in the first grid whose blocks are as long as it, and so in
two blocks at most; one longer than the last grid's blocks lies in as many of these as it
meets.  A position lies in one block of each grid.  So a position in an interval shares exactly
one block with it, and the rows of one key are dealt out by blocks, however many there are.
What shares a block and isn't in the interval is left out in the join itself; it is from within
two blocks, which are as long as the interval up to the ratio of two grids.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Block lengths of the grids, as powers of two, where the caller does not know how long the intervals are.
GRIDS = (4, 8, 12, 16)


def _block(at: Column, bits: int) -> Column:
    return F.shiftright(at.cast("long"), bits)


def blocks_of_interval(lo: Column, hi: Column, grids: Sequence[int] = GRIDS) -> Column:
    """array<struct<grid, block>>: the blocks of its grid that an interval meets; none where hi < lo or one is null."""
    met = lambda g: F.transform(F.sequence(_block(lo, g), _block(hi, g)), lambda b: F.struct(F.lit(g).alias("grid"), b.alias("block")))
    runs = [met(g) for g in grids]
    fits = [hi - lo < (1 << g) for g in grids[:-1]]
    found = reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(list(zip(fits, runs[:-1], strict=True))), runs[-1])
    return F.when(lo <= hi, found)


def blocks_of_position(at: Column, grids: Sequence[int] = GRIDS) -> Column:
    """array<struct<grid, block>>: the block of each grid in which a position lies."""
    return F.array(*[F.struct(F.lit(g).alias("grid"), _block(at, g).alias("block")) for g in grids])


def _packed(df: DataFrame, keys: list[str], name: str, blocks: Column) -> DataFrame:
    """The keys, all other columns as one struct, and a row for each block."""
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys]).alias(name)
    held = df.dropna(subset=keys).select(*[F.col(f"`{k}`").alias(f"_{name}_{i}") for i, k in enumerate(keys)], rest, F.explode(blocks).alias("_at"))
    return held.select(*[c for c in held.columns if c != "_at"], F.col("_at.grid").alias(f"_{name}_grid"), F.col("_at.block").alias(f"_{name}_block"))


def positions_within(positions: DataFrame, intervals: DataFrame, keys: list[str], at: str, lo: str = "lo", hi: str = "hi", names: tuple[str, str] = ("position", "interval"), grids: Sequence[int] = GRIDS, after: bool = False) -> DataFrame:
    """Pairs of a row of positions and a row of intervals of the same keys with lo <= at <= hi, as two structs called names.

    With after, positions at lo are left out.  Rows with a null key or bound, and intervals
    that end before they begin, are in no pair.  Repeated rows pair as often as they stand.
    """
    p_name, i_name = names
    p = _packed(positions.filter(F.col(at).isNotNull()), keys, p_name, blocks_of_position(F.col(at), grids))
    i = _packed(intervals, keys, i_name, blocks_of_interval(F.col(lo), F.col(hi), grids))
    place, begin, end = F.col(f"{p_name}.{at}"), F.col(f"{i_name}.{lo}"), F.col(f"{i_name}.{hi}")
    held = [F.col(f"_{p_name}_{x}") == F.col(f"_{i_name}_{x}") for x in (*range(len(keys)), "grid", "block")]
    held += [place > begin if after else place >= begin, place <= end]
    whole = lambda df, name: F.struct(*[(F.col(f"_{name}_{keys.index(c)}") if c in keys else F.col(f"{name}.`{c}`")).alias(c) for c in df.columns]).alias(name)
    # what blocks make of a row is more than the sizes of files tell, so a side that looks small isn't broadcast
    return p.join(i.hint("merge"), reduce(lambda a, b: a & b, held)).select(whole(positions, p_name), whole(intervals, i_name))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", grids: Sequence[int] = GRIDS) -> DataFrame:
    """(left, right) structs of the pairs of equal keys whose intervals lo..hi share a position, each pair once.

    Of two intervals that overlap, the one that begins later begins inside the other; of two
    that begin together, the right one is taken to.  Nulls and repeats as in positions_within.
    """
    sound = F.col(lo) <= F.col(hi)
    left, right = left.filter(sound), right.filter(sound)
    later_right = positions_within(right, left, keys, lo, lo, hi, ("right", "left"), grids).select("left", "right")
    return later_right.unionByName(positions_within(left, right, keys, lo, lo, hi, ("left", "right"), grids, after=True))


def innermost(inner: DataFrame, outer: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", grids: Sequence[int] = GRIDS) -> DataFrame:
    """inner with outer_lo and outer_hi: the shortest interval of outer that holds the row's own whole.

    Of equally short ones that which begins first; null where none holds it.  Equal intervals
    of a key are looked up once.  Work grows with the outer intervals around the first position
    of an inner one: the depth, where they are nested.
    """
    asked = inner.select(*keys, lo, hi).filter(F.col(lo) <= F.col(hi)).distinct()
    around = positions_within(asked, outer.select(*keys, lo, hi).distinct(), keys, lo, lo, hi, ("i", "o"), grids)
    around = around.filter(F.col(f"o.{hi}") >= F.col(f"i.{hi}"))
    best = F.min(F.struct((F.col(f"o.{hi}") - F.col(f"o.{lo}")).alias("length"), F.col(f"o.{lo}").alias("lo"), F.col(f"o.{hi}").alias("hi"))).alias("best")
    own = {c: f"_own_{c}" for c in (*keys, lo, hi)}
    found = around.groupBy(F.col("i")).agg(best).select(*[F.col(f"i.{c}").alias(n) for c, n in own.items()], F.col("best.lo").alias("outer_lo"), F.col("best.hi").alias("outer_hi"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(n) for c, n in own.items()])
    return inner.join(found, same, "left").drop(*own.values())
