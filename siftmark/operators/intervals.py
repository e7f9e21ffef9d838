"""Containment joins that sort instead of pairing every version with every range.

A component may own a third of all rows, so nothing here forms the product of the
versions and the ranges of one group. Inputs are already distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.operators.ranking import running


def _canonical_blocks(first: Column, past: Column) -> Column:
    """Aligned power-of-two blocks that tile ``[first, past)``: at most two per level."""
    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        a = F.call_function("shiftright", first + size - 1, level)
        b = F.call_function("shiftright", past, level)
        odd_a, odd_b = F.pmod(a, F.lit(2)) == 1, F.pmod(b, F.lit(2)) == 1
        block = lambda i: F.struct(level.alias("level"), i.alias("block"))
        return F.array_compact(
            F.array(
                F.when((a < b) & odd_a, block(a)),
                F.when((a + F.when(odd_a, 1).otherwise(0) < b) & odd_b, block(b - 1)),
            )
        )

    top = F.length(F.bin(past)) - 1
    return F.flatten(F.transform(F.sequence(F.lit(0), top), at))


def _enclosing_blocks(index: Column, count: Column) -> Column:
    """The block of each level that holds position ``index`` of ``count`` positions."""
    top = F.length(F.bin(count)) - 1
    return F.transform(
        F.sequence(F.lit(0), top),
        lambda level: F.struct(
            level.alias("level"),
            F.call_function("shiftright", index, level).alias("block"),
        ),
    )


def _tiled(
    points: DataFrame, intervals: DataFrame, group: list[str], tag: str, owner: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Points by the blocks that hold them, and intervals by the blocks that tile them.

    Points are numbered along the axis inside their group; an interval then spans a run of
    numbers, which splits into at most two aligned blocks per power of two, and a point lies
    in one block per power of two. Equal blocks meet in a hash join, so ``p`` points and
    ``r`` intervals cost ``(p + r) log p``, not ``p * r``, and a hot group spreads over its
    blocks.
    """
    none = F.lit(None).cast("string")
    n = lambda i: F.lit(i).cast("bigint").alias("is_point")
    spans = intervals.select(
        *group,
        none.alias(tag),
        n(0),
        *owner,
        "lower",
        "upper",
        F.inline(
            F.array(
                F.struct(F.col("lower").alias("at"), F.lit(True).alias("is_lower")),
                F.struct(F.col("upper").alias("at"), F.lit(False).alias("is_lower")),
            )
        ),
    )
    marks = spans.unionByName(
        points.select(*group, tag, n(1), F.col("position").alias("at")), allowMissingColumns=True
    )
    # Groups without points or without intervals have no part.
    sizes = (
        marks.groupBy(*group).agg(F.sum("is_point").alias("n_points"), F.count("*").alias("_all"))
        .where("n_points > 0 and n_points < _all").drop("_all")
    )
    ranked = running(marks.join(sizes, group), group, "at", "is_point", "sum", "before")
    located = ranked.where("is_point = 1").select(
        *group, tag, F.inline(_enclosing_blocks(F.col("before") - 1, F.col("n_points")))
    )
    tiles = (
        ranked.where("is_point = 0")
        .groupBy(*group, *owner, "lower", "upper")
        .agg(
            F.min(F.when(F.col("is_lower"), F.col("before"))).alias("first"),
            F.max(F.when(~F.col("is_lower"), F.col("before"))).alias("past"),
        )
        .where("first < past")
        .select(*group, *owner, F.inline(_canonical_blocks(F.col("first"), F.col("past"))))
    )
    return located, tiles


def covering(
    points: DataFrame, intervals: DataFrame, group: list[str], tag: str, owner: list[str], order: str
) -> DataFrame:
    """(group, tag, owner, order): the intervals' orders that reach each point.

    ``points``: group columns, ``tag`` and ``position``. ``intervals``: group and owner
    columns, ``lower``, ``upper`` and ``order``. The least ``order`` per point and owner is
    that of the first interval over the point; a point meets at most one row per owner and
    power of two, not one per interval.
    """
    located, tiles = _tiled(points, intervals, group, tag, [*owner, order])
    first = tiles.groupBy(*group, *owner, "level", "block").agg(F.min(order).alias(order))
    return located.join(first, [*group, "level", "block"]).select(*group, tag, *owner, order)


def stabbing(
    points: DataFrame, intervals: DataFrame, group: list[str], tag: str, owner: list[str]
) -> DataFrame:
    """(group, tag, owner) for every interval over each point.

    The blocks of an interval are disjoint and a point is in one of each size, so an interval
    meets each of its points once and no pair is formed that does not hold: the rows made are
    those of the result. Intervals of one owner in one group must be disjoint.
    """
    located, tiles = _tiled(points, intervals, group, tag, owner)
    return located.join(tiles, [*group, "level", "block"]).select(*group, tag, *owner)


def covered(points: DataFrame, intervals: DataFrame, group: list[str]) -> DataFrame:
    """The points that at least one interval of their group covers.

    Sorted along the axis, a point is covered exactly when the farthest upper end among
    the intervals that started before it lies behind it: one running maximum, no pairs.
    """
    none = F.lit(None).cast("string")
    starts = intervals.groupBy(*group, "lower").agg(F.max("upper").alias("reach"))
    marks = points.select(*group, F.col("position").alias("at"), F.lit(True).alias("is_point"),
                          none.alias("reach")).unionByName(
        starts.select(*group, F.col("lower").alias("at"), F.lit(False).alias("is_point"), "reach")
    )
    return (
        running(marks, group, "at", "reach", "max", "reach")
        .where(F.col("is_point") & (F.col("reach") > F.col("at")))
        .select(*group, F.col("at").alias("position"))
    )
