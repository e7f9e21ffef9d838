"""Numbering the rows of groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.session import written


def running(
    df: DataFrame, keys: list[str], order: str | Column | list[str | Column], column: str, how: str, name: str
) -> DataFrame:
    """``sum`` or ``max`` of a column over a row and all before it, however many rows a key holds.

    Rows are dealt by ranges of (keys, order, tie-breaker) whose bounds Spark samples, so a
    large group spreads over as many tasks as its share asks for, whatever its order values
    look like. The dealt rows are written once, since bounds sampled anew could differ. What
    each range holds of a key is folded first and carried over to the ranges after it; windows
    only run inside a range. Rows that are equal in ``order`` come in no particular order.
    """
    order = order if isinstance(order, list) else [order]
    fold = {"sum": F.sum, "max": F.max}[how]
    dealt = written(
        df.withColumn("_tie", F.rand(17))
        .repartitionByRange(*keys, *order, "_tie")
        .withColumn("_slice", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        dealt.groupBy(*keys, "_slice")
        .agg(fold(column).alias("_held"))
        .select(
            *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
            F.col("_slice").alias("_of"),
            fold("_held").over(before).alias("_carried"),
        )
    )
    same = F.col("_slice") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    )
    own, rest = F.col("_own"), F.col("_carried")
    value = own + F.coalesce(rest, F.lit(0)) if how == "sum" else F.greatest(own, rest)
    return (
        dealt.withColumn("_own", fold(column).over(inside))
        .join(carried, same)
        .withColumn(name, value)
        .select(*[c for c in df.columns if c != name], name)
    )


def row_number_within(
    df: DataFrame, keys: list[str], order: str | Column | list[str | Column], name: str
) -> DataFrame:
    """``row_number`` per ``keys`` along ``order``, spread over many tasks like ``running``."""
    one = running(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, "_one", "sum", name)
    return one.drop("_one")


def first_row_per(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key. Spark keeps one row per key and task before the shuffle."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


#: Up to so many rows per key Spark cuts each task's rows before the shuffle.
GROUP_LIMIT = 1000


def first_rows_per(df: DataFrame, keys: list[str], n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of each key.

    Up to ``GROUP_LIMIT`` at most ``n`` rows per key and task are shuffled; beyond it rows are
    numbered over sampled ranges, so that a large key does not come to one task.
    """
    if n > GROUP_LIMIT:
        ranked = row_number_within(df, keys, list(order), "_rank")
    else:
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")
