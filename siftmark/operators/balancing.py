"""Deterministic balancing of ecosystems to one number of rows.

The result is that of dealing rows round by round: in each round every group
(component, version) of an ecosystem that still has rows gives its next one, groups in
order of (group size, component rows, lower-case name, version), until the target is
reached. Dealing itself would put an ecosystem into one task. Instead the number of full
rounds follows from a histogram of group sizes: sizes that differ number at most about
the square root of twice the rows, so the histogram stays small. Only the groups of the
last, partial round that tie on size and component rows are ranked by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftmark.functions.text import null_to_blank, strip
from siftmark.operators.datasets import COMPONENT, COORDINATE
from siftmark.operators.ranking import row_number_within
from siftmark.session import written

_SEP = "\x01"


def _prepared(rows: DataFrame, ecosystems: list[str]) -> DataFrame:
    eco = F.lower(strip(null_to_blank(F.col("ecosystem"))))
    return rows.withColumn("ecosystem", eco).where(F.col("ecosystem").isin(ecosystems))


def allotments(rows: DataFrame, ecosystems: list[str], strategy: str = "min") -> DataFrame:
    """Per group its size, the ecosystem's target and how many rows it gives (``take``)."""
    if strategy not in ("min", "median"):
        raise ValueError(f"unknown strategy: {strategy}")
    # The group table is read by every step below, so it is written once.
    sizes = written(
        _prepared(rows, ecosystems).groupBy(*COORDINATE).agg(F.count("*").alias("size"))
    )
    if sizes.isEmpty():
        raise ValueError("no rows to balance")
    totals = sizes.groupBy(*COMPONENT).agg(F.sum("size").alias("component_rows"))
    groups = sizes.join(totals, COMPONENT)

    histogram = sizes.groupBy("ecosystem", "size").agg(F.count("*").alias("n"))
    per_eco = histogram.groupBy("ecosystem").agg(F.sum(F.col("size") * F.col("n")).alias("rows"))
    # One row per ecosystem from here to the target.
    everyone = Window.partitionBy()
    middle = F.min("rows") if strategy == "min" else F.median("rows")
    target = per_eco.withColumn("target", F.floor(middle.over(everyone)).cast("bigint"))

    up = Window.partitionBy("ecosystem").orderBy("size")
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    from_here = up.rowsBetween(0, Window.unboundedFollowing)
    steps = (
        histogram.join(target, "ecosystem")
        .withColumns(
            {
                "full_rows": F.sum(F.col("size") * F.col("n")).over(so_far),
                "alive": F.sum("n").over(from_here),
            }
        )
        # Rows dealt once every group has given up to ``size`` rows.
        .withColumn(
            "dealt", F.col("full_rows") + F.col("size") * (F.col("alive") - F.col("n"))
        )
        .withColumns(
            {
                "dealt_before": F.coalesce(F.lag("dealt").over(up), F.lit(0)),
                "size_before": F.coalesce(F.lag("size").over(up), F.lit(0)),
            }
        )
    )
    left = F.col("target") - F.col("dealt_before")
    extra_rounds = F.floor(left / F.col("alive")).cast("bigint")
    cut = steps.where((F.col("dealt_before") <= F.col("target")) & (F.col("target") < F.col("dealt")))
    cut = cut.select(
        "ecosystem",
        (F.col("size_before") + extra_rounds).alias("rounds"),
        (left - extra_rounds * F.col("alive")).alias("rest"),
    )
    # Without a cut the target reaches past the last row and everything is kept.
    planned = written(
        groups.join(target.drop("rows"), "ecosystem").join(cut, "ecosystem", "left")
    )

    running = (
        planned.where("size > rounds")
        .groupBy("ecosystem", "rest", "size", "component_rows")
        .agg(F.count("*").alias("n"))
    )
    earlier = (
        Window.partitionBy("ecosystem")
        .orderBy("size", "component_rows")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    heads = running.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(
        "ecosystem",
        "size",
        "component_rows",
        F.when(F.col("before") + F.col("n") <= F.col("rest"), F.col("n"))
        .otherwise(F.greatest(F.col("rest") - F.col("before"), F.lit(0)))
        .alias("places"),
        "n",
    )
    placed = planned.join(heads, ["ecosystem", "size", "component_rows"], "left")
    tied = F.coalesce((F.col("places") > 0) & (F.col("places") < F.col("n")), F.lit(False))
    take = (
        F.when(F.col("rounds").isNull() | (F.col("size") <= F.col("rounds")), F.col("size"))
        .when(F.col("places") == F.col("n"), F.col("rounds") + 1)
        .otherwise(F.col("rounds"))
    )
    columns = [*COORDINATE, "size", "target"]
    settled = placed.where(~tied).select(*columns, take.alias("take"))
    by_name = placed.where(tied).withColumn(
        "name_order",
        F.concat_ws(_SEP, F.lower("component_name"), "component_version", "component_name"),
    )
    ranked = row_number_within(by_name, ["ecosystem"], "name_order", "place").select(
        *columns,
        (F.col("rounds") + F.when(F.col("place") <= F.col("places"), 1).otherwise(0)).alias("take"),
    )
    return settled.unionByName(ranked)


def balance(
    rows: DataFrame, ecosystems: list[str], strategy: str = "min", plan: DataFrame | None = None
) -> DataFrame:
    """The kept rows; inside a group the first by (advisory, CVE, ord).

    ``plan`` is what ``allotments`` gives for these rows, if it is there already.
    """
    if plan is None:
        plan = allotments(rows, ecosystems, strategy)
    planned = _prepared(rows, ecosystems).join(plan.where("take > 0"), COORDINATE)
    part = F.col("take") < F.col("size")
    ordered = planned.where(part).withColumn(
        "_order",
        F.concat_ws(_SEP, null_to_blank(F.col("vulnerability_id")), null_to_blank(F.col("cve")), "ord"),
    )
    first = row_number_within(ordered, COORDINATE, "_order", "_place").where(
        F.col("_place") <= F.col("take")
    )
    kept = planned.where(~part).unionByName(first.drop("_order", "_place"))
    return kept.select(*rows.columns)


def balance_stats(
    rows: DataFrame, ecosystems: list[str], strategy: str = "min", plan: DataFrame | None = None
) -> DataFrame:
    """Per ecosystem: rows before and after, the target, components and versions kept."""
    if plan is None:
        plan = allotments(rows, ecosystems, strategy)
    kept = F.col("take") > 0
    return plan.groupBy("ecosystem").agg(
        F.sum("size").alias("original_rows"),
        F.sum("take").alias("kept_rows"),
        F.max("target").alias("target"),
        F.count_distinct(F.when(kept, F.col("component_name"))).alias("unique_components"),
        F.count_if(kept).alias("unique_component_versions"),
    )
