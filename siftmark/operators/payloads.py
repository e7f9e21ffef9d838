"""Results as one JSON document each: one row with one text.

Their inputs are summaries with a row per tool, pair of tools, ecosystem or metric, so a document
stays small whatever the data behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _by_name(a: Column, b: Column) -> Column:
    return F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)


def _nested(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """One row: ``{key: {key: ... value}}``, names in order."""
    if not keys:
        return df.select(value.alias("v"))
    out = df.select(*keys, value.alias("v"))
    for i in range(len(keys) - 1, -1, -1):
        entries = F.array_sort(F.collect_list(F.struct(F.col(keys[i]).alias("k"), F.col("v"))), _by_name)
        out = out.groupBy(*keys[:i]).agg(F.map_from_entries(entries).alias("v"))
    return out


def _listed(df: DataFrame, order: list[str]) -> Column:
    """All rows as a list in order, for a column of another one-row table."""
    rest = [c for c in df.columns if c not in order]
    rows = F.array_sort(F.collect_list(F.struct(*order, *rest)))
    return df.agg(rows).scalar()


def _document(df: DataFrame, *fields: Column) -> DataFrame:
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def statistics_payload(aggregate: DataFrame) -> DataFrame:
    """``{"metrics": {tool: {ecosystem: {metric: {mean, std, n, ci95}}}}}`` of ``run_aggregate``."""
    values = F.struct("mean", "std", "n", "ci95")
    return _document(_nested(aggregate, ["tool", "ecosystem", "metric"], values), F.col("v").alias("metrics"))


def results_payload(collapsed: DataFrame) -> DataFrame:
    """``{tool: {ecosystem: {metric: value}}}`` of ``collapse_repeats``."""
    return _nested(collapsed, ["tool", "ecosystem", "metric"], F.col("value")).select(F.to_json("v").alias("payload"))


def significance_payload(q: DataFrame, tests: DataFrame, tools: list[str], repeats: int, gt_rows: int) -> DataFrame:
    """Cochran's Q and the corrected pairwise tests, with the shape of what they are made of."""
    return _document(
        q,
        F.array(*[F.lit(t) for t in sorted(tools)]).alias("tools"),
        F.lit(repeats).alias("repeat_count"),
        F.lit(gt_rows).alias("ground_truth_size_per_repeat"),
        F.lit("all_repeats_concatenated").alias("significance_input"),
        F.array(F.lit(repeats * gt_rows), F.lit(len(tools))).alias("matrix_shape"),
        F.struct("statistic", "p_value").alias("cochran_q"),
        _listed(tests, ["p", "tool_a", "tool_b"]).alias("pairwise_mcnemar"),
    )


def summary_payload(summary: DataFrame, markers: DataFrame, baseline: str) -> DataFrame:
    """Tool summaries with the significance markers against a baseline."""
    marked = _nested(markers, ["tool"], F.col("marker"))
    return _document(
        marked, F.lit(baseline).alias("baseline"), F.col("v").alias("markers"),
        _listed(summary, ["rank", "tool"]).alias("tools"),
    )


def repeats_payload(stability: DataFrame) -> DataFrame:
    """``{tool: {stable, hashes}}`` of ``drift.repeat_stability``."""
    values = F.struct("stable", F.split("fingerprints", ",").alias("hashes"))
    return _nested(stability, ["tool"], values).select(F.to_json("v").alias("payload"))
