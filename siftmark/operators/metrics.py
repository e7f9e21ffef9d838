"""Scores: counts of outcomes, recall and overlap, their summaries and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.functions import constants as K
from siftmark.functions.text import filled
from siftmark.operators.matching import (
    PACKAGE,
    SIGNATURE,
    for_each_tool,
    matched_signatures,
    missed_signatures,
    signatures,
)


def ratio(numerator: Column, denominator: Column) -> Column:
    """A quotient that is 0 when there is nothing to divide by."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def gt_summary(gt: DataFrame) -> DataFrame:
    """Per ecosystem: component versions, rows and distinct CVEs."""
    return gt.groupBy("ecosystem").agg(
        F.count_distinct("component", "version").alias("Components"),
        F.count("*").alias("Vulnerabilities"),
        F.count_distinct(F.when(filled(F.col("cve")), F.col("cve"))).alias("CVEs"),
    )


def outcome_counts(
    gt: DataFrame, findings: DataFrame, matched: DataFrame, tools: list[str], by: list[str], seen: bool = False
) -> DataFrame:
    """TP_EXACT, TP_RANGE, FP and FN per tool and ``by``, from signature-level matches.

    All four are sums that combine before the shuffle; no row-level outcome is built.
    A finding's chosen row lies in its own component, so extra findings are those
    reported less those chosen. With ``seen``, where a group first turns up is told in the same
    pass, as (list, ord): exact hits are list 0, range hits 1, findings 2, the ground truth 3.
    ``matched`` then has ``first_ord``.
    """
    zero = F.lit(0).cast("bigint")

    def least(place: Column | int, ord_: Column) -> list[Column]:
        return [F.min(F.struct(F.lit(place).alias("list"), ord_.alias("ord"))).alias("seen")] if seen else []

    exact = F.col("match_type") == K.TP_EXACT
    truth = gt.groupBy(*by).agg(F.count("*").alias("n_gt"), *([F.min("ord").alias("ord")] if seen else []))
    first = [F.struct(F.lit(3).alias("list"), "ord").alias("seen")] if seen else []
    hits = matched.groupBy("tool", *by).agg(
        F.sum(F.when(exact, F.col("n_rows")).otherwise(0)).alias("e"),
        F.sum(F.when(F.col("match_type") == K.TP_RANGE, F.col("n_rows")).otherwise(0)).alias("r"),
        F.sum("n_chosen").alias("n_chosen"),
        *least(F.when(exact, 0).otherwise(1), F.col("first_ord")),
    )
    reported = findings.groupBy("tool", *by).agg(F.count("*").alias("n_found"), *least(2, F.col("ord")))
    parts = (
        for_each_tool(truth, tools).select(
            "tool", *by, "n_gt", zero.alias("e"), zero.alias("r"),
            zero.alias("n_chosen"), zero.alias("n_found"), *first)
        .unionByName(hits.withColumns({"n_gt": zero, "n_found": zero}))
        .unionByName(
            reported.withColumns({"n_gt": zero, "e": zero, "r": zero, "n_chosen": zero})
        )
    )
    earliest = [F.min("seen").alias("seen")] if seen else []
    return (
        parts.groupBy("tool", *by)
        .agg(*[F.sum(c).alias(c) for c in ("n_gt", "e", "r", "n_chosen", "n_found")], *earliest)
        .select(
            "tool",
            *by,
            F.col("n_gt"),
            F.col("e").alias("TP_EXACT"),
            F.col("r").alias("TP_RANGE"),
            (F.col("e") + F.col("r")).alias("TP"),
            (F.col("n_found") - F.col("n_chosen")).alias("FP"),
            (F.col("n_gt") - F.col("e") - F.col("r")).alias("FN"),
            *(["seen"] if seen else []),
        )
    )


def ecosystem_metrics(
    gt: DataFrame, findings: DataFrame, tools: list[str], matched: DataFrame | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Counts, recall and overlap per tool and ecosystem of the ground truth.

    ``matched`` is what ``matched_signatures`` gives for these findings, and ``summary`` what
    ``gt_summary`` gives for this ground truth, if they are there already.
    """
    if matched is None:
        matched = matched_signatures(gt, findings, ["tool"])
    if summary is None:
        summary = gt_summary(gt)
    counts = outcome_counts(gt, findings, matched, tools, ["ecosystem"]).where("n_gt > 0")
    return counts.join(summary, "ecosystem").select(
        "tool",
        "ecosystem",
        "Components",
        "Vulnerabilities",
        "CVEs",
        "TP",
        "FP",
        "FN",
        ratio(F.col("TP"), F.col("TP") + F.col("FN")).alias("Recall"),
        ratio(F.col("TP"), F.col("TP") + F.col("FP")).alias("Overlap"),
    )


def silenced_metrics(gt: DataFrame, tools: list[str]) -> DataFrame:
    """Metrics of tools that report no security findings: every outcome is zero."""
    zero = F.lit(0).cast("bigint")
    return for_each_tool(gt_summary(gt), tools).select(
        "tool", "ecosystem", "Components", "Vulnerabilities", "CVEs",
        zero.alias("TP"), zero.alias("FP"), zero.alias("FN"),
        F.lit(0.0).alias("Recall"), F.lit(0.0).alias("Overlap"),
    )


def component_outcomes(gt: DataFrame, findings: DataFrame, tools: list[str]) -> DataFrame:
    """TP, FP and FN per tool, ecosystem and component."""
    matched = matched_signatures(gt, findings, ["tool"])
    return outcome_counts(gt, findings, matched, tools, PACKAGE).select(
        "tool", *PACKAGE, "TP", "FP", "FN"
    )


def top_groups(
    gt: DataFrame, findings: DataFrame, tools: list[str], by: list[str], measure: str, k: int
) -> DataFrame:
    """The ``k`` groups of each tool with the largest ``measure``; ties by first appearance.

    Exact hits, range hits, extra findings and misses are listed one after the other, each in input
    order. A group with a hit is first seen there, so its extra findings do not matter for ties;
    a group without one has no chosen finding, so its first finding is its first extra.
    """
    matched = matched_signatures(gt, findings, ["tool"], first=True)
    counts = outcome_counts(gt, findings, matched, tools, by, seen=True)
    order = Window.partitionBy("tool").orderBy(F.desc(measure), "seen")
    return (
        counts.dropna(subset=["tool", *by])
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("tool", *by, "TP", "FP", "FN", "rank")
    )


def miss_signatures(gt: DataFrame, matched: DataFrame, tools: list[str]) -> DataFrame:
    """Signatures a tool misses, with their number of rows."""
    found = matched.select("tool", *SIGNATURE)
    return for_each_tool(signatures(gt), tools).join(found, ["tool", *SIGNATURE], "left_anti")


def report_summary(gt: DataFrame, findings: DataFrame, tools: list[str]) -> DataFrame:
    """One row per tool: outcome totals, recall on all rows, exact recall, overlap."""
    matched = matched_signatures(gt, findings, ["tool"])
    counts = outcome_counts(gt, findings, matched, tools, ["ecosystem"])
    total = counts.groupBy("tool").agg(
        *[F.sum(c).alias(c) for c in ("TP_EXACT", "TP_RANGE", "TP", "FP", "FN", "n_gt")]
    )
    return total.select(
        "tool", "TP_EXACT", "TP_RANGE", "TP", "FP", "FN",
        F.col("n_gt").alias("Vulnerabilities"),
        ratio(F.col("TP"), F.col("n_gt")).alias("Recall"),
        ratio(F.col("TP_EXACT"), F.col("n_gt")).alias("Recall_EXACT"),
        ratio(F.col("TP"), F.col("TP") + F.col("FP")).alias("Overlap"),
    )


def report_matrix(
    gt: DataFrame,
    findings: DataFrame,
    matched: DataFrame,
    classified_fp: DataFrame,
    tools: list[str],
) -> DataFrame:
    """Per tool and ecosystem, and a TOTAL row: all outcome classes and scores.

    ``classified_fp`` has tool, ecosystem, fp_class. CVEs of the TOTAL row are distinct
    over all ecosystems, so they are counted apart, not summed.
    """
    misses = missed_signatures(gt, findings, tools, matched)
    zero = F.lit(0).cast("bigint")
    flag = lambda col, value: F.when(F.col(col) == value, F.col("n")).otherwise(zero)
    fn_names = {"FN_EXACT": K.FN_EXACT, "FN_RANGE": K.FN_RANGE, "FN_TRUE": K.FN_TRUE}
    fp_names = {n: n.replace("-", "_") for n in (K.FP_CERTAIN, K.FP_LIKELY, K.FP_UNCLEAR)}
    measures = ["TP_EXACT", "TP_RANGE", *fn_names, *fp_names.values()]

    def padded(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        return df.select(
            "tool", "ecosystem", *[columns.get(m, zero).alias(m) for m in measures]
        )

    parts = (
        padded(
            matched.withColumn("n", F.col("n_rows")),
            {m: flag("match_type", m) for m in ("TP_EXACT", "TP_RANGE")},
        )
        .unionByName(
            padded(
                misses.withColumn("n", F.col("n_rows")),
                {m: flag("fn_class", v) for m, v in fn_names.items()},
            )
        )
        .unionByName(
            padded(
                classified_fp.withColumn("n", F.lit(1).cast("bigint")),
                {m: flag("fp_class", v) for v, m in fp_names.items()},
            )
        )
    )
    shape = gt_summary(gt)
    everywhere = gt.agg(
        F.count_distinct(F.when(filled(F.col("cve")), F.col("cve"))).alias("all_cves")
    )
    sums = parts.groupBy("tool", "ecosystem").agg(*[F.sum(m).alias(m) for m in measures])
    rows = for_each_tool(shape, tools).join(sums, ["tool", "ecosystem"], "left").fillna(0, measures)
    counted = ["Components", "Vulnerabilities", *measures]
    total = (
        rows.groupBy("tool")
        .agg(*[F.sum(c).alias(c) for c in counted])
        .join(for_each_tool(everywhere, tools), "tool")
        .select("tool", F.lit("TOTAL").alias("ecosystem"), *counted,
                F.col("all_cves").alias("CVEs"))
    )
    tp = F.col("TP_EXACT") + F.col("TP_RANGE")
    fp = F.col("FP_CERTAIN") + F.col("FP_LIKELY") + F.col("FP_UNCLEAR")
    fn = F.col("FN_EXACT") + F.col("FN_RANGE") + F.col("FN_TRUE")
    return (
        rows.unionByName(total)
        .withColumns({"TP": tp, "FP": fp, "FN": fn})
        .withColumns(
            {
                "Recall": ratio(F.col("TP"), F.col("Vulnerabilities")),
                "Recall_EXACT": ratio(F.col("TP_EXACT"), F.col("Vulnerabilities")),
                "Overlap": ratio(F.col("TP"), F.col("TP") + F.col("FP")),
            }
        )
    )


def gt_osv_summary(gt: DataFrame) -> DataFrame:
    """Distinct components, advisory entries and CVEs, and CVEs per entry."""
    entry = F.when(
        filled(F.col("osv_id")), F.struct("ecosystem", "component", "version", "osv_id")
    )
    counts = gt.agg(
        F.count_distinct("ecosystem", "component", "version").alias("components"),
        F.count_distinct(entry).alias("osv_entries"),
        F.count_distinct(F.when(filled(F.col("cve")), F.col("cve"))).alias("cves"),
    )
    return counts.withColumn("cves_per_entry", ratio(F.col("cves"), F.col("osv_entries")))


def heuristic_quality(outcomes: DataFrame) -> DataFrame:
    """How well a product-word mark tells extra findings from found ones.

    ``outcomes``: tool, outcome (TP or FP), fp_class (null: unmarked).
    """
    marked = filled(F.col("fp_class"))
    is_fp = F.col("outcome") == "FP"
    counts = outcomes.groupBy("tool").agg(
        F.count_if(is_fp & marked).alias("HTP"),
        F.count_if(is_fp & ~marked).alias("HFN"),
        F.count_if(~is_fp & marked).alias("HFP"),
        F.count_if(~is_fp & ~marked).alias("HTN"),
    )
    return counts.withColumns(
        {
            "heuristic_precision": ratio(F.col("HTP"), F.col("HTP") + F.col("HFP")),
            "heuristic_recall": ratio(F.col("HTP"), F.col("HTP") + F.col("HFN")),
        }
    )


# --- repeated runs ----------------------------------------------------------------
# A run table has run, tool, ecosystem and the metric columns; it is one row per run,
# tool and ecosystem, so it stays small whatever the data behind it.


def unpivot_metrics(runs: DataFrame, metrics: list[str]) -> DataFrame:
    doubles = runs.select("run", "tool", "ecosystem", *[F.col(m).cast("double") for m in metrics])
    return doubles.unpivot(["run", "tool", "ecosystem"], metrics, "metric", "value")


def run_aggregate(runs: DataFrame) -> DataFrame:
    """Mean, population deviation, number of runs and 95 % half-width per metric."""
    stats = (
        unpivot_metrics(runs, K.RUN_METRICS)
        .groupBy("tool", "ecosystem", "metric")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.count("*").alias("n"),
        )
    )
    return stats.withColumn(
        "ci95",
        F.when(F.col("n") > 1, 1.96 * F.col("std") / F.sqrt(F.col("n"))).otherwise(F.lit(0.0)),
    )


def collapse_repeats(runs: DataFrame) -> DataFrame:
    """Mean of each metric over the repeats; whole count means lose their rounding noise."""
    metrics = [*K.COUNT_METRICS, "Recall", "Overlap"]
    mean = F.avg("value")
    whole = F.bround(mean)
    count_like = F.col("metric").isin(K.COUNT_METRICS)
    return (
        unpivot_metrics(runs, metrics)
        .groupBy("tool", "ecosystem", "metric")
        .agg(mean.alias("m"), whole.alias("w"))
        .select(
            "tool", "ecosystem", "metric",
            F.when(count_like & (F.abs(F.col("m") - F.col("w")) < 1e-9), F.col("w"))
            .otherwise(F.col("m"))
            .alias("value"),
        )
    )


def _mean_metrics(runs: DataFrame) -> DataFrame:
    return runs.groupBy("tool", "ecosystem").agg(
        *[F.avg(F.col(m).cast("double")).alias(m) for m in K.RUN_METRICS]
    )


def tool_table(runs: DataFrame, summary: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Per tool and ecosystem, and TOTAL: truncated count means, mean recall and overlap."""
    means = _mean_metrics(runs).join(summary, "ecosystem", "left")
    sizes = ["Components", "Vulnerabilities", "CVEs"]
    shown = (
        means.rollup("tool", "ecosystem")
        .agg(
            *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sizes],
            *[F.floor(F.sum(c)).cast("bigint").alias(c) for c in ("TP", "FP", "FN")],
            *[F.avg(c).alias(c) for c in ("Recall", "Overlap")],
            F.grouping("ecosystem").alias("is_total"),
        )
        .where("tool is not null")
        .withColumn(
            "ecosystem", F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("ecosystem"))
        )
        .drop("is_total")
    )
    if markers is None:
        return shown
    return shown.join(markers, "tool", "left").fillna("", ["marker"])


def ecosystem_summary(runs: DataFrame, summary: DataFrame) -> DataFrame:
    """Per ecosystem, sums over tools and mean scores; TOTAL averages the ecosystem means."""
    sizes = ["Components", "Vulnerabilities"]
    per = (
        _mean_metrics(runs)
        .groupBy("ecosystem")
        .agg(
            *[F.sum(c).alias(c) for c in ("TP", "FP", "FN")],
            *[F.avg(c).alias(c) for c in ("Recall", "Overlap")],
        )
        .join(summary.select("ecosystem", *sizes), "ecosystem")
    )
    total = per.agg(
        F.lit("TOTAL").alias("ecosystem"),
        *[F.sum(c).alias(c) for c in ("TP", "FP", "FN", *sizes)],
        *[F.avg(c).alias(c) for c in ("Recall", "Overlap")],
    )
    whole = {c: F.floor(c).cast("bigint") for c in ("TP", "FP", "FN")}
    return per.unionByName(total).withColumns(whole)


def tool_summary(runs: DataFrame) -> DataFrame:
    """Per tool: mean recall and overlap over ecosystems, summed counts, recall rank."""
    totals = _mean_metrics(runs).groupBy("tool").agg(
        F.avg("Recall").alias("mean_recall"),
        F.avg("Overlap").alias("mean_overlap"),
        F.sum("TP").alias("total_tp"),
        F.sum("FP").alias("total_fp"),
        F.sum("FN").alias("total_fn"),
    )
    # One row per tool, so a single-task window is fine.
    order = Window.orderBy(F.desc("mean_recall"), "tool")
    return totals.withColumn("rank", F.row_number().over(order))


def tool_ranking(summary: DataFrame) -> DataFrame:
    """Tools by recall, then overlap, then name."""
    order = Window.orderBy(F.desc("mean_recall"), F.desc("mean_overlap"), "tool")
    return summary.withColumn("rank", F.row_number().over(order))


def tool_deltas(summary: DataFrame) -> DataFrame:
    """Differences of the summaries of each pair of tools, in name order.

    There is one row per tool, so the pairs are formed inside one array.
    """
    columns = ["mean_recall", "mean_overlap", "total_tp", "total_fp", "total_fn"]
    listed = summary.agg(F.array_sort(F.collect_list(F.struct("tool", *columns))).alias("all"))
    return ordered_pairs(listed, "all").select(
        F.col("a.tool").alias("tool_a"),
        F.col("b.tool").alias("tool_b"),
        *[(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(f"delta_{c}") for c in columns],
    )


def ordered_pairs(df: DataFrame, array: str) -> DataFrame:
    """One row (a, b) per pair of elements of a short array, the earlier first."""
    return (
        df.select("*", F.posexplode(array).alias("i", "a"))
        .select("*", F.explode(F.slice(F.col(array), F.col("i") + 2, F.size(array))).alias("b"))
        .drop("i", array)
    )


def call_stats(calls: DataFrame) -> DataFrame:
    """Calls, total and mean duration per API, and a TOTAL row."""
    return (
        calls.rollup("api")
        .agg(
            F.count("*").alias("calls"),
            F.sum("duration_ms").alias("total_ms"),
            F.avg("duration_ms").alias("avg_ms"),
            F.grouping("api").alias("g"),
        )
        .select(
            F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("api")).alias("api"),
            "calls", "total_ms", "avg_ms",
        )
    )


def comparison_payload(summary: DataFrame, deltas: DataFrame) -> DataFrame:
    """One row: the tool summaries, their ranking and all deltas as one JSON text.

    There is one entry per tool and per pair of tools.
    """
    rows = lambda df: df.agg(F.array_sort(F.collect_list(F.struct(*sorted(df.columns)))).alias("rows"))
    ranking = summary.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tool"))), lambda r: r["tool"]))
    payload = F.struct(
        rows(summary).scalar().alias("per_tool"), ranking.scalar().alias("ranking_by_avg_recall"),
        rows(deltas).scalar().alias("pairwise_deltas"),
    )
    return summary.agg(F.count("*").alias("tools")).select(F.to_json(payload).alias("payload"))


def extra_outside(findings: DataFrame, gt: DataFrame) -> DataFrame:
    """Findings per tool in ecosystems that the ground truth lacks; the metrics leave these out."""
    known = gt.select("ecosystem").distinct()
    return findings.join(known, "ecosystem", "left_anti").groupBy("tool", "ecosystem").agg(
        F.count("*").alias("findings")
    )
