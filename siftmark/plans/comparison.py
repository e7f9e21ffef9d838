"""Compare tools over repeats: paired tests and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.operators import drift, matching, metrics, payloads, significance
from siftmark.session import written


def compare(
    gt: DataFrame,
    repeats: list[DataFrame],
    tools: list[str],
    baseline: str,
    manifest: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Cochran's Q, corrected McNemar tests, markers and tool summaries over all repeats.

    All repeats are matched once, with the repeat among the owners, and vectors, pattern counts
    and metrics read that one written match. ``manifest`` (tool, repeat, and maybe more) lists the
    runs that took place; a tool without findings in a repeat is one that found nothing only if it
    is listed there, else the repeat is missing and this raises. Findings are counted in the pass
    that folds them for the match. Without a manifest every run counts as made.
    """
    n = len(repeats)
    runs = [(t, i) for i in range(1, n + 1) for t in tools]
    findings = reduce(
        DataFrame.unionByName, [f.withColumn("repeat", F.lit(i)) for i, f in enumerate(repeats, start=1)]
    )
    watched, counted = significance.watched_runs(findings, runs)
    matched = written(matching.matched_signatures(gt, watched, ["tool", "repeat"]))
    if manifest is not None:
        made = {(r["tool"], r["repeat"]) for r in manifest.select("tool", "repeat").distinct().collect()}
        seen = counted()
        lacking = [r for r in runs if r not in made and not seen[r]]
        if lacking:
            raise ValueError(f"no detections of {lacking}")
    detections = significance.detection_vectors(gt, matched, tools, n)
    counted = written(significance.run_patterns(gt, matched, tools, n))
    tests = significance.holm(significance.mcnemar(significance.mcnemar_counts(counted)))
    runs = written(reduce(DataFrame.unionByName, [
        metrics.ecosystem_metrics(gt, f, tools, matched.where(F.col("repeat") == i).drop("repeat"))
        .withColumn("run", F.lit(f"run_{i}"))
        for i, f in enumerate(repeats, start=1)
    ]))
    summary = metrics.tool_summary(runs)
    markers = significance.significance_markers(tests, baseline)
    q = significance.cochran_q(counted)
    aggregate, collapsed = metrics.run_aggregate(runs), metrics.collapse_repeats(runs)
    return {
        "detections": detections,
        "cochran_q": q,
        "tests": tests,
        "markers": markers,
        "runs": runs,
        "aggregate": aggregate,
        "collapsed": collapsed,
        "tool_summary": summary,
        "tool_table": metrics.tool_table(runs, metrics.gt_summary(gt), markers),
        "deltas": metrics.tool_deltas(summary),
        "payload": metrics.comparison_payload(summary, metrics.tool_deltas(summary)),
        "statistics_payload": payloads.statistics_payload(aggregate),
        "results_payload": payloads.results_payload(collapsed),
        "significance_payload": payloads.significance_payload(q, tests, tools, n, gt.count()),
        "summary_payload": payloads.summary_payload(summary, markers, baseline),
        "repeats_payload": payloads.repeats_payload(drift.repeat_stability(findings)),
    }
