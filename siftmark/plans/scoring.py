"""Score tools against a ground truth: one lazy set of tables from two inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.operators import matching, metrics, taxonomy
from siftmark.session import written
from siftmark.sources.base import source


def collect_findings(raw: dict[str, DataFrame], gt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of several tools, read by their registered sources and tagged with ``tool``, and
    the documents of each that could not be read (tool, ord, reason)."""
    read = {t: source(t).collect(df, gt) for t, df in raw.items()}
    findings, rejected = (
        [parts[i].withColumn("tool", F.lit(t)) for t, parts in read.items()] for i in (0, 1)
    )
    together = lambda x, y: x.unionByName(y, allowMissingColumns=True)
    return reduce(together, findings), reduce(together, rejected).select("tool", "ord", "reason")


def score(
    gt: DataFrame,
    findings: DataFrame,
    tools: list[str],
    aliases: DataFrame,
    silent: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Outcomes, classes and metrics of each tool. ``silent`` tools count as all zeros.

    The signature-level match is written once, as every other table reads it.
    """
    active = [t for t in tools if t not in (silent or [])]
    matched = written(matching.matched_signatures(gt, findings, ["tool"]))
    extra = taxonomy.classify_extra(matching.false_positives(findings, matched), aliases)
    misses = metrics.miss_signatures(gt, matched, active)
    summary = metrics.gt_summary(gt)
    per_ecosystem = metrics.ecosystem_metrics(gt, findings, active)
    if silent:
        per_ecosystem = per_ecosystem.unionByName(metrics.silenced_metrics(gt, silent))
    return {
        "matched": matched,
        "false_positives": extra,
        "false_negatives": matching.classify_misses(misses, findings),
        "fp_tally": taxonomy.fp_tally(extra),
        "gt_summary": summary,
        "outside": metrics.extra_outside(findings, gt),
        "metrics": per_ecosystem,
        "report": metrics.report_matrix(gt, findings, matched, extra, active),
    }
