"""Build a ground truth from landed advisory answers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from siftmark.operators import balancing, datasets
from siftmark.session import written


def build(
    observed: DataFrame,
    responses: DataFrame,
    advisories: DataFrame,
    ecosystems: list[str],
    max_versions: int | None = None,
    strategy: str | None = None,
    per_component: int = 10,
    dataset_type: str = "multi",
    timestamp: str = "",
) -> dict[str, DataFrame]:
    """Describe, canonicalise, cap, validate and (if a strategy is given) balance.

    Canonical rows feed both the statistics before balancing and the final rows, and the final
    rows all other outputs, so both are written once; so is the plan of balancing.
    """
    raw = written(datasets.canonicalize(datasets.enrich(observed, advisories)))
    rows = raw if max_versions is None else datasets.cap_versions(raw, max_versions)
    rows = written(datasets.validated(rows, responses))
    out = {"before_balancing": datasets.pre_balance_stats(raw)}
    if strategy is not None:
        rows = written(datasets.cap_per_component(rows, per_component))
        plan = written(balancing.allotments(rows, ecosystems, strategy))
        out["balance_stats"] = balancing.balance_stats(rows, ecosystems, strategy, plan)
        rows = written(balancing.balance(rows, ecosystems, strategy, plan))
    return {
        **out,
        "rows": rows,
        "counts": datasets.gt_counts(rows),
        "statistics": datasets.gt_statistics(rows),
        "validation": datasets.balance_validation(rows),
        "bom": datasets.bom_components(rows),
        "bom_envelope": datasets.bom_envelope(rows, dataset_type, timestamp),
    }
