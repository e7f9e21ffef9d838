"""Coverage of a ground truth by CPE-based CVE records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from siftmark.functions.constants import COVERAGE_BUCKETS
from siftmark.operators import coverage
from siftmark.session import written
from siftmark.sources.authority import records


def cover(gt: DataFrame, raw: DataFrame) -> dict[str, DataFrame]:
    """Bucket of each distinct observation, counts per ecosystem and completeness.

    Raises for a ground truth without rows or without ecosystems.
    """
    status = coverage.gt_checks(gt).first()["status"]
    if status != "ok":
        raise ValueError(f"ground truth is {status}")
    verdicts = written(coverage.classify(gt, records(raw)))
    counts = coverage.bucket_counts(verdicts, "bucket", COVERAGE_BUCKETS)
    precise = coverage.bucket_counts(
        verdicts, "precise_bucket", [*COVERAGE_BUCKETS[:-1], "VERSION_OUT_OF_RANGE", "COVERED"]
    )
    return {
        "verdicts": verdicts,
        "counts": counts,
        "completeness": coverage.completeness(counts, "PRODUCT_MATCHED"),
        "precise_completeness": coverage.completeness(precise, "COVERED"),
    }
