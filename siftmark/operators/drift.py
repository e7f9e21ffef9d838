"""What changed between two snapshots, and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.identity import preferred_id
from siftmark.functions.text import filled, null_to_blank

DIFF_KEY = ["ecosystem", "component", "version", "vuln_id"]


def finding_keys(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        *keep,
        *[F.col(c) for c in ("ecosystem", "component", "version")],
        preferred_id(F.col("cve"), F.col("osv_id")).alias("vuln_id"),
    )


def key_counts(gt0: DataFrame, gt1: DataFrame) -> DataFrame:
    """Per key its number of rows in both snapshots: one shuffle, combined before it."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    both = finding_keys(gt0).withColumns({"c0": one, "c1": zero}).unionByName(
        finding_keys(gt1).withColumns({"c0": zero, "c1": one})
    )
    return both.groupBy(*DIFF_KEY).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _surplus(counts: DataFrame, extra: Column) -> DataFrame:
    """Each key as many times as it has surplus rows."""
    return counts.where(extra > 0).select(
        *DIFF_KEY, F.explode(F.sequence(F.lit(1).cast("bigint"), extra)).alias("copy")
    )


def added(counts: DataFrame) -> DataFrame:
    """Rows of snapshot 1 beyond those of snapshot 0, copies kept."""
    return _surplus(counts, F.col("c1") - F.col("c0")).drop("copy")


def removed(counts: DataFrame) -> DataFrame:
    return _surplus(counts, F.col("c0") - F.col("c1")).drop("copy")


def jaccard(counts: DataFrame) -> DataFrame:
    """Shared and united distinct keys and their quotient (1 when both are empty)."""
    sums = counts.agg(
        F.count_if((F.col("c0") > 0) & (F.col("c1") > 0)).alias("shared"),
        F.count("*").alias("united"),
    )
    return sums.withColumn(
        "jaccard", F.when(F.col("united") == 0, 1.0).otherwise(F.col("shared") / F.col("united"))
    )


def diff_summary(counts: DataFrame) -> DataFrame:
    """One row: totals, distinct keys, shared, added, removed, net, Jaccard, equality."""
    c0, c1 = F.col("c0"), F.col("c1")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = counts.agg(
        total(c0).alias("gt0_total_rows"),
        total(c1).alias("gt1_total_rows"),
        F.count_if(c0 > 0).alias("gt0_unique"),
        F.count_if(c1 > 0).alias("gt1_unique"),
        F.count_if((c0 > 0) & (c1 > 0)).alias("shared_unique"),
        total(F.greatest(c1 - c0, F.lit(0))).alias("added_rows"),
        total(F.greatest(c0 - c1, F.lit(0))).alias("removed_rows"),
        (F.count_if(c0 != c1) == 0).alias("equal"),
        F.count("*").alias("united"),
    )
    return sums.withColumns(
        {
            "net_row_delta": F.col("gt1_total_rows") - F.col("gt0_total_rows"),
            "jaccard": F.when(F.col("united") == 0, 1.0).otherwise(
                F.col("shared_unique") / F.col("united")
            ),
        }
    ).drop("united")


def diff_by_ecosystem(counts: DataFrame) -> DataFrame:
    """Per side (added, removed) and ecosystem: rows, component versions, filled ids."""
    sides = counts.select(
        *DIFF_KEY,
        F.inline(
            F.array(
                F.struct(F.lit("added").alias("side"), (F.col("c1") - F.col("c0")).alias("n")),
                F.struct(F.lit("removed").alias("side"), (F.col("c0") - F.col("c1")).alias("n")),
            )
        ),
    ).where("n > 0")
    return sides.groupBy("side", "ecosystem").agg(
        F.sum("n").alias("rows"),
        F.count_distinct("component", "version").alias("unique_components"),
        F.count_distinct(F.when(filled(F.col("vuln_id")), F.col("vuln_id"))).alias("unique_vuln_ids"),
    )


def diff_examples(gt0: DataFrame, gt1: DataFrame, k: int = 25) -> DataFrame:
    """The first ``k`` added rows, keys in order of first appearance in snapshot 1.

    A key fills as many places as it has surplus rows, so ``k`` keys always suffice.
    """
    keyed = finding_keys(gt1, "ord")
    old = finding_keys(gt0).groupBy(*DIFF_KEY).agg(F.count("*").alias("c0"))
    new = keyed.groupBy(*DIFF_KEY).agg(F.count("*").alias("c1"), F.min("ord").alias("seen"))
    surplus = F.col("c1") - F.coalesce(F.col("c0"), F.lit(0))
    top = (
        new.join(old, DIFF_KEY, "left").withColumn("n", surplus).where("n > 0")
        .orderBy("seen").limit(k)
    )
    return (
        top.select(*DIFF_KEY, "seen", F.explode(
            F.sequence(F.lit(1).cast("bigint"), F.least(F.col("n"), F.lit(k)))).alias("copy"))
        .orderBy("seen", "copy")
        .limit(k)
        .drop("seen")
    )


# --- fingerprints -----------------------------------------------------------------

_CHUNKS = 8


def _row_digest(df: DataFrame) -> Column:
    columns = ["ecosystem", "component", "version"]
    text = F.to_json(F.array(*[null_to_blank(F.col(c)) for c in columns],
                             preferred_id(F.col("cve"), F.col("osv_id"))))
    return F.sha2(text, 256)


def fingerprint(df: DataFrame, by: list[str]) -> DataFrame:
    """Order-free content hash per group that keeps copies apart.

    Each row's SHA-256 is cut into eight numbers that are summed per group, and the sums
    and the row count are hashed. Sums combine on every node, so no group is ever sorted
    or held in one place. Equal bags have equal hashes.
    """
    digest = df.select(*by, _row_digest(df).alias("d"))
    chunk = lambda i: F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("bigint")
    # A task's chunks of 32 bits add up in 64; only its few sums are added as decimals.
    parts = digest.groupBy(*by, F.spark_partition_id().alias("_part")).agg(
        F.count("*").alias("n_rows"), *[F.sum(chunk(i)).alias(f"s{i}") for i in range(_CHUNKS)]
    )
    sums = parts.groupBy(*by).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0).cast("bigint")).alias("n_rows"),
        *[F.sum(F.col(f"s{i}").cast("decimal(20,0)")).alias(f"s{i}") for i in range(_CHUNKS)],
    )
    joined = F.concat_ws("|", F.col("n_rows").cast("string"),
                         *[F.col(f"s{i}").cast("string") for i in range(_CHUNKS)])
    return sums.select(*by, "n_rows", F.sha2(joined, 256).alias("fingerprint"))


def repeat_stability(findings: DataFrame) -> DataFrame:
    """Per tool: whether all repeats hold the same findings, and their fingerprints in order."""
    hashed = fingerprint(findings, ["tool", "repeat"])
    return hashed.groupBy("tool").agg(
        (F.count_distinct("fingerprint") == 1).alias("stable"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("repeat", "fingerprint"))),
                lambda s: s["fingerprint"],
            ),
            ",",
        ).alias("fingerprints"),
    )
