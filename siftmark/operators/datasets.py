"""Building the ground truth: canonical rows, caps, validation, counts and statistics.

Rows carry ord, ecosystem, component_name, component_version, purl, vulnerability_id,
cve (and vulnerability_description, is_vulnerable once enriched).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.functions import ranges as R
from siftmark.functions.text import blank_to_null, clean_description, filled, null_to_blank, strip
from siftmark.operators.metrics import ratio
from siftmark.operators.ranking import first_row_per, first_rows_per, row_number_within
from siftmark.session import written

COORDINATE = ["ecosystem", "component_name", "component_version"]
COMPONENT = ["ecosystem", "component_name"]


def enrich(rows: DataFrame, advisories: DataFrame) -> DataFrame:
    """Add the description of each row's advisory; advisories: id, summary, details.

    An id that is landed several times counts once, by its least texts.
    """
    once = first_row_per(advisories, ["id"], "summary", "details")
    texts = once.select(
        F.col("id").alias("vulnerability_id"),
        clean_description(F.col("summary"), F.col("details")).alias("vulnerability_description"),
    )
    return rows.join(texts, "vulnerability_id", "left").fillna("", ["vulnerability_description"])


def canonicalize(rows: DataFrame) -> DataFrame:
    """The first row per coordinate and advisory."""
    return first_row_per(rows, [*COORDINATE, "vulnerability_id"], "ord")


def cap_per_component(rows: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` rows of each component."""
    return first_rows_per(rows, COMPONENT, limit, "ord")


def cap_versions(rows: DataFrame, limit: int) -> DataFrame:
    """Rows whose version is among the last ``limit`` of the component in text order.

    Distinct versions are ranked, not rows, and the rows then join back.
    """
    versions = rows.select(*COORDINATE).distinct()
    rank = Window.partitionBy(*COMPONENT).orderBy(F.desc("component_version"))
    kept = versions.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= limit)
    return rows.join(kept.drop("r"), COORDINATE, "left_semi")


def target_prefix(rows: DataFrame, target: int) -> DataFrame:
    """The first ``target`` rows of each ecosystem in collection order."""
    return _first_of_ecosystem(rows, target)


def check_rows(rows: DataFrame, responses: DataFrame) -> DataFrame:
    """Each row with ``status``: valid, invalid (id not in its response) or missing (no response).

    ``responses``: ecosystem, component_name, component_version, vulnerability_ids.
    """
    known = (
        responses.select(*COORDINATE, F.explode("vulnerability_ids").alias("vulnerability_id"))
        .distinct()
        .withColumn("listed", F.lit(True))
    )
    answered = responses.select(*COORDINATE).distinct().withColumn("answered", F.lit(True))
    return (
        rows.join(answered, COORDINATE, "left")
        .join(known, [*COORDINATE, "vulnerability_id"], "left")
        .withColumn(
            "status",
            F.when(F.col("answered").isNull(), "missing")
            .when(F.col("listed").isNull(), "invalid")
            .otherwise("valid"),
        )
        .drop("answered", "listed")
    )


def validated(rows: DataFrame, responses: DataFrame) -> DataFrame:
    """The rows themselves; the job fails at the first row that is not valid."""
    checked = check_rows(rows, responses)
    return checked.withColumn(
        "status",
        F.when(F.col("status") == "valid", F.col("status")).otherwise(
            F.raise_error(F.concat(F.col("status"), F.lit(": "), F.concat_ws("/", *COORDINATE)))
        ),
    ).where("status = 'valid'").drop("status")


def verify_kinds(rows: DataFrame, advisories: DataFrame) -> DataFrame:
    """Number of rows per verdict against the advisories: ok, cve_mismatch, not_affected.

    ``advisories``: id, aliases, affected; of an id that is landed several times one counts.
    """
    once = first_row_per(advisories, ["id"], F.to_json(F.struct("aliases", "affected")))
    joined = rows.join(once.withColumnRenamed("id", "vulnerability_id"), "vulnerability_id", "left")
    wrong_cve = filled(F.col("cve")) & ~F.coalesce(
        F.array_contains("aliases", F.col("cve")), F.lit(False)
    )
    affected = R.is_affected(F.col("component_version"), F.col("affected"))
    kind = F.when(wrong_cve, "cve_mismatch").when(~affected, "not_affected").otherwise("ok")
    return joined.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# --- counts -----------------------------------------------------------------------


def gt_counts(rows: DataFrame) -> DataFrame:
    """Distinct coordinates, rows, and distinct coordinate-advisory entries."""
    return rows.agg(
        F.count_distinct(*COORDINATE).alias("components"),
        F.count("*").alias("vulnerability_rows"),
        F.count_distinct(F.struct(*COORDINATE, "vulnerability_id")).alias("distinct_entries"),
    )


def _folded(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "ecosystem": F.lower(strip(null_to_blank(F.col("ecosystem")))),
            "component_name": strip(null_to_blank(F.col("component_name"))),
            "component_version": strip(null_to_blank(F.col("component_version"))),
        }
    )


def ecosystem_stats(rows: DataFrame) -> DataFrame:
    """Per ecosystem: distinct component versions and rows."""
    return _folded(rows).groupBy("ecosystem").agg(
        F.count_distinct("component_name", "component_version").alias("components"),
        F.count("*").alias("vulnerabilities"),
    )


def _cve() -> Column:
    return F.when(filled(F.col("cve")), F.col("cve"))


def _per_version(rows: DataFrame) -> DataFrame:
    """Per component version its rows, distinct advisories and distinct CVEs.

    What is distinct with the version in it adds up over versions, so ecosystems and totals are
    sums of these rows. Versions or components without a name count as none.
    """
    named = F.col("component_name").isNotNull() & F.col("component_version").isNotNull()
    entries = rows.groupBy(*COORDINATE, "vulnerability_id", "cve").agg(F.count("*").alias("n"))
    counted = entries.groupBy(*COORDINATE).agg(
        F.sum("n").alias("n"), F.count_distinct("vulnerability_id").alias("v"), F.count_distinct(_cve()).alias("cve_findings")
    )
    return counted.select(
        *COORDINATE, "n", named.cast("bigint").alias("components"),
        F.when(named, F.col("v")).otherwise(0).alias("osv_vulns"), "cve_findings",
    )


def _cves(rows: DataFrame) -> DataFrame:
    """Distinct CVEs per ecosystem, and over all of them in the row ``TOTAL``.

    Each CVE has the set of its ecosystems, which sets of parts merge into.
    """
    sets = rows.where(_cve().isNotNull()).groupBy("cve").agg(F.collect_set("ecosystem").alias("e"))
    held = sets.select(F.explode(F.array_append("e", F.lit("TOTAL"))).alias("ecosystem"))
    return held.groupBy("ecosystem").agg(F.count("*").alias("cves"))


def pre_balance_stats(rows: DataFrame) -> DataFrame:
    """Per ecosystem: rows, entries, component versions, CVE findings and CVEs, all distinct."""
    sums = _per_version(rows).groupBy("ecosystem").agg(
        F.sum("n").alias("rows"), F.sum("osv_vulns").alias("osv_vuln_entries"),
        F.sum("components").alias("unique_components"), F.sum("cve_findings").alias("cve_findings"),
    )
    return sums.join(_cves(rows), "ecosystem", "left").withColumn(
        "unique_cves", F.coalesce("cves", F.lit(0).cast("bigint"))
    ).drop("cves")


def histogram_spread(histogram: DataFrame, by: str, tag: str) -> DataFrame:
    """Largest, mean, least and median value of each group, from (group, n, times) rows.

    The median is read off running sums along the values, which are as many as there are
    different ones, not as there are rows behind them.
    """
    up = Window.partitionBy(by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy(by)
    placed = histogram.withColumns({"_upto": F.sum("times").over(up), "_all": F.sum("times").over(all_of)})
    at = lambda k: F.min(F.when(F.col("_upto") >= F.floor((F.col("_all") + k) / 2), F.col("n")))
    return placed.groupBy(by).agg(
        F.max("n").alias(f"max_{tag}"),
        (F.sum(F.col("n") * F.col("times")) / F.sum("times")).alias(f"avg_{tag}"),
        F.min("n").alias(f"min_{tag}"),
        ((at(1) + at(2)) / 2).alias(f"median_{tag}"),
    )


def gt_statistics(rows: DataFrame) -> DataFrame:
    """Sixteen measures per ecosystem and a TOTAL row.

    Rows are folded to component versions, which are written; only CVEs, of which there are few,
    are counted from the rows. Frequencies become histograms of a row per different count, which
    the TOTAL row pools; means, medians and extremes read those.
    """
    per_version = written(_per_version(rows))
    per_component = per_version.groupBy(*COMPONENT).agg(F.sum("n").alias("n"))

    def spread(freq: DataFrame, tag: str) -> DataFrame:
        counted = freq.groupBy("ecosystem", "n").agg(F.count("*").alias("times"))
        pooled = counted.select(F.lit("TOTAL").alias("ecosystem"), "n", "times").unionByName(counted)
        return histogram_spread(pooled.groupBy("ecosystem", "n").agg(F.sum("times").alias("times")), "ecosystem", tag)

    sums = _named_total(
        per_version.rollup("ecosystem").agg(
            *[F.sum(c).alias(c) for c in ("components", "osv_vulns", "cve_findings")]
        )
    )
    # One row per ecosystem: every second row of the sums is the TOTAL row itself.
    whole = Window.partitionBy()
    share = lambda c: 2 * F.col(c) / F.sum(c).over(whole)
    return (
        sums.join(_cves(rows), "ecosystem", "left")
        .withColumn("cves", F.coalesce("cves", F.lit(0).cast("bigint")))
        .join(spread(per_component, "comp_freq"), "ecosystem")
        .join(spread(per_version, "compver_freq"), "ecosystem")
        .withColumns(
            {
                "comp_per_osv": ratio(F.col("components"), F.col("osv_vulns")),
                "cve_per_osv": ratio(F.col("cve_findings"), F.col("osv_vulns")),
                "vuln_share": share("osv_vulns"),
                "comp_share": share("components"),
            }
        )
    )


def _named_total(df: DataFrame) -> DataFrame:
    """Name the grand-total row of a rollup over ecosystems that are never null."""
    return df.withColumn("ecosystem", F.coalesce(F.col("ecosystem"), F.lit("TOTAL")))


def balance_validation(rows: DataFrame) -> DataFrame:
    """Per ecosystem: rows, components, versions, median and largest component, top shares."""
    lowered = rows.withColumn("ecosystem", F.lower(null_to_blank(F.col("ecosystem"))))
    per_version = lowered.groupBy(*COORDINATE).agg(F.count("*").alias("n"))
    per_component = per_version.groupBy(*COMPONENT).agg(
        F.sum("n").alias("n"), F.count("*").alias("versions")
    )
    top5 = first_rows_per(
        per_component.select("ecosystem", "component_name", "n", (-F.col("n")).alias("minus_n")),
        ["ecosystem"], 5, "minus_n", "component_name",
    ).groupBy("ecosystem").agg(F.sum("n").alias("top5"))
    sizes = per_component.groupBy("ecosystem", "n").agg(F.count("*").alias("times"))
    middle = histogram_spread(sizes, "ecosystem", "size").select("ecosystem", F.col("median_size").alias("median_per_component"))
    return (
        per_component.groupBy("ecosystem")
        .agg(
            F.sum("n").alias("rows"),
            F.count("*").alias("unique_components"),
            F.sum("versions").alias("unique_versions"),
            F.max("n").alias("max_per_component"),
        )
        .join(middle, "ecosystem")
        .join(top5, "ecosystem")
        .withColumns(
            {
                "top1_share": F.col("max_per_component") / F.col("rows"),
                "top5_share": F.col("top5") / F.col("rows"),
            }
        )
        .drop("top5")
    )


def top_gt_components(rows: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` components with most rows and their sorted versions; ties by first row.

    The versions are gathered for the ``k`` winners only.
    """
    top = (
        rows.groupBy(*COMPONENT)
        .agg(F.count("*").alias("samples"), F.min("ord").alias("seen"))
        .orderBy(F.desc("samples"), "seen")
        .limit(k)
        .drop("seen")
    )
    versions = (
        rows.select(*COORDINATE)
        .distinct()
        .join(top, COMPONENT)
        .groupBy(*COMPONENT, "samples")
        .agg(F.array_sort(F.collect_list("component_version")).alias("versions"))
    )
    return versions


def candidate_coverage(packages: DataFrame, rows: DataFrame) -> DataFrame:
    """Each tested package with its number of rows and whether it has any."""
    found = rows.groupBy(*COMPONENT).agg(F.count("*").alias("vulnerability_count"))
    return (
        packages.select(*COMPONENT)
        .distinct()
        .join(found, COMPONENT, "left")
        .fillna(0, ["vulnerability_count"])
        .withColumn("has_vulnerabilities", F.col("vulnerability_count") > 0)
    )


def universe_check(packages: DataFrame) -> DataFrame:
    """Packages listed more than once in an ecosystem; any row is an input error."""
    return (
        packages.groupBy(*COMPONENT).agg(F.count("*").alias("times")).where(F.col("times") > 1)
    )


def universe_prefix(packages: DataFrame, samples: int) -> DataFrame:
    """The first ``samples`` packages of each ecosystem's list."""
    return _first_of_ecosystem(packages, samples)


def universe_sizes(packages: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Ecosystems whose list has another size than expected; any row is an input error."""
    wanted = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])
    have = packages.groupBy("ecosystem").agg(F.count("*").alias("size"))
    return have.withColumn("expected", F.try_element_at(wanted, F.col("ecosystem"))).where("size <> expected")


def _first_of_ecosystem(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each of the few ecosystems, however large ``n`` is."""
    places = row_number_within(rows.select("ecosystem", "ord"), ["ecosystem"], "ord", "_place")
    return rows.join(places.where(F.col("_place") <= n), ["ecosystem", "ord"], "left_semi")


# --- written forms ----------------------------------------------------------------


def bom_components(rows: DataFrame) -> DataFrame:
    """Distinct component per purl as one JSON line, rows with a blank part dropped.

    The first row of a component supplies its hashes, kept for maven only.
    """
    parts = ["ecosystem", "component_name", "component_version", "purl"]
    whole = rows
    for c in parts:
        whole = whole.where(filled(F.col(c)))
    whole = first_row_per(whole, parts, "ord")
    hashed = lambda alg, c: F.when(
        filled(F.col(c)), F.struct(F.lit(alg).alias("alg"), F.col(c).alias("content"))
    )
    have = set(rows.columns)
    found = [hashed(a, c) for a, c in (("SHA-1", "hash_sha1"), ("SHA-256", "hash_sha256")) if c in have]
    hashes = F.array_compact(F.array(*found)) if found else F.lit(None).cast("array<struct<alg:string,content:string>>")
    kept = F.when((F.col("ecosystem") == "maven") & (F.size(hashes) > 0), hashes)
    return whole.select(
        *parts,
        F.to_json(
            F.struct(
                F.lit("library").alias("type"),
                F.col("purl").alias("bom-ref"),
                F.col("component_name").alias("name"),
                F.col("component_version").alias("version"),
                F.col("purl"),
                kept.alias("hashes"),
            )
        ).alias("component"),
        F.to_json(
            F.struct(
                F.col("purl").alias("ref"), F.array().cast("array<string>").alias("dependsOn")
            )
        ).alias("dependency"),
    )


def bom_envelope(rows: DataFrame, dataset_type: str, timestamp: str) -> DataFrame:
    """The one-row JSON head of a bill of materials; its components are separate lines."""
    prop = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    counts = gt_counts(rows)
    return counts.select(
        F.to_json(
            F.struct(
                F.lit("CycloneDX").alias("bomFormat"),
                F.lit("1.5").alias("specVersion"),
                F.lit(1).alias("version"),
                F.struct(
                    F.lit(timestamp).alias("timestamp"),
                    F.struct(
                        F.lit("application").alias("type"),
                        F.lit(f"{dataset_type}-ground-truth").alias("name"),
                        F.array(
                            prop("dataset.type", F.lit(dataset_type)),
                            prop("dataset.timestamp", F.lit(timestamp)),
                            prop("dataset.components", F.col("components").cast("string")),
                            prop("dataset.vulnerabilities",
                                 F.col("vulnerability_rows").cast("string")),
                        ).alias("properties"),
                    ).alias("component"),
                ).alias("metadata"),
            )
        ).alias("envelope")
    )


def gt_meta(rows: DataFrame, start_date: str | None, end_date: str | None) -> DataFrame:
    """One row: totals, and the sidecar of a dataset as a JSON text with nested window and breakdown."""
    stats = ecosystem_stats(rows)
    entry = F.struct("ecosystem", F.struct("components", "vulnerabilities").alias("counts"))
    totals = stats.agg(
        F.sum("components").alias("components_total"),
        F.sum("vulnerabilities").alias("vulnerabilities_total"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("ecosystem_breakdown"),
    )
    window = F.struct(
        F.lit(start_date).cast("string").alias("start_date"), F.lit(end_date).cast("string").alias("end_date")
    )
    # Field names, version, source and query mode of the sidecar.
    meta = F.struct(
        "components_total", "ecosystem_breakdown", F.lit("component+version").alias("osv_query_mode"),
        F.lit("1.1").alias("schema_version"), F.lit("osv").alias("source"), window.alias("time_window"),
        "vulnerabilities_total",
    )
    return totals.select("components_total", "vulnerabilities_total", F.to_json(meta).alias("meta"))


def write_ground_truth(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the eight ground-truth columns; Parquet is partitioned by ecosystem."""
    from siftmark.functions.constants import GROUND_TRUTH_COLUMNS

    out = rows.select(*GROUND_TRUTH_COLUMNS)
    if fmt == "csv":
        out.write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)
    else:
        out.write.mode("overwrite").partitionBy("ecosystem").format(fmt).save(path)


def findings_dump(findings: DataFrame) -> DataFrame:
    """Findings in ground-truth columns; a missing id is ``-``."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    return findings.select(
        "ecosystem",
        F.col("component").alias("component_name"),
        F.col("version").alias("component_version"),
        dash("osv_id").alias("vulnerability_id"),
        dash("cve").alias("cve"),
        strip(null_to_blank(F.col("description"))).alias("vulnerability_description"),
        F.lit(True).alias("is_vulnerable"),
    )


def findings_snapshot(findings: DataFrame) -> DataFrame:
    """The eight normalised columns of each finding; anything missing is ``-``."""
    columns = ["ecosystem", "component", "version", "cve", "ghsa", "osv_id",
               "affected_version_range", "source"]
    return findings.select(
        *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-")).alias(c) for c in columns]
    )
