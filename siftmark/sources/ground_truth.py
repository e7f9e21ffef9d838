"""Ground-truth files and archived run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions.identity import normalize_component, normalize_identifier, normalize_version
from siftmark.functions.text import blank_to_null, null_to_blank, strip
from siftmark.sources.base import landed_place

GROUND_TRUTH = (
    "ecosystem string, component_name string, component_version string, purl string, "
    "vulnerability_id string, cve string, vulnerability_description string, is_vulnerable string"
)
RUN_RESULTS = """map<string, map<string, struct<
    Components: bigint, Vulnerabilities: bigint, CVEs: bigint,
    TP: double, FP: double, FN: double, Recall: double, Overlap: double>>>"""
RESULT_NAMES = ["experimental_results.json", "results.json"]


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a ground-truth CSV with ``ord``; columns are found by name.

    ``ord`` is the row's place: files are not split here, so it follows the file.
    """
    df = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    names = [field.split()[0] for field in GROUND_TRUTH.split(", ")]
    return df.select(
        *[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names],
        landed_place().alias("ord"),
    )


def ground_truth(rows: DataFrame) -> DataFrame:
    """Observations in the findings schema from the written columns.

    Maven and NuGet names stay as written, others are normalised; blank ids become null.
    """
    eco = F.lower(strip(null_to_blank(F.col("ecosystem"))))
    name = strip(null_to_blank(F.col("component_name")))
    text = (
        F.col("vulnerability_description")
        if "vulnerability_description" in rows.columns
        else F.lit("")
    )
    return rows.select(
        "ord",
        eco.alias("ecosystem"),
        F.when(eco.isin("maven", "nuget"), name)
        .otherwise(normalize_component(eco, name))
        .alias("component"),
        normalize_version(F.col("component_version")).alias("version"),
        blank_to_null(F.col("purl")).alias("purl"),
        normalize_identifier(F.col("cve")).alias("cve"),
        F.lit(None).cast("string").alias("ghsa"),
        normalize_identifier(F.col("vulnerability_id")).alias("osv_id"),
        null_to_blank(text).alias("description"),
        F.lit("ground-truth").alias("source"),
    )


def run_results(raw: DataFrame) -> DataFrame:
    """One row per run, tool and ecosystem. ``raw``: run, payload; empty payloads drop."""
    tools = raw.where(strip(F.col("payload")) != "").select(
        "run", F.explode(F.from_json("payload", RUN_RESULTS)).alias("tool", "ecosystems")
    )
    return tools.select("run", "tool", F.explode("ecosystems").alias("ecosystem", "m")).select(
        "run", "tool", "ecosystem", "m.*"
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Results of all ``run_*`` folders under ``path``; fails when there are none."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file")
    )
    name = F.substring_index("file", "/", -1)
    raw = files.where(name.isin(RESULT_NAMES)).select(
        F.regexp_extract("file", "/(run_[^/]*)/", 1).alias("run"), "payload"
    ).where("run <> ''")
    rows = run_results(raw)
    if rows.limit(1).count() == 0:
        raise ValueError(f"no run results under {path}")
    return rows
