"""What every finding source shares: the raw table, the findings columns, the registry.

A raw table has ``payload`` (one JSON or XML document as text) and ``ord`` (a unique,
sortable text for its place in the input). A source turns it into findings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions.identity import canonical_id
from siftmark.operators.ranking import first_row_per
from siftmark.session import written

FINDING_COLUMNS = [
    "ord", "ecosystem", "component", "version", "purl", "cve", "ghsa", "osv_id",
    "description", "source", "affected_version_range",
]


@dataclass(frozen=True)
class FindingSource:
    """One scanner: how to read its raw documents.

    ``read(rows, gt)`` turns raw documents, or documents that ``landed`` has parsed, into
    findings; sources that do not look at the ground truth ignore ``gt``. ``schema``, ``path``
    and ``required`` say how documents are parsed. A source with ``security_findings`` off is
    scored as all zeros.
    """

    name: str
    read: Callable[[DataFrame, DataFrame | None], DataFrame]
    schema: str
    path: tuple[str, ...] = ()
    required: bool = False
    security_findings: bool = True

    def collect(self, raw: DataFrame, gt: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Findings, and the documents that could not be read (ord, reason), from one written parse."""
        rows = written(landed(raw, self.schema, *self.path, required=self.required))
        return self.read(rows.where("reason is null"), gt), rejects(rows)


_SOURCES: dict[str, FindingSource] = {}


def register(source: FindingSource) -> FindingSource:
    _SOURCES[source.name] = source
    return source


def source(name: str) -> FindingSource:
    if name not in _SOURCES:
        raise ValueError(f"unsupported tool: {name}")
    return _SOURCES[name]


def source_names() -> list[str]:
    return sorted(_SOURCES)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed documents, one per file, as a raw table in path order."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("value").alias("payload"), F.col("_metadata.file_path").alias("ord")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines, in the order of files and lines."""
    return spark.read.text(path).select(F.col("value").alias("payload"), landed_place().alias("ord"))


def landed_place() -> Column:
    """The unique, sortable place of a row read from files: file, block, and number in the task.

    One task reads the rows of a block, in order, so the numbers that it gives rise along the
    block, and a task that is run again gives the same ones.
    """
    digits = lambda c: F.lpad(c.cast("string"), 20, "0")
    return F.concat_ws(
        "|",
        F.col("_metadata.file_path"),
        digits(F.col("_metadata.file_block_start")),
        digits(F.monotonically_increasing_id()),
    )


def landed(raw: DataFrame, schema: str, *path: str, required: bool = False) -> DataFrame:
    """Raw documents parsed once: ``body``, the part that ``path`` leads to, and ``reason``.

    ``reason`` is null for a document that can be read. A text that is no JSON, or whose part is
    of another kind, is none; without such a part it is one only if that is ``required``, since
    a report without it would otherwise look like one without findings. What a document has
    besides ``payload`` stays. Parsed rows come back as they are.
    """
    if "body" in raw.columns:
        return raw
    body = F.col("_parsed")
    for name in path:
        body = body[name]
    # Only looked at for documents without a body.
    tree = F.try_parse_json("payload")
    there = F.try_variant_get(tree, "$" + "".join(f".{name}" for name in path), "variant")
    part = ".".join(path) or "document"
    absent = there.isNull() | F.coalesce(F.is_variant_null(there), F.lit(True))
    reason = F.when(body.isNull(), (
        F.when(tree.isNull(), F.lit("no JSON"))
        .when(absent, F.lit(f"no {part}") if required else F.lit(None).cast("string"))
        .otherwise(F.lit(f"{part} is of another kind"))
    ))
    kept = [c for c in raw.columns if c != "payload"]
    parsed = raw.select("*", F.explode(F.array(F.from_json("payload", schema))).alias("_parsed"))
    return parsed.select(*kept, body.alias("body"), reason.alias("reason"))


def rejects(rows: DataFrame) -> DataFrame:
    """The documents of ``landed`` that could not be read: ord and reason."""
    return rows.where("reason is not null").select("ord", "reason")


def accepted(raw: DataFrame, schema: str, *path: str) -> DataFrame:
    """Parsed documents; the job fails at the first that cannot be read."""
    rows = landed(raw, schema, *path, required=True)
    return rows.where(
        F.when(F.col("reason").isNull(), F.lit(True)).otherwise(
            F.raise_error(F.concat_ws(": ", "ord", "reason")).cast("boolean")
        )
    )


def sub_ord(pos: Column, ord_col: str = "ord") -> Column:
    """The place of an array element inside its document."""
    return F.concat(F.col(ord_col), F.lit("|"), F.lpad(pos.cast("string"), 8, "0"))


def exploded(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per element with its own ``ord``."""
    return (
        df.select(*keep, "ord", F.posexplode(array).alias("_pos", name))
        .withColumn("ord", sub_ord(F.col("_pos")))
        .drop("_pos")
    )


def finding_columns(df: DataFrame, source_name: str, *more: str) -> DataFrame:
    """Findings in the common columns, and ``more``; what a source does not know is null."""
    have = set(df.columns)
    return df.withColumn("source", F.lit(source_name)).select(
        *[F.col(c) if c in have or c == "source" else F.lit(None).cast("string").alias(c)
          for c in FINDING_COLUMNS],
        *more,
    )


def evaluated(df: DataFrame, *columns: str | Column) -> DataFrame:
    """``select``, with every column computed once per row.

    A filter on a plain projection is pushed below it and computes what it reads a second time;
    a generator is not crossed.
    """
    return df.select(F.explode(F.array(F.struct(*columns))).alias("_row")).select("_row.*")


def deduplicated(findings: DataFrame) -> DataFrame:
    """The first finding per component version and canonical id."""
    keyed = findings.withColumn(
        "_id", canonical_id(F.col("cve"), F.col("ghsa"), F.col("osv_id"))
    )
    return first_row_per(keyed, ["ecosystem", "component", "version", "_id"], "ord").drop("_id")
