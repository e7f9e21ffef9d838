"""Package registries: the releases of each package and when they were published.

``raw``: ord, package, payload, or such documents parsed by ``base.landed`` (Maven: ``landed_xml``),
which names those that cannot be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import filled, strip
from siftmark.functions.versions import is_stable
from siftmark.sources.base import landed

PYPI = "struct<releases: map<string, string>>"
NPM = "struct<versions: map<string, string>, time: map<string, string>>"
NUGET = """struct<items: array<struct<`@id`: string, items: array<struct<
    catalogEntry: struct<version: string, published: string>>>>>>"""
NUGET_PAGE = "struct<items: array<struct<catalogEntry: struct<version: string, published: string>>>>"


def _releases(df: DataFrame, ecosystem: str) -> DataFrame:
    published = F.col("published") if "published" in df.columns else F.lit(None).cast("timestamp")
    return df.select(
        F.lit(ecosystem).alias("ecosystem"), "package", "version", published.alias("published")
    )


def pypi(raw: DataFrame) -> DataFrame:
    """Every key of ``releases``; pre-releases stay, dates are not read."""
    body = landed(raw, PYPI, "releases")
    return _releases(body.select("package", F.explode(F.map_keys("body")).alias("version")), "pypi")


def npm(raw: DataFrame) -> DataFrame:
    """Stable versions with a readable publication time."""
    body = landed(raw, NPM).select("package", F.col("body").alias("p"))
    rows = body.select("package", F.explode(F.map_keys("p.versions")).alias("version"), "p.time")
    dated = rows.withColumn("published", F.try_to_timestamp(F.try_element_at("time", F.col("version"))))
    return _releases(
        dated.where(F.col("published").isNotNull() & is_stable(F.col("version"))), "npm"
    )


def landed_xml(raw: DataFrame) -> DataFrame:
    """Metadata documents read as XML: ``body``, the texts of all ``version`` elements in document
    order, and ``reason``.

    Elements may stand at any depth; entities and CDATA are resolved, and a prefixed name is
    another name. A document that is not well-formed gives no body and a reason.
    """
    if "body" in raw.columns:
        return raw
    whole = F.from_xml("payload", "struct<_broken: string>", {"columnNameOfCorruptRecord": "_broken"})
    broken = F.col("payload").isNull() | whole["_broken"].isNotNull()
    kept = [c for c in raw.columns if c != "payload"]
    # Only a well-formed document may come to the path expression, which ends the job otherwise.
    return raw.select("*", F.explode(F.array(broken)).alias("_bad")).select(
        *kept,
        F.when(~F.col("_bad"), F.xpath("payload", F.lit("//*[name() = 'version']/text()"))).alias("body"),
        F.when(F.col("_bad"), F.lit("no XML")).alias("reason"),
    )


def maven(raw: DataFrame) -> DataFrame:
    """Stable versions of all ``version`` elements, wherever they stand."""
    rows = landed_xml(raw).select("package", F.explode("body").alias("text"))
    stripped = rows.select("package", strip(F.col("text")).alias("version")).where("version <> ''")
    return _releases(stripped.where(is_stable(F.col("version"))), "maven")


def nuget(raw: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Stable, dated catalog entries of inlined pages.

    A page that is only a link gives nothing by itself; ``pages`` (page_id, payload), if
    given, supplies the linked ones.
    """
    page = landed(raw, NUGET, "items").select("package", F.explode("body").alias("page"))
    items = page.select("package", F.explode("page.items").alias("item"))
    if pages is not None:
        linked = page.where(F.col("page.items").isNull()).select(
            "package", F.col("page.@id").alias("page_id")
        )
        fetched = pages.select(
            "page_id", F.explode(F.from_json("payload", NUGET_PAGE)["items"]).alias("item")
        )
        items = items.unionByName(linked.join(fetched, "page_id").select("package", "item"))
    rows = items.select(
        "package",
        F.col("item.catalogEntry.version").alias("version"),
        F.try_to_timestamp("item.catalogEntry.published").alias("published"),
    )
    return _releases(
        rows.where(filled(F.col("version")) & F.col("published").isNotNull() & is_stable(F.col("version"))),
        "nuget",
    )
