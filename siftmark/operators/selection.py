"""Which releases of a package are looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.functions.versions import is_stable, version_key
from siftmark.operators.ranking import row_number_within

PACKAGE = ["ecosystem", "package"]


def within_window(published: Column, start: Column, end: Column) -> Column:
    """Closed window, open on the side of a null bound; a null date is outside."""
    return (
        published.isNotNull()
        & (start.isNull() | F.coalesce(published >= start, F.lit(False)))
        & (end.isNull() | F.coalesce(published <= end, F.lit(False)))
    )


def day(text: str | None) -> Column:
    """A ``YYYY-MM-DD`` bound as a UTC timestamp, or null."""
    return F.to_timestamp(F.lit(text).cast("string"), "yyyy-MM-dd")


def stable_only(releases: DataFrame) -> DataFrame:
    return releases.where(is_stable(F.col("version")))


def last_by_text(releases: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` versions of each package in plain text order."""
    return _ranked(releases, F.desc("version")).where(F.col("rank") <= limit)


def oldest(releases: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` lowest stable versions of each package."""
    keyed = stable_only(releases).withColumn("key", version_key(F.col("version")))
    return _ranked(keyed, F.col("key"), F.col("version")).where(F.col("rank") <= limit).drop("key")


def evenly(releases: DataFrame, limit: int | None) -> DataFrame:
    """``limit`` stable versions of each package spread evenly over newest to oldest.

    Place k of the sample is position k·(n−1)/(limit−1) rounded half to even; a limit of one
    takes the last. A version is kept if some place falls on its position, so each row
    decides alone once its rank and its package's size are known.
    """
    keyed = stable_only(releases).withColumn("key", version_key(F.col("version")))
    sizes = keyed.groupBy(*PACKAGE).agg(F.count("*").alias("n"))
    ranked = row_number_within(keyed.join(sizes, PACKAGE), PACKAGE, [F.desc("key"), F.col("version")], "rank")
    return ranked.where(sampled(F.col("rank") - 1, F.col("n"), limit)).drop("key", "n")


def sampled(index: Column, n: Column, limit: int | None) -> Column:
    """Whether position ``index`` of ``n`` belongs to an even sample of ``limit``."""
    if limit is None or limit <= 0:
        return F.lit(True)
    if limit == 1:
        return (n <= 1) | (index == n - 1)
    place = lambda k: F.bround(k.cast("double") * (n - 1) / (limit - 1))
    hit = F.exists(F.sequence(F.lit(0), F.lit(limit - 1)), lambda k: place(k) == index)
    return (n <= limit) | hit


def _ranked(releases: DataFrame, *order: Column) -> DataFrame:
    return releases.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*PACKAGE).orderBy(*order))
    )


def select_versions(
    releases: DataFrame,
    limits: dict[str, int],
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Releases kept under each ecosystem's own rule.

    pypi: last by text, no window, pre-releases stay. npm: oldest, then the window.
    maven: oldest, no window. nuget: the window, then an even sample.
    ``releases``: ecosystem, package, version, published, one row per version.
    """
    inside = within_window(F.col("published"), day(start), day(end))
    of = lambda eco: releases.where(F.col("ecosystem") == eco)
    return (
        last_by_text(of("pypi"), limits["pypi"])
        .unionByName(oldest(of("npm"), limits["npm"]).where(inside))
        .unionByName(oldest(of("maven"), limits["maven"]))
        .unionByName(evenly(of("nuget").where(inside), limits["nuget"]))
        .drop("rank")
    )
