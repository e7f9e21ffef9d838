"""Sources that look up the ground truth's components in advisory databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions import constants as K
from siftmark.functions import interval_sets as I
from siftmark.functions import ranges as R
from siftmark.functions import versions as V
from siftmark.functions.identity import (
    canonical_id,
    first_with_prefix,
    has_identifier,
    id_set,
    normalize_identifier,
)
from siftmark.functions.purl import build_coordinate, build_purl, coordinate_parts, percent_decode
from siftmark.functions.text import bound, filled, first_line, null_to_blank, strip
from siftmark.operators.intervals import stabbing
from siftmark.operators.matching import PACKAGE, by_package, crowded, once
from siftmark.operators.ranking import first_row_per
from siftmark.session import written
from siftmark.sources.base import (
    FindingSource,
    deduplicated,
    evaluated,
    exploded,
    finding_columns,
    landed,
    register,
    sub_ord,
)

GITHUB = """struct<data: struct<securityVulnerabilities: struct<nodes: array<struct<
    vulnerableVersionRange: string,
    advisory: struct<ghsaId: string, summary: string,
                     identifiers: array<struct<type: string, value: string>>>>>>>>"""
OSS_INDEX = """array<struct<coordinates: string, coordinate: string,
    vulnerabilities: array<struct<id: string, title: string, description: string,
        cve: string, cveId: string, cve_id: string, references: string>>>>"""
OSV = """struct<vulns: array<struct<id: string, aliases: array<string>, summary: string,
    details: string, affected: array<struct<versions: array<string>,
        ranges: array<struct<type: string, events: array<struct<
            introduced: string, fixed: string, last_affected: string>>>>>>>>>"""

GITHUB_PATH = ("data", "securityVulnerabilities", "nodes")
COORDINATE = ["ecosystem", "component", "version"]


def _spelled(column: str, position: int) -> Column:
    """The ecosystem name in another system's spelling."""
    c = F.col(column)
    out = F.lit(None).cast("string")
    for row in K.ECOSYSTEMS:
        out = F.when(c == row[position], F.lit(row[0])).otherwise(out)
    return out


# --- advisory database with ranges per package ------------------------------------


def github_advisories(raw: DataFrame) -> DataFrame:
    """Distinct (ecosystem, component, range, id) of the landed answers, first one kept.

    ``raw``: ord, github_ecosystem, package, payload.
    """
    return _first_of_each(_github_rows(raw)).drop("_id")


def _github_rows(raw: DataFrame) -> DataFrame:
    """The advisories of the landed answers, with their canonical ``_id``."""
    nodes = exploded(
        landed(raw, GITHUB, *GITHUB_PATH),
        F.col("body"),
        "n",
        "github_ecosystem",
        "package",
    )
    cve = F.get(
        F.filter(F.col("n.advisory.identifiers"), lambda i: i["type"] == "CVE"), F.lit(0)
    )["value"]
    rows = nodes.where(filled(F.col("n.advisory.ghsaId"))).select(
        "ord",
        _spelled("github_ecosystem", 3).alias("ecosystem"),
        F.col("package").alias("component"),
        normalize_identifier(cve).alias("cve"),
        normalize_identifier(F.col("n.advisory.ghsaId")).alias("ghsa"),
        F.col("n.vulnerableVersionRange").alias("affected_version_range"),
        first_line(F.col("n.advisory.summary")).alias("description"),
    )
    return rows.withColumn("_id", canonical_id(F.col("cve"), F.col("ghsa")))


def _first_of_each(rows: DataFrame) -> DataFrame:
    return first_row_per(rows, ["ecosystem", "component", "affected_version_range", "_id"], "ord")


def _is_pypi() -> Column:
    return F.coalesce(F.lower(strip(F.col("ecosystem"))) == "pypi", F.lit(False))


def _github_ranges(rows: DataFrame) -> DataFrame:
    """What each different range says of versions, compiled once: (text, pypi, rng, intervals, classes).

    ``intervals``: lane, lower and upper. ``classes``: the versions for which nothing can be
    decided, which are all without a semantic key (``none``), those with one (``keyed``), or those
    that only a PyPI specifier set cannot read (``unread``); ``text:`` and a version are the one
    version that an arbitrary equality may take.
    """
    text, is_maven, groups = (F.col(f"rng.{c}") for c in ("text", "is_maven", "groups"))
    by_specifier = (text != "") & ~is_maven & groups.isNull() & F.col("pypi")
    ranges = rows.select(F.col("affected_version_range").alias("text"), _is_pypi().alias("pypi")).distinct()
    read = ranges.select("text", "pypi", F.explode(F.array(R.semver_range(F.col("text")))).alias("rng"))
    ruled = read.select(
        "text", "pypi", "rng", by_specifier.alias("by_specifier"),
        F.explode(F.array(F.when(by_specifier, I.specifier_set(text)))).alias("set"),
    )
    lane = lambda prefix, i: F.struct(
        F.concat(F.lit(prefix), i["lane"]).alias("lane"), i["lower"].alias("lower"), i["upper"].alias("upper")
    )
    # A lower end that can be read decides for all versions below it.
    brackets = F.array(F.struct(
        F.lit(I.EVERY).alias("lane"), F.col("rng.lower").alias("lower"),
        F.coalesce("rng.upper", F.lit(V.HIGHEST)).alias("upper"),
    ))
    told = F.size("set.texts") > 0
    intervals = (
        F.when(is_maven, brackets).when(groups.isNotNull(), I.npm_set(groups))
        .when(~told, F.transform(I.disjoint(F.col("set.intervals")), lambda i: lane("pep", i)))
    )
    open_range = (
        (text == "") | (is_maven & F.col("rng.lower").isNull())
        | (~is_maven & groups.isNull() & (~F.col("by_specifier") | F.col("set").isNull()))
    )
    classes = F.array_compact(F.array(
        F.lit("none"),
        F.when(open_range, "keyed"),
        F.when(F.col("by_specifier") & F.col("set").isNotNull(), "unread"),
        F.when(told, F.concat(F.lit("text:"), F.get("set.texts", 0))),
    ))
    none = F.array().cast(I.INTERVALS)
    kept = F.filter(F.when(~open_range, intervals).cast(I.INTERVALS), lambda i: i["lower"] < i["upper"])
    return ruled.select("text", "pypi", "rng", F.coalesce(kept, none).alias("intervals"), classes.alias("classes"))


def _ruled(advisories: DataFrame, ranges: DataFrame) -> DataFrame:
    """Advisories, with what ``_github_ranges`` says of their range."""
    named = ranges.withColumnsRenamed({"text": "_text", "pypi": "_pypi"})
    same = F.col("affected_version_range").eqNullSafe(F.col("_text")) & (_is_pypi() == F.col("_pypi"))
    return advisories.join(named, same).drop("_text", "_pypi")


def _github_places() -> tuple[Column, Column]:
    """The places of a version in the lanes of intervals, and the classes that it belongs to."""
    place = lambda lane, at: F.struct(lane.alias("lane"), at.alias("position"))
    none = F.array().cast("array<struct<lane:string,position:string>>")
    on_semver = F.transform(I.semver_lanes(F.col("semver")), lambda x: place(x, V.point(F.col("semver"))))
    on_pep = F.when(
        F.col("is_pypi") & F.col("pep").isNotNull(),
        F.array(place(F.concat(F.lit("pep"), I.specifier_lane(F.col("pep"))), V.point(F.col("pep")))),
    ).otherwise(none)
    unread = F.col("is_pypi") & F.col("pep").isNull()
    of = F.when(F.col("semver").isNull(), F.array(F.lit("none"))).otherwise(F.array_compact(F.array(
        F.lit("keyed"), F.when(unread, "unread"),
        F.when(F.col("is_pypi"), F.concat(F.lit("text:"), F.lower(F.trim("version")))),
    )))
    return F.when(F.col("semver").isNotNull(), F.concat(on_semver, on_pep)).otherwise(none), of


def github(raw: DataFrame, gt: DataFrame) -> DataFrame:
    """Advisories of each ground-truth component that do not exclude its version.

    A version out of range drops; a missing range or one that cannot be decided stays. Packages of
    few rows are dealt out whole, and their versions meet their advisories in one task. Others
    (``matching.crowded``) go through an index of all intervals.
    """
    rows = written(_github_rows(raw))
    ranges = written(_github_ranges(rows))
    versions = gt.select("version").distinct().select(
        "version",
        F.explode(F.array(F.struct(
            R.semver_key(F.col("version")).alias("semver"), V.version_key(F.col("version")).alias("pep")
        ))).alias("k"),
    )
    wanted = written(
        gt.select(*COORDINATE).distinct().join(versions.select("version", "k.*"), "version")
        .withColumn("is_pypi", F.lower(strip(F.col("ecosystem"))) == "pypi")
    )
    crowd = crowded(wanted, rows)
    found = _github_by_pairs(by_package(rows, crowd), by_package(wanted, crowd), ranges)
    if not crowd.isEmpty():
        found = found.unionByName(
            _github_by_axis(rows.join(crowd, PACKAGE), wanted.join(crowd, PACKAGE), ranges).select(*found.columns)
        )
    return finding_columns(found, "github-advisory-db")


def _github_by_pairs(rows: DataFrame, wanted: DataFrame, ranges: DataFrame) -> DataFrame:
    """``github`` of packages dealt out whole; nothing is shuffled, and no pair is sorted.

    Advisories of one id are listed in order, so that a version takes the first that keeps it.
    """
    shown = ["cve", "ghsa", "affected_version_range", "description"]
    ruled = _ruled(_first_of_each(rows), ranges).where("ord is not null")
    listed = ruled.groupBy(*PACKAGE, "_id").agg(F.array_sort(F.collect_list(
        F.struct("ord", *shown, "rng", "intervals", "classes"))).alias("listed"))
    places, of = _github_places()
    placed = wanted.select(*COORDINATE, "semver", places.alias("places"), of.alias("of"))
    inside = lambda p, i: (i["lane"] == p["lane"]) & (i["lower"] < p["position"]) & (p["position"] < i["upper"])

    def keeps(a: Column) -> Column:
        verdict = R.semver_verdict(F.col("ecosystem"), F.col("version"), F.col("semver"), a["rng"])
        undecided = F.exists(a["classes"], lambda c: F.array_contains("of", c) & (
            ~c.startswith("text:") | (verdict != R.OUT_OF_RANGE)))
        return F.exists("places", lambda p: F.exists(a["intervals"], lambda i: inside(p, i))) | undecided

    first = F.slice(F.filter("listed", keeps), 1, 1)
    met = placed.join(listed, PACKAGE).select(*COORDINATE, F.explode(first).alias("a"))
    return met.select("a.ord", *COORDINATE, *[f"a.{c}" for c in shown])


def _github_by_axis(rows: DataFrame, wanted: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same without pairs that are dropped again, of packages that may be too large for a task.

    Versions meet the intervals that hold them (``intervals.stabbing``) and the advisories that
    cannot be decided for their class; only the versions that an arbitrary equality names are
    looked at once more.
    """
    advisories = written(_first_of_each(rows))
    key = ["ecosystem", "component"]
    ruled = _ruled(advisories, ranges).withColumnRenamed("ord", "adv")
    intervals = ruled.select(*key, "adv", "_id", F.inline("intervals"))
    classes = ruled.select(*key, "adv", "_id", "rng", F.explode("classes").alias("class"))
    places, of = _github_places()
    points = wanted.select(*COORDINATE, F.inline(places))
    held = stabbing(points, intervals, [*key, "lane"], "version", ["adv", "_id"]).drop("lane")
    met = wanted.select(*COORDINATE, "semver", F.explode(of).alias("class")).join(classes, [*key, "class"])
    verdict = R.semver_verdict(F.col("ecosystem"), F.col("version"), F.col("semver"), F.col("rng"))
    undecided = met.where(~F.col("class").startswith("text:") | (verdict != R.OUT_OF_RANGE))
    pairs = held.unionByName(undecided.select(*held.columns))
    first = pairs.groupBy(*COORDINATE, "_id").agg(F.min("adv").alias("ord"))
    return first.drop("_id").join(advisories.drop(*key, "_id"), "ord")


# --- component reports by coordinate ----------------------------------------------


def coordinates(gt: DataFrame) -> DataFrame:
    """Distinct coordinates to ask for: the stored purl, else one built; first key wins."""
    stored = F.nullif(strip(F.col("purl")), F.lit(""))
    built = build_coordinate(F.col("ecosystem"), F.col("component"), F.col("version"))
    rows = evaluated(gt, "ord", *COORDINATE, F.coalesce(stored, built).alias("coordinate"))
    return first_row_per(rows.where("coordinate is not null"), ["coordinate"], "ord").drop("ord")


def _token(text: Column, prefix: str) -> Column:
    """The first word of letters, digits and ``-`` that starts at ``prefix``."""
    return F.nullif(F.regexp_extract(text, prefix + r"[\p{L}\p{N}-]*", 0), F.lit(""))


def oss_index(raw: DataFrame, gt: DataFrame) -> DataFrame:
    """Vulnerabilities of component reports, under the key their coordinate was asked for.

    An unknown coordinate is read as a package URL. The CVE comes from a field, else the
    references, else the text; the GHSA id from the references, else the text.
    """
    reports = exploded(landed(raw, OSS_INDEX), F.col("body"), "r")
    coordinate = strip(
        F.coalesce(F.nullif(F.col("r.coordinates"), F.lit("")), null_to_blank(F.col("r.coordinate")))
    )
    asked = coordinates(gt).withColumn("asked", F.struct(*COORDINATE)).select("coordinate", "asked")
    reports = evaluated(reports, "ord", coordinate.alias("coordinate"), F.col("r.vulnerabilities").alias("listed"))
    key = F.coalesce("asked", coordinate_parts(F.col("coordinate"))).alias("key")
    located = evaluated(reports.join(asked, "coordinate", "left"), "ord", "listed", key).where("key is not null")
    rows = located.select("ord", "key", F.posexplode("listed").alias("pos", "v"))
    texts = [strip(null_to_blank(F.col(f"v.{c}"))).alias(c) for c in ("id", "title", "description")]
    rows = evaluated(rows, sub_ord(F.col("pos")).alias("ord"), "key", "v", *texts)
    vid, title, text = F.col("id"), F.col("title"), F.col("description")
    free = F.concat_ws(" ", vid, title, text)
    refs = F.col("v.references")
    named = lambda c: F.when(F.upper(F.col(f"v.{c}")).startswith("CVE-"), F.col(f"v.{c}"))
    cve = F.coalesce(
        named("cve"), named("cveId"), named("cve_id"), _token(refs, "CVE-"), _token(free, "CVE-")
    )
    ghsa = F.coalesce(_token(refs, "GHSA-"), _token(free, "GHSA-"))
    line = first_line(F.coalesce(F.nullif(title, F.lit("")), text))
    found = evaluated(
        rows,
        "ord",
        *[F.col(f"key.{c}").alias(c) for c in COORDINATE],
        normalize_identifier(cve).alias("cve"),
        normalize_identifier(ghsa).alias("ghsa"),
        F.when(vid != "", strip(F.concat(F.lit("[OSSINDEX:"), vid, F.lit("] "), line)))
        .otherwise(line)
        .alias("description"),
    ).where(has_identifier(F.col("cve"), F.col("ghsa")))
    return deduplicated(finding_columns(found, "ossindex"))


# --- confirmation against the advisory database -----------------------------------


def osv_package(ecosystem: Column, component: Column, purl: Column) -> Column:
    """The package name in the database: from the purl for maven, npm and nuget.

    The version is cut at the last ``@``, so scoped npm names keep their scope.
    """
    body = percent_decode(F.regexp_extract(purl, r"pkg:[^/]*/(?s:(.*))$", 1))
    has_type = purl.contains(F.concat(F.lit("pkg:"), ecosystem, F.lit("/")))
    name = F.regexp_replace(body, "@[^@]*$", "")
    maven = F.when(
        has_type & body.contains("/"),
        F.concat(
            F.substring_index(body, "/", 1),
            F.lit(":"),
            F.substring_index(F.regexp_replace(body, "^[^/]*/", ""), "@", 1),
        ),
    )
    return (
        F.when((ecosystem == "maven") & filled(purl), maven)
        .when(ecosystem.isin("npm", "nuget") & filled(purl), F.when(has_type, name))
        .otherwise(F.nullif(component, F.lit("")))
    )


def osv_advisories(raw: DataFrame) -> DataFrame:
    """Advisories of the landed answers. ``raw``: ord, osv_ecosystem, package, payload."""
    return exploded(
        landed(raw, OSV, "vulns"), F.col("body"), "v", "osv_ecosystem", "package"
    ).select(
        F.col("ord").alias("adv_ord"),
        F.coalesce(_spelled("osv_ecosystem", 2), F.col("osv_ecosystem")).alias("ecosystem"),
        "package",
        "v.*",
    )


def _osv_read(raw: DataFrame) -> DataFrame:
    """What the lookup needs of each advisory: all its ids, listed versions, ranges, what it says.

    ``component`` is the package. A listed version has its ``entry`` in the advisory, and a range
    its entry, its number ``at`` in it and its specifier set ``spec``.
    """
    parts = lambda body: F.flatten(F.transform(F.coalesce("affected", F.array()), body))
    listed = parts(lambda a, entry: F.coalesce(F.transform(a["versions"], lambda v: F.struct(
        entry.alias("entry"), v.alias("version"))), F.array()))
    ranges = parts(lambda a, entry: F.coalesce(F.transform(a["ranges"], lambda r, at: F.struct(
        entry.alias("entry"), at.alias("at"), R.events_to_specifier(r["events"]).alias("spec"))), F.array()))
    named = F.array_distinct(F.array_append(F.coalesce("aliases", F.array()), F.col("id")))
    return evaluated(
        osv_advisories(raw),
        "ecosystem",
        F.col("package").alias("component"),
        "adv_ord",
        F.filter(named, filled).alias("any_ids"),
        listed.alias("listed"),
        F.filter(ranges, lambda r: r["spec"].isNotNull()).alias("ranges"),
        F.col("id").alias("osv_id"),
        first_with_prefix(F.col("aliases"), "CVE-").alias("adv_cve"),
        first_with_prefix(F.col("aliases"), "GHSA-").alias("adv_ghsa"),
        F.coalesce(F.nullif(F.col("summary"), F.lit("")), null_to_blank(F.col("details"))).alias("description"),
    )


def _specifier_intervals(advisories: DataFrame) -> DataFrame:
    """(spec, set): each different specifier set compiled once. One that names a text by ``===`` holds nothing."""
    specs = advisories.select(F.explode("ranges.spec").alias("spec")).distinct()
    return specs.select("spec", F.explode(F.array(I.specifier_set(F.col("spec")))).alias("set")).where(
        "set is not null and size(set.texts) = 0"
    ).select("spec", I.disjoint(F.col("set.intervals")).alias("set"))


def _place(entry: Column, kind: int, at: Column, spec: Column) -> Column:
    """Where an advisory holds a version: (entry, 0 for a listed version and 1 for a range, range, specifier set)."""
    return F.struct(entry.alias("entry"), F.lit(kind).alias("kind"), at.alias("range"), spec.alias("spec"))


def _on_axis(version: Column) -> Column:
    """The lane and position of a version; null for one that cannot be read."""
    at = lambda k: F.struct(I.specifier_lane(k).alias("lane"), V.point(k).alias("position"))
    return bound(V.version_key(version), lambda k: F.when(k.isNotNull(), at(k)))


OSV_KEY = [*PACKAGE, "name", "version", "purl", "cve", "ghsa", "osv"]


def osv(raw: DataFrame, gt: DataFrame) -> DataFrame:
    """Ground-truth rows that an advisory sharing an id confirms, by the first such advisory.

    Rows that agree on everything the lookup reads are looked up once. Packages of few rows are
    dealt out whole, and their rows meet the package's advisories in one task; others
    (``matching.crowded``) meet them by ids. Ranges of events are compiled once to intervals.
    Ranges that name a text by ``===`` hold nothing.
    """
    rows = (
        gt.withColumns({c: null_to_blank(F.col(c)) for c in ["purl", "cve", "ghsa", "osv_id"]})
        .select(
            "ecosystem", F.col("component").alias("name"), "version", "purl", "cve", "ghsa", F.col("osv_id").alias("osv"), "ord"
        )
    )
    # Read once per row, whatever is filtered by it.
    rows = once(rows, "component", osv_package(F.col("ecosystem"), F.col("name"), F.col("purl")))
    advisories = written(_osv_read(raw))
    sets = written(_specifier_intervals(advisories))
    crowd = crowded(rows, advisories)
    found = _osv_by_pairs(by_package(rows, crowd), by_package(advisories, crowd), sets)
    if not crowd.isEmpty():
        found = found.unionByName(
            _osv_by_ids(rows.join(crowd, PACKAGE), advisories.join(crowd, PACKAGE), sets).select(*found.columns)
        )
    own = lambda c: F.nullif(F.col(c), F.lit(""))
    found = found.select(
        "ord",
        "ecosystem",
        F.col("name").alias("component"),
        "version",
        own("purl").alias("purl"),
        F.coalesce(own("cve"), F.col("adv_cve")).alias("cve"),
        F.coalesce(own("ghsa"), F.col("adv_ghsa")).alias("ghsa"),
        "osv_id",
        "description",
        F.col("m.spec").alias("affected_version_range"),
        F.when(F.col("m.kind") == 0, "EXACT").otherwise("RANGE").alias("match_type"),
    )
    return deduplicated(finding_columns(found, "osv", "match_type"))


OSV_SAYS = ["osv_id", "adv_cve", "adv_ghsa", "description"]


def _osv_asked(rows: DataFrame) -> DataFrame:
    """Rows that are looked up once, with the ids they are looked up by."""
    asked = rows.groupBy(*OSV_KEY).agg(F.min("ord").alias("ord"))
    return asked.withColumn("ids", id_set(F.col("cve"), F.col("ghsa"), F.col("osv")))


def _osv_by_pairs(rows: DataFrame, advisories: DataFrame, sets: DataFrame) -> DataFrame:
    """``osv`` of packages dealt out whole: (key, ord, what the advisory says, place ``m``)."""
    asked = _osv_asked(rows).withColumn("at", F.explode(F.array(_on_axis(F.col("version")))))
    met = asked.join(
        advisories.withColumnsRenamed({c: f"_{c}" for c in PACKAGE}),
        (F.col("component") == F.col("_component")) & (F.col("ecosystem") == F.col("_ecosystem"))
        & F.arrays_overlap("ids", "any_ids"),
    )
    same = F.filter("listed", lambda x: x["version"] == F.col("version"))
    places = F.concat(
        F.transform(same, lambda x: _place(x["entry"], 0, F.lit(0), F.lit(None).cast("string"))),
        F.transform("ranges", lambda r: _place(r["entry"], 1, r["at"], r["spec"])),
    )
    asked_of = met.select(*OSV_KEY, "ord", "adv_ord", *OSV_SAYS, "at", F.explode(places).alias("m"))
    compiled = sets.withColumnRenamed("spec", "_spec")
    at = F.col("at")
    inside = F.exists("set", lambda i: (i["lane"] == at["lane"]) & (i["lower"] < at["position"]) & (at["position"] < i["upper"]))
    held = asked_of.join(compiled, F.col("m.spec") == F.col("_spec"), "left").where((F.col("m.kind") == 0) | inside)
    return first_row_per(held.drop("at", "_spec", "set"), OSV_KEY, "adv_ord", "m").drop("adv_ord")


def _osv_by_ids(rows: DataFrame, advisories: DataFrame, sets: DataFrame) -> DataFrame:
    """The same for packages that may be too large for a task: sharing an id is an equality join.

    Ranges are a short list per advisory and lane, and a version that an advisory is asked for is
    compared with their ends.
    """
    link = advisories.select(*PACKAGE, "adv_ord", F.explode("any_ids").alias("any_id"))
    asked_ids = _osv_asked(rows).select(*OSV_KEY, "ord", F.explode("ids").alias("any_id"))
    pairs = written(asked_ids.join(link, [*PACKAGE, "any_id"]).drop("any_id").distinct())
    # Whether an advisory holds a version is asked once for each two of them.
    asked_versions = pairs.select("adv_ord", "version").distinct()
    listed = advisories.select("adv_ord", F.inline("listed")).select(
        "adv_ord", "version", _place(F.col("entry"), 0, F.lit(0), F.lit(None).cast("string")).alias("place")
    )
    intervals = advisories.select("adv_ord", F.inline("ranges")).join(sets, "spec").select(
        "adv_ord", _place(F.col("entry"), 1, F.col("at"), F.col("spec")).alias("place"), F.inline("set")
    )
    keys = asked_versions.select("version").distinct().select(
        "version", F.explode(F.array(_on_axis(F.col("version")))).alias("at")
    ).where("at is not null")
    points = asked_versions.join(keys, "version").select("adv_ord", "version", "at.*")
    lists = intervals.groupBy("adv_ord", "lane").agg(F.collect_list(F.struct("lower", "upper", "place")).alias("set"))
    at = F.col("position")
    over = F.filter("set", lambda i: (i["lower"] < at) & (at < i["upper"]))
    inside = points.join(lists, ["adv_ord", "lane"]).select(
        "adv_ord", "version", F.explode(F.array(F.array_min(F.transform(over, lambda i: i["place"])))).alias("place")
    ).where("place is not null")
    held = (
        inside.unionByName(listed.join(asked_versions, ["adv_ord", "version"]).select(*inside.columns))
        .groupBy("adv_ord", "version").agg(F.min("place").alias("m"))
    )
    chosen = first_row_per(pairs.join(held, ["adv_ord", "version"]), OSV_KEY, "adv_ord")
    return chosen.join(advisories.select("adv_ord", *OSV_SAYS), "adv_ord").drop("adv_ord")


# --- observations: which advisories hit which release -----------------------------


def observations(raw: DataFrame, limit: int) -> DataFrame:
    """Ground-truth rows from one answer per release: its first ``limit`` advisories.

    ``raw``: ord, ecosystem, package, version, payload. Advisories without an id and
    repeats of an id inside the answer drop after the cut.
    """
    first = F.slice("body", 1, limit)
    ids = F.transform(first, lambda v: v["id"])
    fresh = F.filter(
        first, lambda v, i: filled(v["id"]) & (F.array_position(ids, v["id"]) == i + 1)
    )
    rows = exploded(landed(raw, OSV, "vulns"), fresh, "v", "ecosystem", "package", "version")
    return rows.select(
        "ord",
        "ecosystem",
        F.col("package").alias("component_name"),
        F.col("version").alias("component_version"),
        build_purl(F.col("ecosystem"), F.col("package"), F.col("version")).alias("purl"),
        F.col("v.id").alias("vulnerability_id"),
        first_with_prefix(F.col("v.aliases"), "CVE-").alias("cve"),
        F.lit(True).alias("is_vulnerable"),
    )


def expand_aliases(advisories: DataFrame) -> DataFrame:
    """One row per CVE alias of an advisory, or one with null. ``advisories``: id, aliases."""
    cves = F.filter("aliases", lambda a: a.startswith("CVE-"))
    return advisories.select(F.col("id").alias("vulnerability_id"), F.explode_outer(cves).alias("cve"))


register(FindingSource("github", github, GITHUB, GITHUB_PATH))
register(FindingSource("oss-index", oss_index, OSS_INDEX))
register(FindingSource("osv", osv, OSV, ("vulns",)))
