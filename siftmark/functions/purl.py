"""Package URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmark.functions.constants import ECOSYSTEMS
from siftmark.functions.identity import slash_to_colon
from siftmark.functions.text import bound, filled, null_to_blank, strip


def percent_decode(c: Column) -> Column:
    """Decode %XX only; a plus sign and a ``%`` without two hexadecimal digits stay."""
    whole = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(whole, F.lit("+"), F.lit("%2B"))), c)


def percent_encode(c: Column) -> Column:
    """Encode all but letters, digits, ``_.-~`` and ``/``."""
    out = F.url_encode(c)
    for found, wanted in [("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")]:
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def purl_type(purl: Column) -> Column:
    """The type between ``pkg:`` and the first ``/``, in lower case."""
    p = F.lower(strip(purl))
    rest = F.substring(p, 5, 1 << 30)
    return F.when(p.startswith("pkg:"), F.substring_index(rest, "/", 1))


def purl_ecosystem(purl: Column) -> Column:
    """The supported ecosystem whose prefix the package URL carries, else null."""

    def named(p: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, kind, _, _ in ECOSYSTEMS:
            out = F.when(p.startswith(f"pkg:{kind}/"), F.lit(name)).otherwise(out)
        return out

    return bound(F.lower(null_to_blank(purl)), named)


def purl_body(purl: Column) -> Column:
    """What follows ``pkg:<type>/``."""
    return F.regexp_replace(purl, "^[^/]*/", "")


def drop_qualifiers(version: Column) -> Column:
    """Cut ``?qualifiers`` and ``#subpath`` off a version."""
    return strip(F.substring_index(F.substring_index(version, "?", 1), "#", 1))


def build_purl(eco: Column, name: Column, version: Column) -> Column:
    """Plain package URL, unescaped: maven ``:`` becomes ``/``, PyPI names are normalised."""
    e = F.lower(eco)
    body = (
        F.when(e == "maven", F.replace(name, F.lit(":"), F.lit("/")))
        .when(e == "pypi", F.translate(F.lower(strip(name)), "_", "-"))
        .otherwise(name)
    )
    return F.concat(F.lit("pkg:"), e, F.lit("/"), body, F.lit("@"), version)


def build_coordinate(eco: Column, name: Column, version: Column) -> Column:
    """Escaped package URL, or null when a part is missing or a maven name has no group."""
    e, n, v = F.lower(strip(eco)), strip(name), strip(version)
    maven = F.when(n.contains(":"), F.regexp_replace(n, "^([^:]*):", "$1/")).when(n.contains("/"), n)
    body = F.when(e == "maven", maven).when(e.isin("nuget", "npm", "pypi"), n)
    whole = filled(eco) & filled(name) & filled(version)
    return F.when(
        whole & body.isNotNull(),
        F.concat(F.lit("pkg:"), e, F.lit("/"), percent_encode(body), F.lit("@"), percent_encode(v)),
    )


def coordinate_parts(coord: Column) -> Column:
    """(ecosystem, component, version) read back from a coordinate; null when it is not one."""

    def split(c: Column) -> Column:
        left = F.substring_index(c, "@", 1)
        return F.struct(
            c.contains("@").alias("whole"), left.contains("/").alias("named"),
            F.lower(F.substring_index(left, "/", 1)).alias("kind"),
            F.regexp_replace(left, "^[^/]*/", "").alias("rest"),
            drop_qualifiers(F.substring(c, F.length(left) + 2, F.lit(1 << 30))).alias("version"),
        )

    def read(p: Column) -> Column:
        kind, rest = p["kind"], p["rest"]
        named = p["named"] & ((kind != "maven") | rest.contains("/"))
        known = kind.isin([row[0] for row in ECOSYSTEMS])
        return F.when(
            p["whole"] & (p["version"] != "") & named & known,
            F.struct(
                kind.alias("ecosystem"),
                F.when(kind == "maven", slash_to_colon(rest)).otherwise(rest).alias("component"),
                p["version"].alias("version"),
            ),
        )

    return bound(bound(F.regexp_replace(strip(null_to_blank(coord)), "^pkg:", ""), split), read)
