"""Who a row is about: component names, identifiers and their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmark.functions.text import bound, filled, null_to_blank, strip


def normalize_component(ecosystem: Column, name: Column) -> Column:
    """Component name in the spelling that joins use.

    Maven accepts ``group/artifact`` for ``group:artifact``; npm is lower case;
    PyPI is lower case with ``-``; anything else is only trimmed.
    """
    eco = F.lower(strip(ecosystem))
    n = strip(null_to_blank(name))
    return (
        F.when((eco == "maven") & ~n.contains(":"), slash_to_colon(n))
        .when(eco == "npm", F.lower(n))
        .when(eco == "pypi", F.translate(F.lower(n), "_", "-"))
        .otherwise(n)
    )


def slash_to_colon(name: Column) -> Column:
    """Turn the first ``/`` into ``:``."""
    return F.regexp_replace(name, "^([^/]*)/", "$1:")


def normalize_identifier(c: Column) -> Column:
    """Upper-case CVE and GHSA ids, trim the rest, empty becomes null."""

    def spelled(v: Column) -> Column:
        up = F.upper(v)
        return F.when(up.startswith("CVE-") | up.startswith("GHSA-"), up).otherwise(v)

    return bound(strip(c), lambda v: F.when(v != "", spelled(v)))


def normalize_version(c: Column) -> Column:
    return strip(null_to_blank(c))


def preferred_id(cve: Column, osv_id: Column) -> Column:
    """The id that keys ground-truth rows: CVE, else OSV id, else empty."""
    return F.coalesce(F.nullif(cve, F.lit("")), F.nullif(osv_id, F.lit("")), F.lit(""))


def canonical_id(*ids: Column) -> Column:
    """The first filled id, for removing duplicate findings."""
    return F.coalesce(*[F.nullif(i, F.lit("")) for i in ids])


def id_set(*ids: Column) -> Column:
    """All distinct filled ids of a row."""
    return F.array_distinct(F.array_compact(F.array(*[F.nullif(i, F.lit("")) for i in ids])))


def first_with_prefix(ids: Column, prefix: str) -> Column:
    """First element that starts with ``prefix``, in array order."""
    return F.get(F.filter(ids, lambda a: a.startswith(prefix)), F.lit(0))


def stable_row_key(eco: Column, name: Column, version: Column, vuln: Column, cve: Column) -> Column:
    """Case-folded row key; the version keeps its case."""
    fold = lambda c: F.lower(strip(null_to_blank(c)))
    return F.concat_ws("|", fold(eco), fold(name), normalize_version(version), fold(vuln), fold(cve))


def component_key(name: Column, version: Column) -> Column:
    return F.concat_ws("|", F.lower(strip(null_to_blank(name))), normalize_version(version))


def has_identifier(cve: Column, ghsa: Column) -> Column:
    return filled(cve) | filled(ghsa)
