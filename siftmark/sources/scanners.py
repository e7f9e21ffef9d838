"""Scanners whose reports name the component they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.identity import (
    first_with_prefix,
    has_identifier,
    normalize_component,
    normalize_identifier,
    normalize_version,
    slash_to_colon,
)
from siftmark.functions.purl import drop_qualifiers, percent_decode, purl_body, purl_ecosystem
from siftmark.functions.text import filled, first_line, null_to_blank, strip
from siftmark.sources.base import FindingSource, deduplicated, evaluated, exploded, finding_columns, landed, register

DTRACK = """array<struct<
    component: struct<purl: string>,
    vulnerability: struct<vulnId: string, description: string,
                          vulnerableVersions: string, affectedVersionRange: string>>>"""
SNYK = """struct<vulnerabilities: array<struct<
    packageName: string, name: string, version: string, packageUrl: string, title: string,
    identifiers: struct<CVE: array<string>, GHSA: array<string>>,
    semver: struct<vulnerable: array<string>>>>>"""
TRIVY = """struct<Results: array<struct<Vulnerabilities: array<struct<
    PkgName: string, InstalledVersion: string, PkgIdentifier: struct<PURL: string>,
    VulnerabilityID: string, References: array<string>, FixedVersion: string,
    Title: string>>>>>"""


def dtrack(raw: DataFrame, gt: DataFrame | None = None) -> DataFrame:
    """Findings of a dependency-tracking project.

    The component is read from the package URL, which must name a supported ecosystem and
    a version; the id must be a CVE or GHSA.
    """
    rows = exploded(landed(raw, DTRACK), F.col("body"), "f")
    purl = strip(F.col("f.component.purl"))
    body = purl_body(purl)
    name = strip(percent_decode(F.substring_index(body, "@", 1)))
    version = drop_qualifiers(
        strip(percent_decode(F.regexp_replace(body, "^[^@]*@", "")))
    )
    vuln_id = normalize_identifier(F.col("f.vulnerability.vulnId"))
    eco = F.col("ecosystem")
    known = (
        evaluated(
            evaluated(rows, "ord", "f", purl_ecosystem(purl).alias("ecosystem"))
            .where(eco.isNotNull() & body.contains("@")),
            "ord",
            "ecosystem",
            normalize_component(
                eco, F.when(eco == "maven", slash_to_colon(name)).otherwise(name)
            ).alias("component"),
            normalize_version(version).alias("version"),
            F.when(vuln_id.startswith("CVE-"), vuln_id).alias("cve"),
            F.when(vuln_id.startswith("GHSA-"), vuln_id).alias("ghsa"),
            F.coalesce(
                F.nullif(F.col("f.vulnerability.vulnerableVersions"), F.lit("")),
                F.col("f.vulnerability.affectedVersionRange"),
            ).alias("affected_version_range"),
            first_line(F.col("f.vulnerability.description")).alias("description"),
        )
        .where(has_identifier(F.col("cve"), F.col("ghsa")))
    )
    return deduplicated(finding_columns(known, "dependency-track"))


def snyk(raw: DataFrame, gt: DataFrame | None = None) -> DataFrame:
    """Findings of a test report; several ranges are joined with commas."""
    rows = exploded(landed(raw, SNYK, "vulnerabilities"), F.col("body"), "v")
    name = F.coalesce(F.nullif(F.col("v.packageName"), F.lit("")), F.col("v.name"))
    ranges = F.col("v.semver.vulnerable")
    eco = F.col("ecosystem")
    known = (
        evaluated(
            evaluated(rows, "ord", "v", purl_ecosystem(F.col("v.packageUrl")).alias("ecosystem"))
            .where(eco.isNotNull() & filled(name) & filled(F.col("v.version"))),
            "ord",
            "ecosystem",
            F.when(eco == "maven", slash_to_colon(name)).otherwise(name).alias("component"),
            F.col("v.version").alias("version"),
            normalize_identifier(first_with_prefix(F.col("v.identifiers.CVE"), "CVE-")).alias("cve"),
            normalize_identifier(first_with_prefix(F.col("v.identifiers.GHSA"), "GHSA-")).alias(
                "ghsa"
            ),
            F.when(F.size(ranges) > 0, F.array_join(ranges, ",")).alias("affected_version_range"),
            first_line(F.col("v.title")).alias("description"),
        )
        .where(has_identifier(F.col("cve"), F.col("ghsa")))
    )
    return deduplicated(finding_columns(known, "snyk"))


def trivy(raw: DataFrame, gt: DataFrame | None = None) -> DataFrame:
    """Findings of a scan report; the range is everything below the fixed version."""
    results = exploded(landed(raw, TRIVY, "Results"), F.col("body"), "r")
    rows = exploded(results, F.col("r.Vulnerabilities"), "v")
    name, version, purl = F.col("v.PkgName"), F.col("v.InstalledVersion"), F.col("v.PkgIdentifier.PURL")
    vuln_id = null_to_blank(F.col("v.VulnerabilityID"))
    reference = F.get(
        F.filter(F.col("v.References"), lambda r: r.contains("GHSA-")), F.lit(0)
    )
    fixed = F.col("v.FixedVersion")
    eco = F.col("ecosystem")
    known = (
        evaluated(
            evaluated(rows, "ord", "v", purl_ecosystem(purl).alias("ecosystem"))
            .where(eco.isNotNull() & filled(name) & filled(version) & filled(purl)),
            "ord",
            "ecosystem",
            F.when(eco == "maven", slash_to_colon(name)).otherwise(name).alias("component"),
            version.alias("version"),
            F.when(vuln_id.startswith("CVE-"), normalize_identifier(vuln_id)).alias("cve"),
            F.coalesce(
                F.when(vuln_id.startswith("GHSA-"), normalize_identifier(vuln_id)),
                normalize_identifier(F.substring_index(reference, "/", -1)),
            ).alias("ghsa"),
            F.when(filled(fixed), F.concat(F.lit("< "), fixed)).alias("affected_version_range"),
            first_line(F.col("v.Title")).alias("description"),
        )
        .where(has_identifier(F.col("cve"), F.col("ghsa")))
    )
    return deduplicated(finding_columns(known, "trivy"))


register(FindingSource("dtrack", dtrack, DTRACK))
register(FindingSource("snyk", snyk, SNYK, ("vulnerabilities",), required=True))
register(FindingSource("trivy", trivy, TRIVY, ("Results",)))
