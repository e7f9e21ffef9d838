"""Queries that parse raw scanner, advisory and registry documents.

Documents are rendered from whole driver tables; the checking SQL states what a correct
parse must give straight from the columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmark.plans.scoring import collect_findings
from siftmark.sources import advisories, ground_truth, registries, scanners
from workload.views import ORD, VERSION, VKEY, ctes, table, view, views

_N = "cast(l_partkey as string)"
_KIND = "case l_partkey % 4 when 0 then 'maven' when 1 then 'npm' when 2 then 'nuget' else 'pypi' end"
_SHOWN = ["ord", "ecosystem", "component", "version", "cve", "ghsa", "affected_version_range", "description"]
_TOP = "cast(1 + l_suppkey % 7 as string)"


def _lines(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        f"{ORD} as ord", "l_orderkey as o", "l_partkey as p", "l_linenumber as line",
        f"{_KIND} as eco", f"{_N} as n", f"{_TOP} as top", f"{VERSION} as version",
    )


def _when(condition: str, value):
    return F.when(F.expr(condition), value)


def _snyk_raw(spark, d):
    name = F.expr("case eco when 'maven' then concat('org.acme/pkg-', n) else concat('Pkg_', n) end")
    v = F.struct(
        _when("o % 13 <> 0", name).alias("packageName"),
        name.alias("name"),
        _when("line < 7", F.col("version")).alias("version"),
        F.expr("case when o % 17 = 0 then 'pkg:cargo/x' else concat('pkg:', eco, '/x@1') end").alias("packageUrl"),
        F.concat(F.lit("Flaw in "), F.col("n"), F.lit("\nmore")).alias("title"),
        F.struct(
            _when("o % 10 < 7", F.array(F.lit("bad"), F.expr("concat('CVE-2024-', cast(o % 60 as string))"))).alias("CVE"),
            _when("o % 10 >= 5", F.array(F.expr("concat('GHSA-ab', cast(o % 50 as string))"))).alias("GHSA"),
        ).alias("identifiers"),
        F.struct(
            F.expr("case o % 3 when 0 then array('>=1.0', concat('<', top, '.0')) when 1 then cast(array() as array<string>) end").alias("vulnerable")
        ).alias("semver"),
    )
    listed = F.when(F.expr("o % 19 = 0"), F.array(v, v)).otherwise(F.array(v))
    return _lines(spark, d).select("ord", "o", F.to_json(F.struct(listed.alias("vulnerabilities"))).alias("payload"))


def scan_snyk(spark, d):
    return scanners.snyk(_snyk_raw(spark, d).drop("o")).select(*_SHOWN)


def _trivy_raw(spark, d):
    name = F.expr("case eco when 'maven' then concat('org.acme/pkg-', n) else concat('Pkg_', n) end")
    v = F.struct(
        name.alias("PkgName"),
        _when("line < 7", F.col("version")).alias("InstalledVersion"),
        F.struct(F.expr("case when o % 17 = 0 then '' else concat('pkg:', eco, '/x@1') end").alias("PURL")).alias("PkgIdentifier"),
        F.expr("case when o % 10 < 6 then concat('CVE-2024-', cast(o % 60 as string)) when o % 10 < 8 "
               "then concat('GHSA-ab', cast(o % 50 as string)) else 'TEMP-1' end").alias("VulnerabilityID"),
        _when("o % 4 = 0", F.array(F.lit("https://x.example/y"), F.expr("concat('https://x.example/a/GHSA-cd', n)"))).alias("References"),
        F.expr("case o % 3 when 0 then concat(top, '.0.0') when 1 then '' end").alias("FixedVersion"),
        F.concat(F.lit("Flaw in "), F.col("n"), F.lit("\nmore")).alias("Title"),
    )
    empty = F.filter(F.array(v), lambda x: F.lit(False))
    results = F.array(
        F.struct(F.array(v).alias("Vulnerabilities")), F.struct(empty.alias("Vulnerabilities"))
    )
    return _lines(spark, d).select("ord", "o", F.to_json(F.struct(results.alias("Results"))).alias("payload"))


def scan_trivy(spark, d):
    return scanners.trivy(_trivy_raw(spark, d).drop("o")).select(*_SHOWN)


def landed_reports(spark, d):
    """Findings and rejects of reports of which some are cut off, of another kind or empty."""
    broken = F.expr("""case when o % 23 = 0 then substr(payload, 1, 20)
        when o % 29 = 0 then '{"vulnerabilities": 3, "Results": "x"}' when o % 31 = 0 then '{}' else payload end""")
    raw = {t: made(spark, d).select("ord", broken.alias("payload")) for t, made in (("snyk", _snyk_raw), ("trivy", _trivy_raw))}
    findings, rejects = collect_findings(raw, None)
    said = findings.select("tool", F.lit("finding").alias("what")).unionByName(rejects.select("tool", F.col("reason").alias("what")))
    return said.groupBy("tool", "what").agg(F.count("*").alias("n"))


def scan_dtrack(spark, d):
    name = F.expr("case eco when 'maven' then concat('org.acme/pkg-', n) when 'npm' then concat('%40Acme%2Fpkg+', n) else concat('Pkg_', n) end")
    tail = F.expr("case o % 3 when 0 then '?type=jar' when 1 then '#sub' else '' end")
    purl = F.when(F.expr("o % 17 = 0"), F.concat(F.lit("pkg:"), F.col("eco"), F.lit("/"), name)).when(
        F.expr("line = 7"), F.lit("pkg:cargo/x@1")
    ).otherwise(F.concat(F.lit(" pkg:"), F.col("eco"), F.lit("/"), name, F.lit("@"), F.col("version"), tail))
    f = F.struct(
        F.struct(purl.alias("purl")).alias("component"),
        F.struct(
            F.expr("case when o % 10 < 6 then concat('cve-2024-', cast(o % 60 as string)) when o % 10 < 8 "
                   "then concat('GHSA-ab', cast(o % 50 as string)) else 'SNYK-1' end").alias("vulnId"),
            F.concat(F.lit(" Flaw in "), F.col("n"), F.lit(" \nmore")).alias("description"),
            F.expr("case o % 3 when 0 then concat('<', top, '.0') when 1 then '' end").alias("vulnerableVersions"),
            F.expr("case when o % 2 = 0 then '>=1.0' end").alias("affectedVersionRange"),
        ).alias("vulnerability"),
    )
    raw = _lines(spark, d).select("ord", F.to_json(F.array(f)).alias("payload"))
    return scanners.dtrack(raw).select(*_SHOWN)


def scan_oss_index(spark, d):
    gt = view(spark, d, "gt0").drop("description")
    coord = F.expr("""case when substr(ord, 3, 1) >= 'c' then concat('pkg:npm/other-', substr(ord, 4, 2), '@2.0?arch=x')
        when purl is not null then purl when ecosystem <> 'maven' then concat('pkg:', ecosystem, '/', component, '@', version) end""")
    x = "substr(ord, 2, 1)"
    v = F.struct(
        F.concat(F.lit("s-"), F.substring("ord", 5, 2)).alias("id"),
        _when("substr(ord, 6, 1) < '8'", F.lit("Bad parser\nrest")).alias("title"),
        _when(f"{x} >= '8' and {x} < 'c'", F.expr("concat('see CVE-2022-', substr(ord, 7, 1), ', or GHSA-zz-', substr(ord, 7, 1), '.')")).alias("description"),
        _when(f"{x} < '2'", F.lit("cve-2024-5")).alias("cve"),
        _when(f"{x} >= '2' and {x} < '4'", F.lit("CVE-2024-6")).alias("cveId"),
        _when(f"{x} >= '4' and {x} < '8'", F.array(F.lit("https://x.example/CVE-2023-77/"), F.lit("https://g.example/GHSA-q1w2"))).alias("references"),
    )
    report = F.struct(coord.alias("coordinates"), F.array(v).alias("vulnerabilities"))
    raw = gt.select("ord", F.to_json(F.array(report)).alias("payload"))
    return advisories.oss_index(raw, gt).select(*[c for c in _SHOWN if c != "affected_version_range"])


def _spelling(column, github):
    out = column
    names = {"pypi": ("PIP", "PyPI"), "npm": ("NPM", "npm"), "maven": ("MAVEN", "Maven"), "nuget": ("NUGET", "NuGet")}
    for eco, (gh, osv) in names.items():
        out = F.when(column == eco, gh if github else osv).otherwise(out)
    return out


def _per_package(gt, modulus):
    """Distinct (package, number) with its first ord."""
    return (
        gt.groupBy("ecosystem", "component",
                 (F.substring("osv_id", 5, 9).cast("int") % modulus).alias("m"))
        .agg(F.min("ord").alias("ord"))
    )


def scan_github(spark, d):
    (gt,) = views(spark, d, "gt0")
    p = _per_package(gt, 60)
    top = F.concat((1 + F.col("m") % 7).cast("string"), F.lit(".0.0"))
    rng = (F.when(F.col("m") % 5 == 0, F.concat(F.lit("<"), top)).when(F.col("m") % 5 == 1, ">= 1.0, < 2.0")
           .when(F.col("m") % 5 == 2, F.concat(F.lit("[1.0,"), top, F.lit(")")))
           .when(F.col("m") % 5 == 4, F.concat(F.lit(">="), top)))
    m = F.col("m").cast("string")
    ident = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    ghsa = F.concat(F.lit("ghsa-gh-"), m)
    ids = F.when(F.col("m") % 2 == 0, F.array(ident("GHSA", ghsa), ident("CVE", F.concat(F.lit("CVE-2024-"), m)))).otherwise(
        F.array(ident("GHSA", ghsa)))
    node = F.struct(
        rng.alias("vulnerableVersionRange"),
        F.struct(F.when(F.col("m") % 11 > 0, ghsa).alias("ghsaId"), F.lit("Sum\nmore").alias("summary"), ids.alias("identifiers")).alias("advisory"),
    )
    body = F.struct(F.struct(F.struct(F.array(node).alias("nodes")).alias("securityVulnerabilities")).alias("data"))
    raw = p.select("ord", _spelling(F.col("ecosystem"), True).alias("github_ecosystem"),
                   F.col("component").alias("package"), F.to_json(body).alias("payload"))
    return advisories.github(raw, gt).select(*_SHOWN)


def scan_osv(spark, d):
    (gt,) = views(spark, d, "gt0")
    p = _per_package(gt, 90)
    null = F.lit(None).cast("string")
    e = lambda i, f: F.struct(i.alias("introduced"), f.alias("fixed"))
    top = F.concat((1 + F.col("m") % 7).cast("string"), F.lit(".0.0"))
    events = F.when(F.col("m") % 4 == 1, F.array(e(F.lit("1.0.0"), null))).otherwise(
        F.array(e(F.lit("0"), null), e(null, top)))
    ranges = F.when(F.col("m") % 4 > 0, F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), events.alias("events"))))
    affected = F.array(
        F.struct(F.array(F.lit("3.1.1")).alias("versions"), ranges.alias("ranges"))
    )
    m = F.col("m").cast("string")
    v = F.struct(
        F.concat(F.lit("OSV-"), m).alias("id"),
        F.array(F.concat(F.lit("GHSA-o-"), m), F.concat(F.lit("CVE-2024-"), (F.col("m") % 60).cast("string"))).alias("aliases"),
        F.when(F.col("m") % 2 == 0, F.concat(F.lit("Summary "), m)).alias("summary"),
        F.concat(F.lit("Details "), m).alias("details"),
        affected.alias("affected"),
    )
    raw = p.select("ord", _spelling(F.col("ecosystem"), False).alias("osv_ecosystem"),
                   F.col("component").alias("package"), F.to_json(F.struct(F.array(v).alias("vulns"))).alias("payload"))
    return advisories.osv(raw, gt).select(*_SHOWN, "osv_id", "match_type")


def _packages(spark, d):
    """One row per package with the list of its distinct releases, as a registry keeps it."""
    return (
        view(spark, d, "releases")
        .groupBy(F.concat_ws("/", "ecosystem", "package").alias("package"))
        .agg(F.collect_list(F.struct("version", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'.000Z'").alias("at"))).alias("r"))
    )


_REL = ["ecosystem", "package", "version"]


def versions_pypi(spark, d):
    doc = F.struct(F.map_from_entries(F.transform("r", lambda x: F.struct(x["version"], F.array(x["at"])))).alias("releases"))
    return registries.pypi(_packages(spark, d).select("package", F.to_json(doc).alias("payload"))).select(*_REL)


def _dated(df):
    return df.select(*_REL, F.date_format("published", "yyyy-MM-dd").alias("published"))


def versions_npm(spark, d):
    time = lambda x: F.when(x["version"].startswith("2."), "soon").otherwise(x["at"])
    doc = F.struct(
        F.map_from_entries(F.transform("r", lambda x: F.struct(x["version"], F.struct(x["version"].alias("v"))))).alias("versions"),
        F.map_from_entries(F.transform(F.filter("r", lambda x: ~x["version"].startswith("1.")),
                                       lambda x: F.struct(x["version"], time(x)))).alias("time"),
    )
    return _dated(registries.npm(_packages(spark, d).select("package", F.to_json(doc).alias("payload"))))


def versions_maven(spark, d):
    items = F.array_join(F.transform("r", lambda x: F.concat(F.lit("<version>"), x["version"], F.lit("</version>"))), "")
    doc = F.concat(F.lit("<metadata><versioning><versions>"), items, F.lit("<version></version></versions></versioning></metadata>"))
    return registries.maven(_packages(spark, d).select("package", doc.alias("payload"))).select(*_REL)


def versions_nuget(spark, d):
    entry = lambda x: F.struct(F.struct(x["version"].alias("version"), F.when(
        ~x["version"].startswith("1."), x["at"]).alias("published")).alias("catalogEntry"))
    pages = F.array(
        F.struct(F.lit("p1").alias("@id"), F.transform("r", entry).alias("items")),
        F.struct(F.lit("p2").alias("@id"), F.transform(F.filter("r", lambda x: F.lit(False)), entry).alias("items")),
    )
    doc = F.struct(pages.alias("items"))
    return _dated(registries.nuget(_packages(spark, d).select("package", F.to_json(doc).alias("payload"))))


def gt_observations(spark, d):
    r = view(spark, d, "releases").withColumn("part", F.split("version", r"\."))
    digit = lambda i: F.regexp_extract(F.get("part", F.lit(i)), "^[0-9]+", 0)
    vuln = lambda i, *al: F.struct(i.alias("id"), F.array(*al).alias("aliases"))
    osv = lambda x: F.concat(F.lit("OSV-"), x)
    a, b, c = digit(0), digit(1), digit(2)
    vulns = F.array(
        vuln(osv(a), F.lit("GHSA-1"), F.concat(F.lit("CVE-2024-"), a)), vuln(osv(b), F.lit("GHSA-2")),
        vuln(osv(a), F.lit("CVE-1")), vuln(F.lit(None).cast("string"), F.lit("CVE-2")),
        vuln(osv(c), F.lit("CVE-3"), F.lit("CVE-4")), vuln(osv(F.lit("cut")), F.lit("CVE-5")),
    )
    raw = r.select(F.concat_ws("/", "ecosystem", "package", "version").alias("ord"), "ecosystem", "package", "version",
                   F.to_json(F.struct(vulns.alias("vulns"))).alias("payload"))
    return advisories.observations(raw, 5).drop("ord")


def coordinates(spark, d):
    name = F.expr("case when ecosystem = 'maven' then concat('org.acme:', component) else concat('@s/', component, ' +x') end")
    return advisories.coordinates(view(spark, d, "gt0").withColumn("component", name))


def gt_scan(spark, d):
    r = view(spark, d, "gt0").select(
        "ord",
        F.expr("concat(' ', upper(ecosystem))").alias("ecosystem"),
        F.expr("concat(' Group/My_', component, ' ')").alias("component_name"),
        F.expr("concat(version, ' ')").alias("component_version"),
        F.coalesce("purl", F.lit(" ")).alias("purl"),
        F.expr("case when cve is null then '' else concat(' ', lower(cve)) end").alias("cve"),
        F.col("osv_id").alias("vulnerability_id"),
        F.col("description").alias("vulnerability_description"),
    )
    return ground_truth.ground_truth(r)


_LINES = f"""l as (select {ORD} as ord, l_orderkey as o, l_partkey as p, l_linenumber as line, {_KIND} as eco,
  {_N} as n, {_TOP} as top, {VERSION} as version from lineitem)"""


def _first(body: str) -> str:
    return f"""with {_LINES}, f as ({body})
select * exclude (k) from (select *, row_number() over (partition by ecosystem, component, version, coalesce(cve, ghsa)
  order by ord) as k from f where cve is not null or ghsa is not null) where k = 1"""


_PLAIN_NAME = "case eco when 'maven' then concat('org.acme:pkg-', n) else concat('Pkg_', n) end"
_STABLE = "not contains(version, 'rc')"
_PKG = "concat(ecosystem, '/', package)"

_SNYK = f"""select concat(ord, '|00000000') as ord, eco as ecosystem, {_PLAIN_NAME} as component, version,
  case when o % 10 < 7 then concat('CVE-2024-', o % 60) end as cve, case when o % 10 >= 5 then concat('GHSA-AB', o % 50) end as ghsa,
  case when o % 3 = 0 then concat('>=1.0,<', top, '.0') end as affected_version_range, concat('Flaw in ', n) as description
  from l where line < 7 and o % 17 <> 0"""
_TRIVY = f"""select concat(ord, '|00000000|00000000') as ord, eco as ecosystem, {_PLAIN_NAME} as component, version,
  case when o % 10 < 6 then concat('CVE-2024-', o % 60) end as cve,
  case when o % 10 in (6, 7) then concat('GHSA-AB', o % 50) when o % 4 = 0 then concat('GHSA-CD', n) end as ghsa,
  case when o % 3 = 0 then concat('< ', top, '.0.0') end as affected_version_range, concat('Flaw in ', n) as description
  from l where line < 7 and o % 17 <> 0"""
_WHOLE = " and o % 23 <> 0 and o % 29 <> 0 and o % 31 <> 0"

QUERIES = {
    "scan_snyk": (scan_snyk, _first(_SNYK)),
    "scan_trivy": (scan_trivy, _first(_TRIVY)),
    "landed_reports": (landed_reports, " union all ".join(
        f"""select '{tool}' as tool, 'finding' as what, count(*) as n from ({_first(body + _WHOLE)}) having count(*) > 0
union all select '{tool}', reason, count(*) from (select case when l_orderkey % 23 = 0 then 'no JSON'
  when l_orderkey % 29 = 0 then '{part} is of another kind' when l_orderkey % 31 = 0 then '{none}' end as reason from lineitem)
where reason <> '' group by all"""
        for tool, body, part, none in (("snyk", _SNYK, "vulnerabilities", "no vulnerabilities"), ("trivy", _TRIVY, "Results", "")))),
    "scan_dtrack": (scan_dtrack, _first("""select concat(ord, '|00000000') as ord, eco as ecosystem,
  case eco when 'maven' then concat('org.acme:pkg-', n) when 'npm' then concat('@acme/pkg+', n)
    when 'pypi' then concat('pkg-', n) else concat('Pkg_', n) end as component, version,
  case when o % 10 < 6 then concat('CVE-2024-', o % 60) end as cve, case when o % 10 in (6, 7) then concat('GHSA-AB', o % 50) end as ghsa,
  case when o % 3 = 0 then concat('<', top, '.0') when o % 2 = 0 then '>=1.0' end as affected_version_range, concat('Flaw in ', n) as description
  from l where line < 7 and o % 17 <> 0""")),
    "scan_oss_index": (scan_oss_index, f"""with {ctes('gt0')},
x as (select *, substr(ord, 2, 1) as x, substr(ord, 3, 1) >= 'c' as other from gt0),
f as (select concat(ord, '|00000000|00000000') as ord, case when other then 'npm' else ecosystem end as ecosystem,
  case when other then concat('other-', substr(ord, 4, 2)) else component end as component,
  case when other then '2.0' else version end as version,
  case when x < '2' then 'CVE-2024-5' when x < '4' then 'CVE-2024-6' when x < '8' then 'CVE-2023-77'
    when x < 'c' then concat('CVE-2022-', upper(substr(ord, 7, 1))) end as cve,
  case when x >= '4' and x < '8' then 'GHSA-Q1W2' when x >= '8' and x < 'c' then concat('GHSA-ZZ-', upper(substr(ord, 7, 1))) end as ghsa,
  trim(concat('[OSSINDEX:s-', substr(ord, 5, 2), '] ', case when substr(ord, 6, 1) < '8' then 'Bad parser'
    when x >= '8' then concat('see CVE-2022-', substr(ord, 7, 1), ', or GHSA-zz-', substr(ord, 7, 1), '.') else '' end)) as description
  from x where x < 'c' and (other or purl is not null or ecosystem <> 'maven'))
select * exclude (k) from (select *, row_number() over (partition by ecosystem, component, version, coalesce(cve, ghsa) order by ord) as k from f) where k = 1"""),
    "scan_github": (scan_github, f"""with {ctes('gt0')},
a as (select ecosystem, component, cast(substr(osv_id, 5) as int) % 60 as m, min(ord) as ord from gt0 group by all),
c as (select distinct ecosystem, component, version, {VKEY.format(v='version')} as k from gt0),
j as (select concat(ord, '|00000000') as ord, ecosystem, component, version, case when m % 2 = 0 then concat('CVE-2024-', m) end as cve,
  concat('GHSA-GH-', m) as ghsa, case m % 5 when 0 then concat('<', 1 + m % 7, '.0.0') when 1 then '>= 1.0, < 2.0'
    when 2 then concat('[1.0,', 1 + m % 7, '.0.0)') when 4 then concat('>=', 1 + m % 7, '.0.0') end as affected_version_range, 'Sum' as description
  from c join a using (ecosystem, component)
  where m % 11 > 0 and case m % 5 when 0 then k[4] = 1 and k < [1 + m % 7, 0, 0, 1] when 4 then k[4] = 1 and k >= [1 + m % 7, 0, 0, 1]
    when 2 then k >= [1, 0, 0, 1] and k < [1 + m % 7, 0, 0, 1] else true end)
select * exclude (n) from (select *, row_number() over (partition by ecosystem, component, version, coalesce(cve, ghsa) order by ord) as n from j) where n = 1"""),
    "scan_osv": (scan_osv, f"""with {ctes('gt0')},
a as (select ecosystem, component, cast(substr(osv_id, 5) as int) % 90 as m, min(ord) as adv from gt0 group by all),
ai as (select * from (select *, unnest([concat('OSV-', m), concat('GHSA-o-', m), concat('CVE-2024-', m % 60)]) as id from a)),
g as (select * from (select *, {VKEY.format(v='version')} as k, unnest([cve, osv_id]) as id from gt0
      where not (ecosystem = 'maven' and purl is not null)) where id is not null),
h as (select distinct g.ord, g.ecosystem, g.component, g.version, g.cve, adv, m, case
    when g.version = '3.1.1' then 'EXACT'
    when m % 4 = 1 and k >= [1, 0, 0, 1] then 'RANGE'
    when m % 4 in (2, 3) and k < [1 + m % 7, 0, 0, 1] and k <> [1 + m % 7, 0, 0, 0] then 'RANGE' end as match_type
  from g join ai on ai.ecosystem = g.ecosystem and ai.component = g.component and ai.id = g.id),
b as (select *, row_number() over (partition by ord order by adv) as k from h where match_type is not null),
f as (select ord, ecosystem, component, version, coalesce(cve, concat('CVE-2024-', m % 60)) as cve, concat('GHSA-o-', m) as ghsa,
  concat('OSV-', m) as osv_id, match_type, case when m % 2 = 0 then concat('Summary ', m) else concat('Details ', m) end as description,
  case when match_type = 'RANGE' then case when m % 4 = 1 then '>=1.0.0' else concat('<', 1 + m % 7, '.0.0') end end as affected_version_range
  from b where k = 1)
select * exclude (n) from (select *, row_number() over (partition by ecosystem, component, version, cve order by ord) as n from f) where n = 1"""),
    "versions_pypi": (versions_pypi, f"with {ctes('releases')} select 'pypi' as ecosystem, {_PKG} as package, version from releases"),
    "versions_npm": (versions_npm, f"""with {ctes('releases')} select 'npm' as ecosystem, {_PKG} as package, version,
  strftime(published, '%Y-%m-%d') as published from releases
where {_STABLE} and not starts_with(version, '1.') and not starts_with(version, '2.')"""),
    "versions_maven": (versions_maven, f"with {ctes('releases')} select 'maven' as ecosystem, {_PKG} as package, version from releases where {_STABLE}"),
    "versions_nuget": (versions_nuget, f"""with {ctes('releases')} select 'nuget' as ecosystem, {_PKG} as package, version,
  strftime(published, '%Y-%m-%d') as published from releases where {_STABLE} and not starts_with(version, '1.')"""),
    "gt_observations": (gt_observations, f"""with {ctes('releases')},
p as (select *, split_part(version, '.', 1) as a, split_part(version, '.', 2) as b, regexp_extract(split_part(version, '.', 3), '^[0-9]+') as c from releases),
e as (select *, concat('OSV-', a) as id, concat('CVE-2024-', a) as cve from p
  union all select *, concat('OSV-', b), null from p where b <> a
  union all select *, concat('OSV-', c), 'CVE-3' from p where c <> a and c <> b)
select ecosystem, package as component_name, version as component_version,
  concat('pkg:', ecosystem, '/', package, '@', version) as purl, id as vulnerability_id, cve, true as is_vulnerable from e"""),
    "coordinates": (coordinates, f"""with {ctes('gt0')},
n as (select ord, ecosystem, case when ecosystem = 'maven' then concat('org.acme:', component) else concat('@s/', component, ' +x') end as component, version,
  coalesce(purl, case when ecosystem = 'maven' then concat('pkg:maven/org.acme/', component, '@', version)
    else concat('pkg:', ecosystem, '/%40s/', component, '%20%2Bx@', version) end) as coordinate from gt0)
select coordinate, ecosystem, component, version from (select *, row_number() over (partition by coordinate order by ord) as k from n) where k = 1"""),
    "gt_scan": (gt_scan, f"""with {ctes('gt0')} select ord, ecosystem,
  case ecosystem when 'npm' then concat('group/my_', component) when 'pypi' then concat('group/my-', component)
    else concat('Group/My_', component) end as component, version, purl, cve, cast(null as varchar) as ghsa, osv_id, description,
  'ground-truth' as source from gt0"""),
}
