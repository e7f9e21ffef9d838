"""Queries on versions, ranges and names in all their spellings, over whole tables.

Spellings are made from the columns of ``lineitem``; the checking SQL knows the numbers
behind each spelling and never parses one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmark.functions import ranges as R
from siftmark.functions.identity import normalize_component, normalize_identifier, normalize_version
from siftmark.functions.purl import purl_ecosystem, purl_type
from siftmark.operators import coverage
from workload.views import table

_VERSION = (
    "concat(cast(l_linenumber as string), '.', cast(l_suppkey % 5 as string), '.', "
    "case l_orderkey % 6 when 5 then 'x' else cast(l_partkey % 3 as string) end, "
    "case l_orderkey % 6 when 1 then 'rc1' when 2 then '.post1' when 3 then '.dev1' "
    "when 4 then '+build.5' else '' end)"
)
_TOP = "cast(1 + l_suppkey % 7 as string)"


def _numbers(spark, d, spelled: str):
    """Distinct (version, spelling) pairs with their number of rows."""
    return (
        table(spark, d, "lineitem")
        .selectExpr(f"{_VERSION} as version", f"{spelled} as expr")
        .groupBy("version", "expr")
        .agg(F.count("*").alias("n_rows"))
    )


_BARE = f"""case l_partkey % 8 when 0 then concat('>=', {_TOP}, '.0.0') when 1 then concat('<', {_TOP}, '.0')
 when 2 then concat('>= 1.0, <', {_TOP}, '.0.0') when 3 then concat('==', {_TOP}, '.0.0')
 when 4 then concat('[1.0,', {_TOP}, '.0)') when 5 then concat('~=', {_TOP}, '.0')
 when 6 then concat('v1.0 - ', {_TOP}, '.0.0') else concat('>', {_TOP}, '.0.0, !=', {_TOP}, '.1.0') end"""
_NPM = f"""case l_partkey % 8 when 0 then concat('^', {_TOP}, '.0.0') when 1 then concat('>= ', {_TOP}, '.0, < 7.0')
 when 2 then concat('[1.0,', {_TOP}, '.0)') when 3 then concat('~', {_TOP}, '.1')
 when 4 then concat('1.x || >=', {_TOP}, '.0.0') when 5 then concat('< ', {_TOP}, '.0')
 when 6 then '' else concat('>=', {_TOP}, '.0.0 <6.0.0') end"""


def version_in_range_a(spark, d):
    pairs = _numbers(spark, d, _BARE)
    return pairs.withColumn("inside", R.in_bare_range(F.col("version"), F.col("expr")))


def version_in_range_b(spark, d):
    pairs = _numbers(spark, d, _BARE)
    return pairs.withColumn("inside", R.in_normalized_range(F.col("version"), F.col("expr")))


def version_in_range_c(spark, d):
    eco = F.element_at(F.array(*[F.lit(e) for e in ("maven", "npm", "pypi")]), (F.col("l_quantity") % 3 + 1).cast("int"))
    pairs = (
        table(spark, d, "lineitem")
        .selectExpr("*", f"{_VERSION} as version", f"{_NPM} as expr")
        .groupBy(eco.alias("ecosystem"), "version", "expr")
        .agg(F.count("*").alias("n_rows"))
    )
    return pairs.withColumn(
        "verdict", R.semver_range_verdict(F.col("ecosystem"), F.col("version"), F.col("expr"))
    )


def _events(top):
    e = lambda i=None, f=None, l=None: F.struct(  # noqa: E731, E741
        *[(x if x is not None and not isinstance(x, str) else F.lit(x).cast("string")).alias(n)
          for x, n in ((i, "introduced"), (f, "fixed"), (l, "last_affected"))])
    full, short = F.concat(top, F.lit(".0.0")), F.concat(top, F.lit(".0"))
    kind = F.col("kind")
    return (
        F.when(kind == 0, F.array(e("0"), e(f=full)))
        .when(kind == 1, F.array(e("1.0.0")))
        .when(kind == 2, F.array(e("0")))
        .when(kind == 3, F.array(e("1.0.0"), e(l=full)))
        .when(kind == 4, F.array(e("1.0"), e(f="2.0"), e("3.0"), e(f=short)))
        .otherwise(F.array(e("2.0"), e(f="bad")))
    )


def _event_rows(spark, d):
    return (
        table(spark, d, "lineitem")
        .selectExpr(f"{_VERSION} as version", f"{_TOP} as top", "l_partkey % 6 as kind",
                    "case when l_linenumber % 2 = 0 then 'SEMVER' else 'ECOSYSTEM' end as type")
        .groupBy("version", "top", "kind", "type")
        .agg(F.count("*").alias("n_rows"))
        .withColumn("events", _events(F.col("top")))
    )


def osv_affected_last(spark, d):
    rows = _event_rows(spark, d).withColumn("spec", R.events_to_specifier(F.col("events")))
    inside = F.coalesce(R.in_specifier_set(F.col("version"), F.col("spec")), F.lit(False))
    return rows.select("version", "top", "kind", "type", "n_rows", "spec", inside.alias("inside"))


def osv_affected(spark, d):
    affected = F.array(
        F.struct(F.array(F.lit("3.1.1")).alias("versions"),
                 F.array(F.struct("type", "events")).alias("ranges"))
    )
    return _event_rows(spark, d).select(
        "version", "top", "kind", "type", "n_rows",
        R.is_affected(F.col("version"), affected).alias("affected"),
    )


_RAW_NAME = """case l_partkey % 5 when 0 then concat(' Org.Acme/Lib_', cast(l_partkey as string), '/x ')
 when 1 then concat('Org:Lib/', cast(l_partkey as string)) when 2 then '' when 3 then null
 else concat('My_Pkg-', cast(l_partkey as string)) end"""
_RAW_ECO = "case l_suppkey % 5 when 0 then ' Maven' when 1 then 'NPM ' when 2 then 'PyPI' when 3 then 'nuget' else 'cargo' end"
_RAW_ID = """case l_orderkey % 5 when 0 then concat(' cve-2024-', cast(l_orderkey as string), ' ')
 when 1 then concat('ghsa-ab-', cast(l_orderkey as string)) when 2 then '  ' when 3 then null
 else concat(' pysec-', cast(l_orderkey as string)) end"""


def normalize_findings(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        f"{_RAW_ECO} as ecosystem", f"{_RAW_NAME} as name", f"{_RAW_ID} as id",
        "case when l_linenumber > 1 then concat(' ', cast(l_linenumber as string), '.0 ') end as version",
    )
    return rows.select(
        normalize_component(F.col("ecosystem"), F.col("name")).alias("component"),
        normalize_identifier(F.col("id")).alias("id"),
        normalize_version(F.col("version")).alias("version"),
    )


_PURL = """case l_partkey % 5 when 0 then concat(' PKG:Maven/org/', cast(l_partkey as string), '@1 ')
 when 1 then concat('pkg:npm/%40s/p', cast(l_partkey as string)) when 2 then concat('pkg:cargo/', cast(l_partkey as string))
 when 3 then concat('npm/', cast(l_partkey as string)) else null end"""


def purl_ecosystem_query(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_partkey", f"{_PURL} as purl")
    return rows.select(
        "l_partkey", purl_type(F.col("purl")).alias("kind"), purl_ecosystem(F.trim("purl")).alias("ecosystem")
    )


_COMPONENT = """case l_partkey % 4 when 0 then concat('Org.Acme:lib_', cast(l_partkey as string)) when 1 then 'acme/Acme'
 when 2 then '' else concat('My_Lib', cast(l_partkey % 7 as string)) end"""
_ECO = "case l_partkey % 4 when 0 then 'maven' when 1 then 'Maven' when 2 then 'npm' else 'pypi' end"


def component_tokens(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_partkey", f"{_ECO} as e", f"{_COMPONENT} as c")
    return rows.select(
        "l_partkey",
        F.array_join(coverage.component_tokens(F.col("e"), F.col("c")), " ").alias("tokens"),
    )


def cpe_match(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_partkey", "l_suppkey", f"{_ECO} as e", f"{_COMPONENT} as c",
        "case l_suppkey % 4 when 0 then 'My-Lib3' when 1 then 'acme_tools' when 2 then 'acme' else '' end as vendor",
        "concat('my_lib', cast(l_suppkey % 10 as string), '_extra') as product",
    )
    node = F.struct("vendor", "product")
    return rows.select(
        "l_partkey", "l_suppkey",
        coverage.node_match(node, coverage.component_tokens(F.col("e"), F.col("c"))).alias("quality"),
    )


# Numbers behind a version: (a, b, c) and the place of its suffix: dev, rc, none, local, post.
_BASE = f"""with v as (
  select l_linenumber as a, cast(l_suppkey % 5 as int) as b, cast(l_partkey % 3 as int) as c,
    cast(l_orderkey % 6 as int) as s, cast(1 + l_suppkey % 7 as int) as t, {{extra}} from lineitem),
w as (select *, case s when 0 then 0 when 1 then -1 when 2 then 2 when 3 then -2 when 4 then 1 end as rank,
  {_VERSION.replace('l_linenumber', 'a').replace('l_suppkey % 5', 'b').replace('l_partkey % 3', 'c').replace('l_orderkey % 6', 's')} as version,
  cast(t as string) as top from v),
k as (select *, case when s = 5 then null else [a, b, c, rank] end as full_key,
  case when s = 5 then null else [a, b, c, case when rank = 1 then 0 else rank end] end as public_key,
  [a, b, case when s = 5 then 0 else c end, case when s = 1 then 0 else 1 end] as sem from w)"""
_LESS = "({k} < [t, 0, 0, 0] and not (a = t and b = 0 and c = 0 and rank < 0))"
_SPELL = {"_TOP": _TOP}


def _spelled(text: str) -> str:
    return text.replace("l_partkey % 8", "kind").replace(_TOP, "top")


QUERIES = {
    "version_in_range_a": (version_in_range_a, f"""{_BASE.format(extra='cast(l_partkey % 8 as int) as kind')}
select version, {_spelled(_BARE)} as expr, count(*) as n_rows, any_value(case when full_key is null then false
  else case kind when 0 then full_key >= [t, 0, 0, 0] when 1 then full_key < [t, 0, 0, 0]
    when 2 then full_key >= [1, 0, 0, 0] and full_key < [t, 0, 0, 0] when 3 then full_key = [t, 0, 0, 0]
    when 7 then full_key > [t, 0, 0, 0] else true end end) as inside from k group by 1, 2"""),
    "version_in_range_b": (version_in_range_b, f"""{_BASE.format(extra='cast(l_partkey % 8 as int) as kind')}
select version, {_spelled(_BARE)} as expr, count(*) as n_rows, any_value(case when full_key is null then false
  else case kind when 0 then public_key >= [t, 0, 0, 0] when 1 then {_LESS.format(k='public_key')}
    when 2 then public_key >= [1, 0, 0, 0] and {_LESS.format(k='public_key')}
    when 3 then public_key = [t, 0, 0, 0]
    when 4 then public_key >= [1, 0, 0, 0] and {_LESS.format(k='public_key')}
    when 5 then public_key >= [t, 0, 0, 0] and a = t
    when 6 then public_key >= [1, 0, 0, 0] and public_key <= [t, 0, 0, 0]
    else public_key > [t, 0, 0, 0] and not (a = t and b = 0 and c = 0 and rank = 2)
      and public_key <> [t, 1, 0, 0] end end) as inside from k group by 1, 2"""),
    "version_in_range_c": (version_in_range_c, f"""{_BASE.format(extra="cast(l_partkey % 8 as int) as kind, ['maven', 'npm', 'pypi'][cast(l_quantity % 3 as int) + 1] as ecosystem")},
x as (select *, case
  when kind in (1, 6) then null
  when kind = 2 then sem >= [1, 0, 0, 1] and sem < [t, 0, 0, 1]
  when kind = 5 then case when ecosystem = 'pypi' and full_key is not null then {_LESS.format(k='full_key')} end
  else s <> 1 and case kind when 0 then a = t when 3 then a = t and b = 1
    when 4 then a = 1 or sem >= [t, 0, 0, 1] else sem >= [t, 0, 0, 1] and sem < [6, 0, 0, 1] end end as inside from k)
select ecosystem, version, {_spelled(_NPM)} as expr, count(*) as n_rows, any_value(case when inside is null then 'UNDECIDABLE'
  when inside then 'IN_RANGE' else 'OUT_OF_RANGE' end) as verdict from x group by 1, 2, 3"""),
    "osv_affected_last": (osv_affected_last, f"""{_BASE.format(extra="l_partkey % 6 as kind, case when l_linenumber % 2 = 0 then 'SEMVER' else 'ECOSYSTEM' end as type")}
select version, top, kind, type, count(*) as n_rows, any_value(case kind when 0 then concat('<', top, '.0.0')
    when 1 then '>=1.0.0' when 3 then concat('>=1.0.0,<=', top, '.0.0') when 4 then concat('>=3.0,<', top, '.0')
    when 5 then '>=2.0,<bad' end) as spec,
  any_value(case when full_key is null then false else case kind when 0 then {_LESS.format(k='full_key')}
    when 1 then public_key >= [1, 0, 0, 0] when 3 then public_key >= [1, 0, 0, 0] and public_key <= [t, 0, 0, 0]
    when 4 then public_key >= [3, 0, 0, 0] and {_LESS.format(k='full_key')} else false end end) as inside
from k group by version, top, kind, type"""),
    "osv_affected": (osv_affected, f"""{_BASE.format(extra="l_partkey % 6 as kind, case when l_linenumber % 2 = 0 then 'SEMVER' else 'ECOSYSTEM' end as type")}
select version, top, kind, type, count(*) as n_rows, any_value(case when full_key is null then false
  when version = '3.1.1' then true when type <> 'SEMVER' then false
  else case kind when 0 then full_key < [t, 0, 0, 0] when 2 then true when 5 then false
    when 4 then (full_key >= [1, 0, 0, 0] and full_key < [2, 0, 0, 0]) or (full_key >= [3, 0, 0, 0] and full_key < [t, 0, 0, 0])
    else full_key >= [1, 0, 0, 0] end end) as affected
from k group by version, top, kind, type"""),
    "normalize_findings": (normalize_findings, """select
  case l_partkey % 5 when 0 then case l_suppkey % 5
      when 0 then concat('Org.Acme:Lib_', l_partkey, '/x') when 1 then concat('org.acme/lib_', l_partkey, '/x')
      when 2 then concat('org.acme/lib-', l_partkey, '/x') else concat('Org.Acme/Lib_', l_partkey, '/x') end
    when 1 then case when l_suppkey % 5 in (1, 2) then concat('org:lib/', l_partkey) else concat('Org:Lib/', l_partkey) end
    when 4 then case l_suppkey % 5 when 1 then concat('my_pkg-', l_partkey) when 2 then concat('my-pkg-', l_partkey)
      else concat('My_Pkg-', l_partkey) end else '' end as component,
  case l_orderkey % 5 when 0 then concat('CVE-2024-', l_orderkey) when 1 then concat('GHSA-AB-', l_orderkey)
    when 4 then concat('pysec-', l_orderkey) end as id,
  case when l_linenumber > 1 then concat(l_linenumber, '.0') else '' end as version from lineitem"""),
    "purl_ecosystem": (purl_ecosystem_query, """select l_partkey,
  case l_partkey % 5 when 0 then 'maven' when 1 then 'npm' when 2 then 'cargo' end as kind,
  case l_partkey % 5 when 0 then 'maven' when 1 then 'npm' end as ecosystem from lineitem"""),
    "component_tokens": (component_tokens, """select l_partkey, case l_partkey % 4
  when 0 then concat('org.acme lib-', l_partkey) when 1 then 'acme' when 2 then ''
  else concat('my-lib', l_partkey % 7) end as tokens from lineitem"""),
    "cpe_match": (cpe_match, """select l_partkey, l_suppkey, case l_partkey % 4
  when 1 then case l_suppkey % 4 when 2 then 'exact' when 1 then 'substring' end
  when 3 then case when l_suppkey % 4 = 0 and l_partkey % 7 = 3 then 'exact'
                   when l_suppkey % 10 = l_partkey % 7 then 'substring' end end as quality from lineitem"""),
}
