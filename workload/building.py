"""Queries of the ground-truth build: canonical rows, caps, balancing, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftmark.functions.constants import ECOSYSTEM_NAMES
from siftmark.functions.identity import component_key, stable_row_key
from siftmark.functions.text import clean_description, shorten
from siftmark.operators import balancing, coverage, datasets, selection
from siftmark.session import WRITTEN, shared_folder, written
from siftmark.sinks import committed
from siftmark.sources import advisories as adv
from siftmark.sources import ground_truth
from workload.views import ROWS, VKEY, ctes, rounded, rows, table, view

_R = f"with {ctes('gt0')}, r as ({ROWS})"
_CV = "component_name, component_version"


def canonicalize(spark, d):
    return datasets.canonicalize(rows(spark, d)).select("ord", "ecosystem", "component_name", "vulnerability_id")


def cap_per_component(spark, d):
    return datasets.cap_per_component(rows(spark, d), 10).select("ord", "ecosystem", "component_name")


def cap_versions(spark, d):
    return datasets.cap_versions(rows(spark, d), 3).select("ord", "ecosystem", "component_name", "component_version")


def target_prefix(spark, d):
    return datasets.target_prefix(rows(spark, d), 250).select("ord", "ecosystem")


def balance(spark, d):
    return balancing.balance(rows(spark, d, often=True), ECOSYSTEM_NAMES, "min").select("ord", "ecosystem")


def balance_median(spark, d):
    capped = datasets.cap_per_component(datasets.canonicalize(rows(spark, d)), 10)
    # Balancing reads the capped rows several times, so they are made and written once.
    capped = written(capped.drop("purl", "vulnerability_description"))
    return balancing.balance(capped, ECOSYSTEM_NAMES, "median").select("ord", "ecosystem")


def balance_stats(spark, d):
    return balancing.balance_stats(rows(spark, d), ECOSYSTEM_NAMES, "min")


def gt_counts(spark, d):
    return datasets.gt_counts(rows(spark, d))


def pre_balance_stats(spark, d):
    return datasets.pre_balance_stats(rows(spark, d))


def gt_statistics(spark, d):
    out = datasets.gt_statistics(rows(spark, d))
    return rounded(out, "avg_comp_freq", "avg_compver_freq", "comp_per_osv", "cve_per_osv",
                   "vuln_share", "comp_share")


def balance_validation(spark, d):
    return rounded(datasets.balance_validation(rows(spark, d)), "top1_share", "top5_share")


def top_gt_components(spark, d):
    top = datasets.top_gt_components(rows(spark, d), 20)
    return top.withColumn("versions", F.array_join("versions", " "))


def gt_meta(spark, d):
    return datasets.gt_meta(rows(spark, d), "1995-01-01", "2001-12-31")


def _place(spark):
    return f"{shared_folder(spark)}/{WRITTEN}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def gt_write(spark, d):
    """The dataset as CSV, and the observations in it when it is read again."""
    path = _place(spark)
    datasets.write_ground_truth(rows(spark, d).withColumn("is_vulnerable", F.lit(True)), path)
    return ground_truth.ground_truth(ground_truth.read_rows(spark, path)).drop("ord")


def committed_set(spark, d):
    """Dataset and counts as one set, replaced once, and its rows per ecosystem when it is read again."""
    path, gt = _place(spark), rows(spark, d)
    committed.write_set(spark, {"rows": gt.where("cve is null"), "old": gt.select("ord")}, path)
    committed.write_set(spark, {"rows": gt, "counts": gt.groupBy("ecosystem").agg(F.count("*").alias("n_rows"))}, path)
    tables = committed.read_set(spark, path)
    held = tables["rows"].groupBy("ecosystem").agg(F.count_distinct("ord").alias("n_read"))
    return held.join(tables["counts"], "ecosystem").withColumn("tables", F.lit(len(tables)))


def gt_checks(spark, d):
    return coverage.gt_checks(view(spark, d, "gt0"))


def bom_components(spark, d):
    hashed = rows(spark, d).withColumn("hash_sha1", F.sha1("purl"))
    return datasets.bom_components(hashed)


def candidate_coverage(spark, d):
    packages = view(spark, d, "gt0").select("ecosystem", F.col("component").alias("component_name"))
    late = rows(spark, d).where("cve is not null and vulnerability_description <> ''")
    return datasets.candidate_coverage(packages, late)


def universe_check(spark, d):
    listed = view(spark, d, "releases").select("ecosystem", F.col("package").alias("component_name"))
    return datasets.universe_check(listed)


def universe_prefix(spark, d):
    listed = rows(spark, d).groupBy("ecosystem", "component_name").agg(F.min("ord").alias("ord"))
    return datasets.universe_prefix(listed, 20)


def stable_key(spark, d):
    c = F.col
    raw = rows(spark, d).withColumn("component_name", F.concat(F.lit(" "), F.upper("component_name")))
    return raw.select(
        "ord",
        stable_row_key(c("ecosystem"), c("component_name"), c("component_version"),
                       c("vulnerability_id"), c("cve")).alias("row_key"),
        component_key(c("component_name"), c("component_version")).alias("component_key"),
    )


def _advisory_texts(spark, d):
    return table(spark, d, "documents").select(
        F.concat(F.lit("OSV-"), F.col("doc_id")).alias("id"),
        F.when(F.col("lang") == "en", F.col("text")).alias("summary"),
        F.col("text").alias("details"),
    )


def describe_advisories(spark, d):
    text = clean_description(F.col("summary"), F.col("details"))
    return _advisory_texts(spark, d).select(
        "id", text.alias("description"), shorten(F.col("details"), 240).alias("short")
    )


def enrich_gt(spark, d):
    return datasets.enrich(
        rows(spark, d).drop("vulnerability_description"), _advisory_texts(spark, d)
    ).select("ord", "vulnerability_description")


def expand_advisories(spark, d):
    aliases = F.when(
        F.col("doc_id") % 3 == 0,
        F.array(F.concat(F.lit("CVE-2024-"), F.col("doc_id")), F.lit("GHSA-x"),
                F.concat(F.lit("CVE-2023-"), F.col("doc_id"))),
    ).when(F.col("doc_id") % 3 == 1, F.array(F.lit("GHSA-y")))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), aliases.alias("aliases"))
    return adv.expand_aliases(docs)


def gt_validate(spark, d):
    """Snapshot 0 against answers built from what advisories say."""
    answers = (
        view(spark, d, "published")
        .groupBy("ecosystem", F.col("component").alias("component_name"), F.col("version").alias("component_version"))
        .agg(F.collect_set("osv_id").alias("vulnerability_ids"))
    )
    return datasets.check_rows(rows(spark, d), answers).select("ord", "status")


def _advisories_for_rows(spark, d):
    """One advisory per OSV id; its aliases and ranges follow from the number in the id."""
    n = F.regexp_extract("vulnerability_id", "([0-9]+)$", 1).cast("int")
    ids = rows(spark, d).select("vulnerability_id").distinct().withColumn("n", n)
    event = lambda i, f: F.struct(
        i.cast("string").alias("introduced"), f.cast("string").alias("fixed"),
        F.lit(None).cast("string").alias("last_affected"))
    no = F.lit(None)
    major = lambda x: F.concat(x.cast("string"), F.lit(".0.0"))
    events = F.array(
        event(F.when(F.col("n") % 4 == 0, F.lit("0")).otherwise(major(F.col("n") % 4)), no),
        event(no, major(F.col("n") % 4 + 2)),
        event(F.lit("6.0.0"), no),
    )
    kind = F.when(F.col("n") % 5 == 0, "ECOSYSTEM").otherwise("SEMVER")
    affected = F.array(F.struct(
        F.array(F.lit("5.1.1")).alias("versions"),
        F.array(F.struct(kind.alias("type"), events.alias("events"))).alias("ranges"),
    ))
    aliases = F.array(F.lit("GHSA-z"), F.concat(F.lit("CVE-2024-"), (F.col("n") % 60).cast("string")))
    return ids.select(F.col("vulnerability_id").alias("id"), aliases.alias("aliases"), affected.alias("affected"))


def gt_verify(spark, d):
    return datasets.verify_kinds(rows(spark, d), _advisories_for_rows(spark, d))


# --- releases ---------------------------------------------------------------------


def stable_versions(spark, d):
    return selection.stable_only(view(spark, d, "releases")).select("ecosystem", "package", "version")


def date_window(spark, d):
    r = view(spark, d, "releases")
    day, p = selection.day, F.col("published")
    return r.select(
        "ecosystem", "package", "version",
        selection.within_window(p, day("1997-01-01"), day("1998-12-31")).alias("closed"),
        selection.within_window(p, day(None), day("1998-12-31")).alias("no_start"),
        selection.within_window(p, day("1997-01-01"), day(None)).alias("no_end"),
        selection.within_window(F.lit(None).cast("timestamp"), day(None), day(None)).alias("undated"),
    )


def version_selection(spark, d):
    limits = {"pypi": 5, "npm": 9, "maven": 10, "nuget": 10}
    return selection.select_versions(
        view(spark, d, "releases"), limits, "1996-01-01", "1999-12-31"
    ).select("ecosystem", "package", "version")


def even_sample(spark, d):
    return selection.evenly(view(spark, d, "releases"), 7).select("ecosystem", "package", "version")


_SORTKEY = VKEY.format(v="version")
_STABLE = "not contains(version, 'rc')"
_EVEN = """(n <= {k} or idx in (select round_even(j * (n - 1) / {k1}.0, 0) from range({k}) t(j)))"""


def _even(k: int) -> str:
    return _EVEN.format(k=k, k1=k - 1)


_GROUPS = f"""
g as (select ecosystem, {_CV}, count(*) as size from {{r}} group by all),
ct as (select ecosystem, component_name, count(*) as total from {{r}} group by all),
n as (select ecosystem, count(*) as n from {{r}} group by 1),
t as (select cast(floor({{agg}}(n)) as bigint) as target from n),
rn as (select r.*, size, total, row_number() over (partition by ecosystem, {_CV}
    order by coalesce(vulnerability_id, ''), coalesce(cve, ''), ord) as round
  from {{r}} r join g using (ecosystem, {_CV}) join ct using (ecosystem, component_name)),
dealt as (select *, row_number() over (partition by ecosystem
    order by round, size, total, lower(component_name), component_version) as place from rn),
kept as (select dealt.* from dealt, t where place <= target)"""


def _deal(r: str, agg: str) -> str:
    return _GROUPS.replace("{r}", r).replace("{agg}", agg)


_CLEAN = "trim(regexp_replace({t}, '\\s+', ' ', 'g'), ' ')"
_DOCS = "adv as (select concat('OSV-', doc_id) as id, case when lang = 'en' then text end as summary, text as details from documents)"
_DESC = ("substr(" + _CLEAN.format(t="coalesce(nullif(summary, ''), split_part(details, '.', 1))") + ", 1, 300)")
_SHORT = _CLEAN.format(t="details")
_FREQ = """select coalesce(ecosystem, 'TOTAL') as ecosystem, max(n) as max_{x}, round(avg(n), 9) as avg_{x},
  min(n) as min_{x}, median(n) as median_{x} from {t} group by grouping sets ((ecosystem), ())"""

QUERIES = {
    "canonicalize": (canonicalize, f"""{_R} select ord, ecosystem, component_name, vulnerability_id from (
select *, row_number() over (partition by ecosystem, {_CV}, vulnerability_id order by ord) as k from r) where k = 1"""),
    "cap_per_component": (cap_per_component, f"""{_R} select ord, ecosystem, component_name from (
select *, row_number() over (partition by ecosystem, component_name order by ord) as k from r) where k <= 10"""),
    "cap_versions": (cap_versions, f"""{_R} select ord, ecosystem, component_name, component_version from (
select *, dense_rank() over (partition by ecosystem, component_name order by component_version desc) as k from r)
where k <= 3"""),
    "target_prefix": (target_prefix, f"""{_R} select ord, ecosystem from (
select *, row_number() over (partition by ecosystem order by ord) as k from r) where k <= 250"""),
    "balance": (balance, f"{_R}, {_deal('r', 'min')} select ord, ecosystem from kept"),
    "balance_median": (balance_median, f"""{_R},
c as (select * exclude (k) from (select *, row_number() over (partition by ecosystem, {_CV}, vulnerability_id
  order by ord) as k from r) where k = 1),
p as (select * exclude (k) from (select *, row_number() over (partition by ecosystem, component_name
  order by ord) as k from c) where k <= 10),
{_deal('p', 'median')} select ord, ecosystem from kept"""),
    "balance_stats": (balance_stats, f"""{_R}, {_deal('r', 'min')}
select ecosystem, any_value(n.n) as original_rows, count(*) as kept_rows, any_value(target) as target,
  count(distinct component_name) as unique_components,
  count(distinct ({_CV})) as unique_component_versions
from kept join n using (ecosystem), t group by 1"""),
    "gt_counts": (gt_counts, f"""{_R} select count(distinct (ecosystem, {_CV})) as components,
  count(*) as vulnerability_rows, count(distinct (ecosystem, {_CV}, vulnerability_id)) as distinct_entries from r"""),
    "pre_balance_stats": (pre_balance_stats, f"""{_R} select ecosystem, count(*) as rows,
  count(distinct ({_CV}, vulnerability_id)) as osv_vuln_entries, count(distinct ({_CV})) as unique_components,
  count(distinct case when cve is not null then ({_CV}, cve) end) as cve_findings,
  count(distinct cve) as unique_cves from r group by 1"""),
    "gt_statistics": (gt_statistics, f"""{_R},
v as (select ecosystem, {_CV}, count(*) as n from r group by all),
c as (select ecosystem, component_name, count(*) as n from r group by all),
vs as ({_FREQ.format(x='compver_freq', t='v')}), cs as ({_FREQ.format(x='comp_freq', t='c')}),
k as (select coalesce(ecosystem, 'TOTAL') as ecosystem, count(distinct (ecosystem, {_CV})) as components,
  count(distinct (ecosystem, {_CV}, vulnerability_id)) as osv_vulns,
  count(distinct case when cve is not null then (ecosystem, {_CV}, cve) end) as cve_findings,
  count(distinct cve) as cves from r group by grouping sets ((ecosystem), ()))
select *, round(components / osv_vulns, 9) as comp_per_osv, round(cve_findings / osv_vulns, 9) as cve_per_osv,
  round(osv_vulns / (select osv_vulns from k where ecosystem = 'TOTAL'), 9) as vuln_share,
  round(components / (select components from k where ecosystem = 'TOTAL'), 9) as comp_share
from k join vs using (ecosystem) join cs using (ecosystem)"""),
    "balance_validation": (balance_validation, f"""{_R},
c as (select ecosystem, component_name, count(*) as n, count(distinct component_version) as v from r group by all),
k as (select *, row_number() over (partition by ecosystem order by n desc) as p from c)
select ecosystem, sum(n) as rows, count(*) as unique_components, sum(v) as unique_versions,
  median(n) as median_per_component, max(n) as max_per_component,
  round(max(n) / sum(n), 9) as top1_share, round(sum(n) filter (p <= 5) / sum(n), 9) as top5_share
from k group by 1"""),
    "top_gt_components": (top_gt_components, f"""{_R}
select ecosystem, component_name, count(*) as samples,
  array_to_string(list_sort(list(distinct component_version)), ' ') as versions
from r group by 1, 2 order by samples desc, min(ord) limit 20"""),
    "gt_meta": (gt_meta, f"""{_R},
s as (select ecosystem, count(distinct ({_CV})) as components, count(*) as vulnerabilities from r group by 1)
select cast(sum(components) as bigint) as components_total, cast(sum(vulnerabilities) as bigint) as vulnerabilities_total,
  concat('{{"components_total":', sum(components), ',"ecosystem_breakdown":{{', string_agg(concat('"', ecosystem,
    '":{{"components":', components, ',"vulnerabilities":', vulnerabilities, '}}'), ',' order by ecosystem),
    '}},"osv_query_mode":"component+version","schema_version":"1.1","source":"osv",',
    '"time_window":{{"start_date":"1995-01-01","end_date":"2001-12-31"}},"vulnerabilities_total":',
    sum(vulnerabilities), '}}') as meta from s"""),
    "universe_prefix": (universe_prefix, f"""{_R},
p as (select ecosystem, component_name, min(ord) as ord from r group by all)
select * from p qualify row_number() over (partition by ecosystem order by ord) <= 20"""),
    "gt_checks": (gt_checks, f"""with {ctes('gt0')} select count(*) as n_rows,
  count(*) filter (trim(ecosystem) <> '') as n_with_ecosystem, 'ok' as status from gt0"""),
    "bom_components": (bom_components, f"""{_R} select ecosystem, {_CV}, purl,
  concat('{{"type":"library","bom-ref":"', purl, '","name":"', component_name, '","version":"', component_version,
    '","purl":"', purl, '"', case when ecosystem = 'maven' then
    concat(',"hashes":[{{"alg":"SHA-1","content":"', sha1(purl), '"}}]') else '' end, '}}') as component,
  concat('{{"ref":"', purl, '","dependsOn":[]}}') as dependency
from (select distinct ecosystem, {_CV}, purl from r where purl is not null)"""),
    "candidate_coverage": (candidate_coverage, f"""{_R},
f as (select ecosystem, component_name, count(*) as k from r
      where cve is not null and vulnerability_description <> '' group by all)
select ecosystem, component_name, coalesce(k, 0) as vulnerability_count, coalesce(k, 0) > 0 as has_vulnerabilities
from (select distinct ecosystem, component_name from r) left join f using (ecosystem, component_name)"""),
    "universe_check": (universe_check, f"""with {ctes('releases')}
select ecosystem, package as component_name, count(*) as times from releases group by all having count(*) > 1"""),
    "stable_key": (stable_key, f"""{_R} select ord,
  concat_ws('|', ecosystem, lower(component_name), component_version, lower(vulnerability_id), coalesce(lower(cve), '')) as row_key,
  concat_ws('|', lower(component_name), component_version) as component_key from r"""),
    "describe_advisories": (describe_advisories, f"""with {_DOCS}
select id, {_DESC} as description, case when length({_SHORT}) > 240
  then concat(rtrim(substr({_SHORT}, 1, 239)), '…') else {_SHORT} end as short from adv"""),
    "enrich_gt": (enrich_gt, f"""{_R}, {_DOCS} select ord, coalesce({_DESC}, '') as vulnerability_description
from r left join adv on adv.id = r.vulnerability_id"""),
    "expand_advisories": (expand_advisories, """select cast(doc_id as string) as vulnerability_id, cve from documents,
  unnest(case when doc_id % 3 = 0 then [concat('CVE-2024-', doc_id), concat('CVE-2023-', doc_id)]
              else [cast(null as string)] end) u(cve)"""),
    "gt_validate": (gt_validate, f"""with {ctes('gt0', 'published')},
a as (select distinct ecosystem, component, version from published),
k as (select distinct ecosystem, component, version, osv_id from published)
select ord, case when a.version is null then 'missing' when k.osv_id is null then 'invalid' else 'valid' end as status
from gt0 left join a using (ecosystem, component, version) left join k using (ecosystem, component, version, osv_id)"""),
    "gt_verify": (gt_verify, f"""{_R}, x as (select *, cast(substr(vulnerability_id, 5) as int) as n,
  {VKEY.format(v='component_version')} as k from r),
y as (select case
  when cve is not null and cve <> concat('CVE-2024-', n % 60) then 'cve_mismatch'
  when component_version = '5.1.1' or (n % 5 <> 0 and (
    ((n % 4 = 0 or k >= [n % 4, 0, 0, 1]) and k < [n % 4 + 2, 0, 0, 1]) or k >= [6, 0, 0, 1])) then 'ok'
  else 'not_affected' end as kind from x)
select kind, count(*) as n from y group by 1"""),
    "stable_versions": (stable_versions, f"""with {ctes('releases')}
select ecosystem, package, version from releases where {_STABLE}"""),
    "date_window": (date_window, f"""with {ctes('releases')} select ecosystem, package, version,
  published between '1997-01-01' and '1998-12-31' as closed, published <= '1998-12-31' as no_start,
  published >= '1997-01-01' as no_end, false as undated from releases"""),
    "version_selection": (version_selection, f"""with {ctes('releases')},
st as (select * from releases where {_STABLE}),
w as (select *, published between '1996-01-01' and '1999-12-31' as inside from st),
py as (select *, row_number() over (partition by package order by version desc) as k from releases where ecosystem = 'pypi'),
old as (select *, row_number() over (partition by ecosystem, package order by {_SORTKEY}, version) as k
        from w where ecosystem in ('npm', 'maven')),
nu as (select *, row_number() over (partition by package order by {_SORTKEY} desc, version) - 1 as idx,
  count(*) over (partition by package) as n from w where ecosystem = 'nuget' and inside)
select ecosystem, package, version from py where k <= 5
union all select ecosystem, package, version from old where ecosystem = 'npm' and k <= 9 and inside
union all select ecosystem, package, version from old where ecosystem = 'maven' and k <= 10
union all select ecosystem, package, version from nu where {_even(10)}"""),
    "even_sample": (even_sample, f"""with {ctes('releases')},
nu as (select *, row_number() over (partition by ecosystem, package order by {_SORTKEY} desc, version) - 1 as idx,
  count(*) over (partition by ecosystem, package) as n from releases where {_STABLE})
select ecosystem, package, version from nu where {_even(7)}"""),
}
QUERIES["gt_write"] = (gt_write, f"""{_R} select ecosystem, component_name as component, component_version as version, purl, cve,
  cast(null as varchar) as ghsa, vulnerability_id as osv_id, vulnerability_description as description, 'ground-truth' as source from r""")
QUERIES["committed_set"] = (committed_set, f"""{_R} select ecosystem, count(distinct ord) as n_read, count(*) as n_rows, 2 as tables
from r group by ecosystem""")
