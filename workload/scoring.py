"""Queries that match findings to the ground truth and score the outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmark.operators import datasets, matching, metrics, taxonomy
from siftmark.session import written
from siftmark.sources.base import deduplicated
from workload.views import SCORING, TOOLS, ctes, in_range, rounded, sql, table, view, views


def _inputs(spark, d):
    return views(spark, d, "gt0", "findings")


def _matched(spark, d, chosen=True):
    gt, f = _inputs(spark, d)
    return matching.match(gt.drop("purl", "description"), f, TOOLS, chosen)


def match_project_centric(spark, d):
    return _matched(spark, d).select("tool", "ord", "match_type", "finding_ord")


def false_positives(spark, d):
    gt, f = _inputs(spark, d)
    extra = matching.extra_findings(gt, f.drop("description"))
    return extra.select("tool", "ord", "ecosystem", "component")


def false_negatives(spark, d):
    return matching.false_negatives(_matched(spark, d, chosen=False)).select("tool", "ord", "ecosystem", "component")


def fn_taxonomy(spark, d):
    gt, f = _inputs(spark, d)
    return matching.classified_misses(gt.drop("purl", "description"), f, TOOLS).select("tool", "ord", "fn_class")


def _with_aliases(spark, d):
    gt, f, published = views(spark, d, "gt0", "findings", "published")
    return gt, f, published.select("ecosystem", "component", F.col("cve").alias("alias"))


def _classified(spark, d):
    return taxonomy.classified_extra(*_with_aliases(spark, d))


def fp_taxonomy(spark, d):
    return _classified(spark, d).select("tool", "ord", "fp_class", "fp_reason")


def fp_tally(spark, d):
    return taxonomy.fp_tally(_classified(spark, d))


def fp_product(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", taxonomy.names_product(F.col("text")).alias("names_product"))


def pair_verdict(spark, d):
    gt, f = _inputs(spark, d)
    ids = matching.IDS
    left = matching.for_each_tool(
        gt.select(F.col("ord").alias("gt_ord"), F.col("version").alias("gt_version"), *[F.col(c).alias(f"gt_{c}") for c in ids]),
        TOOLS,
    ).withColumn("ord", F.md5(F.concat_ws("|", "tool", "gt_ord"))).drop("tool", "gt_ord")
    right = f.select("ord", "version", "affected_version_range", *ids)
    pairs = matching.in_range_by_text(
        left.join(right, "ord"), "gt_version", "affected_version_range",
        gt.select(F.col("version").alias("gt_version")), f,
    )
    verdict = matching.pair_verdict(
        matching.shared_id([F.col(f"gt_{c}") for c in ids], [F.col(c) for c in ids]),
        F.col("gt_version"), F.col("version"), F.col("in_range"),
    )
    return pairs.select("ord", verdict.alias("verdict"))


def ecosystem_metrics(spark, d):
    gt, f = _inputs(spark, d)
    return rounded(metrics.ecosystem_metrics(gt, f, TOOLS), "Recall", "Overlap")


def gt_summary(spark, d):
    return metrics.gt_summary(view(spark, d, "gt0"))


def component_outcomes(spark, d):
    gt, f = _inputs(spark, d)
    return metrics.component_outcomes(gt, f, TOOLS)


def top_components(spark, d):
    gt, f = _inputs(spark, d)
    return metrics.top_groups(gt, f, TOOLS, ["ecosystem", "component"], "FN", 10)


def top_fp_components(spark, d):
    gt, f = _inputs(spark, d)
    return metrics.top_groups(gt, f, TOOLS, ["ecosystem", "component"], "FP", 5)


def ecosystems_by_fn(spark, d):
    gt, f = _inputs(spark, d)
    return metrics.top_groups(gt, f, TOOLS, ["ecosystem"], "FN", 100)


def report_summary(spark, d):
    gt, f = _inputs(spark, d)
    return rounded(metrics.report_summary(gt, f, TOOLS), "Recall", "Recall_EXACT", "Overlap")


def report_matrix(spark, d):
    gt, f, aliases = _with_aliases(spark, d)
    # Extra findings are told where packages are matched, so hits need no chosen finding.
    undigested = f.withColumn("ord", F.lit(""))
    hits = written(matching.matched_signatures(gt, undigested, ["tool"]).drop("finding_ord", "n_chosen"))
    extra = taxonomy.classified_extra(gt, f, aliases)
    out = metrics.report_matrix(gt, f, hits, extra, TOOLS)
    return rounded(out, "Recall", "Recall_EXACT", "Overlap")


def gt_osv_summary(spark, d):
    return rounded(metrics.gt_osv_summary(view(spark, d, "gt0")), "cves_per_entry")


def heuristic_quality(spark, d):
    gt, f = _inputs(spark, d)
    hits = written(matching.matched_signatures(gt, f, ["tool"]))
    mark = F.when(taxonomy.names_product(F.col("description")), "FP-LIKELY")
    # Marks are made before the shuffles, which descriptions need not go through.
    extra = matching.false_positives(f.select("tool", "ord", mark.alias("fp_class")), hits).select(
        "tool", F.lit("FP").alias("outcome"), "fp_class"
    )
    rows = matching.with_signature(gt).select(*matching.SIGNATURE, mark.alias("fp_class"))
    found = rows.join(hits, matching.SIGNATURE).select("tool", F.lit("TP").alias("outcome"), "fp_class")
    return rounded(
        metrics.heuristic_quality(extra.unionByName(found)), "heuristic_precision", "heuristic_recall"
    )


def dedup_findings(spark, d):
    f = view(spark, d, "findings")
    tagged = f.withColumn("component", F.concat_ws(":", "tool", "component"))
    return deduplicated(tagged).select("ord", "tool", "ecosystem", "version", "cve", "ghsa", "osv_id")


def findings_for_component(spark, d):
    f = view(spark, d, "findings")
    return matching.findings_for(f, "npm", "pkg-core", "3.1.1").select("ord", "tool", "cve", "ghsa", "osv_id")


def findings_dump(spark, d):
    return datasets.findings_dump(view(spark, d, "findings"))


def findings_snapshot(spark, d):
    return datasets.findings_snapshot(view(spark, d, "findings").withColumn("source", F.col("tool")))


_FN_CLASS = f"""
fn as (select * from m where match_type is null),
same as (select distinct tool, ecosystem, component, version, true as hit from findings),
any_range as (select distinct tool, ecosystem, component, affected_version_range
              from findings where affected_version_range is not null),
spot as (select distinct tool, ecosystem, component, version from fn),
held as (select distinct s.tool, s.ecosystem, s.component, s.version, true as hit
         from spot s join any_range a using (tool, ecosystem, component)
         where {in_range('s.version', 'a.affected_version_range')}),
fn_class as (
  select fn.tool, fn.ord, fn.ecosystem,
         case when same.hit then 'FN_exact' when held.hit then 'FN_range' else 'FN_true' end
           as fn_class
  from fn left join same using (tool, ecosystem, component, version)
          left join held using (tool, ecosystem, component, version))"""

_FP_CLASS = f"""
published as ({{published}}),
fp_class as (
  select fp.tool, fp.ord, fp.ecosystem,
    case when fp.cve is null then 'FP-UNCLEAR'
         when a.cve is null then 'FP-CERTAIN'
         when regexp_matches(lower(fp.description),
              'server|enterprise|appliance|console|controller|management|plugin|rsa archer')
           then 'FP-LIKELY' else 'FP-UNCLEAR' end as fp_class,
    case when fp.cve is null then 'no CVE identifier'
         when a.cve is null then 'CVE is no alias of any advisory of the component'
         when regexp_matches(lower(fp.description), 'console|management|server')
           then 'description names a product' else 'no decisive indicator' end as fp_reason
  from fp left join (select distinct ecosystem, component, cve from published where cve is not null) a
    using (ecosystem, component, cve))"""
_FP_CLASS = _FP_CLASS.replace("{published}", sql("published"))

_COUNTS = """
tallies as (
  select tool, {by}, count(*) filter (kind in ('e', 'r')) as TP,
         count(*) filter (kind = 'f') as FP, count(*) filter (kind = 'n') as FN,
         min(concat(case kind when 'e' then '0' when 'r' then '1' when 'f' then '2' else '3' end,
                    ord)) as seen
  from (select tool, ecosystem, component, ord, case match_type when 'TP_EXACT' then 'e'
               when 'TP_RANGE' then 'r' else 'n' end as kind from m
        union all select tool, ecosystem, component, ord, 'f' from fp) group by tool, {by})"""


def _tallies(by: str) -> str:
    return _COUNTS.replace("{by}", by)


def _top(by: str, measure: str, k: int) -> str:
    return f"""{SCORING}, {_tallies(by)}
select * from (select tool, {by}, TP, FP, FN,
  row_number() over (partition by tool order by {measure} desc, seen) as rank from tallies)
where rank <= {k}"""


_SUMMARY = """gs as (select ecosystem, count(distinct (component, version)) as Components,
  count(*) as Vulnerabilities, count(distinct cve) as CVEs from gt0 group by 1)"""

_RATIO = "round(case when {d} > 0 then {n} / cast({d} as double) else 0 end, 9)"


def _ratio(n: str, d: str) -> str:
    return _RATIO.format(n=n, d=d)


QUERIES = {
    "ecosystem_metrics": (ecosystem_metrics, f"""{SCORING}, {_tallies('ecosystem')}, {_SUMMARY}
select tool, ecosystem, Components, Vulnerabilities, CVEs, TP, FP, FN,
  {_ratio('TP', '(TP + FN)')} as Recall, {_ratio('TP', '(TP + FP)')} as Overlap
from tallies join gs using (ecosystem)"""),
    "match_project_centric": (match_project_centric,
        f"{SCORING} select tool, ord, match_type, finding_ord from m"),
    "false_positives": (false_positives,
        f"{SCORING} select tool, ord, ecosystem, component from fp"),
    "false_negatives": (false_negatives,
        f"{SCORING} select tool, ord, ecosystem, component from m where match_type is null"),
    "fn_taxonomy": (fn_taxonomy, f"{SCORING}, {_FN_CLASS} select tool, ord, fn_class from fn_class"),
    "fp_taxonomy": (fp_taxonomy,
        f"{SCORING}, {_FP_CLASS} select tool, ord, fp_class, fp_reason from fp_class"),
    "fp_tally": (fp_tally,
        f"{SCORING}, {_FP_CLASS} select tool, fp_class, count(*) as n from fp_class group by all"),
    "fp_product": (fp_product, """select doc_id, regexp_matches(lower(text),
  'server|enterprise|appliance|console|controller|management|plugin|rsa archer') as names_product
from documents"""),
    "pair_verdict": (pair_verdict, f"""with {ctes('gt0', 'findings')},
g as (select gt0.*, md5(concat_ws('|', t.tool, gt0.ord)) as found_ord
  from gt0 cross join (select distinct tool from findings) t)
select f.ord, case
  when coalesce(f.cve = g.cve, false) or coalesce(f.osv_id = g.osv_id, false)
  then case when f.version = g.version then 'TP'
            when f.affected_version_range is not null
                 and {in_range('g.version', 'f.affected_version_range')} then 'TP_RANGE'
            else 'FN' end
  else 'FP' end as verdict
from g join findings f on f.ord = g.found_ord"""),
    "gt_summary": (gt_summary, f"with {ctes('gt0')}, {_SUMMARY} select * from gs"),
    "component_outcomes": (component_outcomes,
        f"{SCORING}, {_tallies('ecosystem, component')} select tool, ecosystem, component, TP, FP, FN from tallies"),
    "top_components": (top_components, _top("ecosystem, component", "FN", 10)),
    "top_fp_components": (top_fp_components, _top("ecosystem, component", "FP", 5)),
    "ecosystems_by_fn": (ecosystems_by_fn, _top("ecosystem", "FN", 100)),
    "report_summary": (report_summary, f"""{SCORING},
hits as (select tool, count(*) filter (match_type = 'TP_EXACT') as TP_EXACT,
  count(*) filter (match_type = 'TP_RANGE') as TP_RANGE, count(match_type) as TP,
  count(*) - count(match_type) as FN, count(*) as Vulnerabilities from m group by 1),
extra as (select tool, count(*) as FP from fp group by 1)
select *, {_ratio('TP', 'Vulnerabilities')} as Recall,
  {_ratio('TP_EXACT', 'Vulnerabilities')} as Recall_EXACT, {_ratio('TP', '(TP + FP)')} as Overlap
from hits join extra using (tool)"""),
    "report_matrix": (report_matrix, f"""{SCORING}, {_FN_CLASS}, {_FP_CLASS},
e as (
  select tool, ecosystem, match_type as c from m where match_type is not null
  union all select tool, ecosystem, fn_class from fn_class
  union all select tool, ecosystem, fp_class from fp_class),
sums as (
  select tool, coalesce(ecosystem, 'TOTAL') as ecosystem,
    count(*) filter (c = 'TP_EXACT') as TP_EXACT, count(*) filter (c = 'TP_RANGE') as TP_RANGE,
    count(*) filter (c = 'FN_exact') as FN_EXACT, count(*) filter (c = 'FN_range') as FN_RANGE,
    count(*) filter (c = 'FN_true') as FN_TRUE, count(*) filter (c = 'FP-CERTAIN') as FP_CERTAIN,
    count(*) filter (c = 'FP-LIKELY') as FP_LIKELY, count(*) filter (c = 'FP-UNCLEAR') as FP_UNCLEAR
  from e group by grouping sets ((tool, ecosystem), (tool))),
shape as (
  select coalesce(ecosystem, 'TOTAL') as ecosystem,
    count(distinct (ecosystem, component, version)) as Components, count(*) as Vulnerabilities,
    count(distinct cve) as CVEs from gt0 group by grouping sets ((ecosystem), ())),
w as (select *, TP_EXACT + TP_RANGE as TP, FP_CERTAIN + FP_LIKELY + FP_UNCLEAR as FP,
  FN_EXACT + FN_RANGE + FN_TRUE as FN from sums join shape using (ecosystem))
select *, {_ratio('TP', 'Vulnerabilities')} as Recall,
  {_ratio('TP_EXACT', 'Vulnerabilities')} as Recall_EXACT, {_ratio('TP', '(TP + FP)')} as Overlap
from w"""),
    "gt_osv_summary": (gt_osv_summary, f"""with {ctes('gt0')},
s as (select count(distinct (ecosystem, component, version)) as components,
  count(distinct (ecosystem, component, version, osv_id)) as osv_entries,
  count(distinct cve) as cves from gt0)
select *, {_ratio('cves', 'osv_entries')} as cves_per_entry from s"""),
    "heuristic_quality": (heuristic_quality, f"""{SCORING},
o as (select tool, 'FP' as o, description from fp
      union all select tool, 'TP', description from m where match_type is not null),
h as (select tool, o, regexp_matches(lower(description), 'server|enterprise|console|management') as mark from o),
c as (select tool, count(*) filter (o = 'FP' and mark) as HTP, count(*) filter (o = 'FP' and not mark) as HFN,
  count(*) filter (o = 'TP' and mark) as HFP, count(*) filter (o = 'TP' and not mark) as HTN from h group by 1)
select *, {_ratio('HTP', '(HTP + HFP)')} as heuristic_precision,
  {_ratio('HTP', '(HTP + HFN)')} as heuristic_recall from c"""),
    "dedup_findings": (dedup_findings, f"""with {ctes('findings')}
select ord, tool, ecosystem, version, cve, ghsa, osv_id from (
  select *, row_number() over (partition by tool, ecosystem, component, version,
    coalesce(cve, ghsa, osv_id) order by ord) as rn from findings) where rn = 1"""),
    "findings_for_component": (findings_for_component, f"""with {ctes('findings')}
select ord, tool, cve, ghsa, osv_id from findings
where ecosystem = 'npm' and component = 'pkg-core' and version = '3.1.1'"""),
    "findings_dump": (findings_dump, f"""with {ctes('findings')}
select ecosystem, component as component_name, version as component_version,
  coalesce(osv_id, '-') as vulnerability_id, coalesce(cve, '-') as cve,
  description as vulnerability_description, true as is_vulnerable from findings"""),
    "findings_snapshot": (findings_snapshot, f"""with {ctes('findings')}
select ecosystem, component, version, coalesce(cve, '-') as cve, coalesce(ghsa, '-') as ghsa,
  coalesce(osv_id, '-') as osv_id, coalesce(affected_version_range, '-') as affected_version_range,
  tool as source from findings"""),
}
