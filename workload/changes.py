"""Queries on the change between two ground-truth snapshots."""

from __future__ import annotations

from siftmark.operators import drift
from workload.views import ctes, rounded, view


def _counts(spark, d):
    return drift.key_counts(view(spark, d, "gt0"), view(spark, d, "gt1"))


def diff_added(spark, d):
    return drift.added(_counts(spark, d))


def diff_removed(spark, d):
    return drift.removed(_counts(spark, d))


def diff_jaccard(spark, d):
    return rounded(drift.jaccard(_counts(spark, d)), "jaccard")


def diff_summary(spark, d):
    return rounded(drift.diff_summary(_counts(spark, d)), "jaccard")


def diff_by_ecosystem(spark, d):
    return drift.diff_by_ecosystem(_counts(spark, d))


def diff_examples(spark, d):
    return drift.diff_examples(view(spark, d, "gt0"), view(spark, d, "gt1"))


_K = "ecosystem, component, version, coalesce(cve, osv_id, '') as vuln_id"
_SETS = f"""with {ctes('gt0', 'gt1')},
a as (select {_K} from gt0), b as (select {_K} from gt1),
added as (select * from b except all select * from a),
removed as (select * from a except all select * from b),
shared as (select * from a intersect select * from b),
united as (select * from a union select * from b)"""

QUERIES = {
    "diff_added": (diff_added, f"{_SETS} select * from added"),
    "diff_removed": (diff_removed, f"{_SETS} select * from removed"),
    "diff_jaccard": (diff_jaccard, f"""{_SETS}, n as (select (select count(*) from shared) as shared,
  (select count(*) from united) as united) select *, round(shared / united, 9) as jaccard from n"""),
    "diff_summary": (diff_summary, f"""{_SETS}, n as (
select (select count(*) from a) as gt0_total_rows, (select count(*) from b) as gt1_total_rows,
  (select count(*) from (select distinct * from a)) as gt0_unique,
  (select count(*) from (select distinct * from b)) as gt1_unique,
  (select count(*) from shared) as shared_unique, (select count(*) from united) as united,
  (select count(*) from added) as added_rows, (select count(*) from removed) as removed_rows)
select * exclude (united), gt1_total_rows - gt0_total_rows as net_row_delta,
  added_rows = 0 and removed_rows = 0 as equal, round(shared_unique / united, 9) as jaccard from n"""),
    "diff_by_ecosystem": (diff_by_ecosystem, f"""{_SETS},
u as (select 'added' as side, * from added union all select 'removed', * from removed)
select side, ecosystem, count(*) as rows, count(distinct (component, version)) as unique_components,
  count(distinct case when vuln_id <> '' then vuln_id end) as unique_vuln_ids from u group by all"""),
    "diff_examples": (diff_examples, f"""{_SETS},
seen as (select {_K}, min(ord) as seen from gt1 group by all),
numbered as (select *, row_number() over (partition by ecosystem, component, version, vuln_id) as copy
  from added)
select ecosystem, component, version, vuln_id, copy
from numbered join seen using (ecosystem, component, version, vuln_id)
order by seen, copy limit 25"""),
}
