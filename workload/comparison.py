"""Queries that compare tools: detections, paired tests, repeated runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmark.operators import drift, metrics, payloads, significance
from siftmark.session import written
from siftmark.sources import ground_truth
from workload.views import MATCH, SCORING, TOOLS, ctes, rounded, sql, table, view, views

RUNS = ["run_1", "run_2", "run_3"]
BASELINE = "oss-index"


def _detections(spark, d):
    return significance.detection_vector(*views(spark, d, "gt0", "findings"), TOOLS)


def detection_vector(spark, d):
    return _detections(spark, d)


def _combined(spark, d):
    """Vectors of two repeats from one match, checked against a list of the runs."""
    gt, f = views(spark, d, "gt0", "findings")
    repeated = f.withColumn("repeat", F.expr("if(description <> '', array(1, 2), array(1))"))
    vectors = significance.run_vectors(gt, repeated, TOOLS, 2)
    manifest = gt.agg(F.count("*").alias("length")).select(
        F.explode(F.array(*[F.lit(t) for t in TOOLS])).alias("tool"), "length"
    ).select("tool", F.explode(F.array(F.lit(1), F.lit(2))).alias("repeat"), "length")
    return significance.combine_vectors(vectors, manifest)


def combined_vectors(spark, d):
    return _combined(spark, d)


def _one_repeat(spark, d):
    return _detections(spark, d).withColumn("repeat", F.lit(1))


def detection_matrix(spark, d):
    return significance.detection_matrix(_one_repeat(spark, d), TOOLS)


def _patterns(spark, d):
    return significance.key_patterns(*views(spark, d, "gt0", "findings"), TOOLS)


def cochran_q(spark, d):
    q = significance.cochran_q(_patterns(spark, d))
    return rounded(q, "statistic", "p_value")


def mcnemar_counts(spark, d):
    return significance.mcnemar_counts(_patterns(spark, d))


def _tests(spark, d):
    return significance.holm(significance.mcnemar(mcnemar_counts(spark, d)))


def mcnemar(spark, d):
    return rounded(significance.mcnemar(mcnemar_counts(spark, d)), "p")


def holm(spark, d):
    return rounded(_tests(spark, d), "p", "p_adj")


def significance_markers(spark, d):
    return significance.significance_markers(_tests(spark, d), BASELINE)


def significance_matrix(spark, d):
    return significance.significance_matrix(_tests(spark, d), TOOLS)


def _runs_and_summary(spark, d):
    """Each finding belongs to one of three runs, told by its description. The summary of the ground
    truth is short and costs a shuffle of all component versions: it is made once."""
    run = (
        F.when(F.col("description").startswith("Enterprise"), "run_1")
        .when(F.col("description") == "Parser flaw", "run_2")
        .otherwise("run_3")
    )
    gt, f = views(spark, d, "gt0", "findings")
    f = f.withColumn("tool", F.concat_ws("/", run, "tool"))
    names = [f"{r}/{t}" for r in RUNS for t in TOOLS]
    summary = written(metrics.gt_summary(gt))
    m = metrics.ecosystem_metrics(gt, f, names, summary=summary)
    runs = m.withColumn("run", F.split_part("tool", F.lit("/"), F.lit(1))).withColumn(
        "tool", F.split_part("tool", F.lit("/"), F.lit(2))
    )
    return runs, summary


def _runs(spark, d):
    return _runs_and_summary(spark, d)[0]


def runs_scan(spark, d):
    """Runs written as result documents and read back."""
    values = ["Components", "Vulnerabilities", "CVEs", "TP", "FP", "FN", "Recall", "Overlap"]
    per_tool = _runs(spark, d).groupBy("run", "tool").agg(
        F.map_from_entries(F.collect_list(F.struct("ecosystem", F.struct(*values)))).alias("e")
    )
    docs = per_tool.groupBy("run").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("tool", "e")))).alias("payload")
    )
    return rounded(ground_truth.run_results(docs), "Recall", "Overlap")


def run_aggregate(spark, d):
    return rounded(metrics.run_aggregate(_runs(spark, d)), "mean", "std", "ci95")


def collapse_repeats(spark, d):
    return rounded(metrics.collapse_repeats(_runs(spark, d)), "value")


def payload_statistics(spark, d):
    """The statistics as one JSON document, read back."""
    document = payloads.statistics_payload(metrics.run_aggregate(_runs(spark, d)))
    values = "struct<mean: double, std: double, n: bigint, ci95: double>"
    read = document.select(F.from_json("payload", f"struct<metrics: map<string, map<string, map<string, {values}>>>>")["metrics"].alias("m"))
    rows = read.select(F.explode("m").alias("tool", "e")).select("tool", F.explode("e").alias("ecosystem", "x"))
    rows = rows.select("tool", "ecosystem", F.explode("x").alias("metric", "v")).select("tool", "ecosystem", "metric", "v.*")
    return rounded(rows, "mean", "std", "ci95")


def payload_results(spark, d):
    """Collapsed results as one JSON document, read back."""
    document = payloads.results_payload(metrics.collapse_repeats(_runs(spark, d)))
    read = document.select(F.explode(F.from_json("payload", "map<string, map<string, map<string, double>>>")).alias("tool", "e"))
    rows = read.select("tool", F.explode("e").alias("ecosystem", "x"))
    return rounded(rows.select("tool", "ecosystem", F.explode("x").alias("metric", "value")), "value")


def tool_table(spark, d):
    return rounded(metrics.tool_table(*_runs_and_summary(spark, d)), "Recall", "Overlap")


def ecosystem_summary(spark, d):
    return rounded(metrics.ecosystem_summary(*_runs_and_summary(spark, d)), "Recall", "Overlap")


_TOTALS = ["mean_recall", "mean_overlap", "total_tp", "total_fp", "total_fn"]


def tool_summary(spark, d):
    return rounded(metrics.tool_summary(_runs(spark, d)), *_TOTALS)


def tool_ranking(spark, d):
    summary = metrics.tool_summary(_runs(spark, d)).drop("rank")
    return metrics.tool_ranking(summary).select("tool", "rank")


def tool_deltas(spark, d):
    out = metrics.tool_deltas(metrics.tool_summary(_runs(spark, d)))
    return rounded(out, *[f"delta_{c}" for c in _TOTALS])


def call_stats(spark, d):
    calls = table(spark, d, "events").select(
        F.col("event_type").alias("api"), F.col("value").alias("duration_ms")
    )
    return metrics.call_stats(calls).select(
        "api", "calls", F.round("total_ms", 3).alias("total_ms"), F.round("avg_ms", 6).alias("avg_ms")
    )


def repeat_stability(spark, d):
    f = view(spark, d, "findings")
    changed = (F.col("tool") == "trivy") & (F.col("description") == "Parser flaw")
    again = f.withColumn("cve", F.when(~changed, F.col("cve")))
    both = f.withColumn("repeat", F.lit(1)).unionByName(again.withColumn("repeat", F.lit(2)))
    return drift.repeat_stability(both)


_VECTOR = """
keyed as (select *, coalesce(cve, osv_id, '') as vuln_id from m),
vector as (
  select tool, ord, case when row_number() over (partition by tool, ecosystem, component, version, vuln_id
      order by ord) <= count(match_type) over (partition by tool, ecosystem, component, version, vuln_id)
    then 1 else 0 end as detected from keyed)"""
_PAIRS = """
pairs as (
  select a.tool as tool_a, b.tool as tool_b,
    count(*) filter (a.detected = 1 and b.detected = 0) as n10,
    count(*) filter (a.detected = 0 and b.detected = 1) as n01
  from vector a join vector b on a.ord = b.ord and a.tool < b.tool group by all)"""
# log n! by running sums gives the binomial tail in logs.
_TEST = """
ns as (select unnest(range(0, cast((select max(n10 + n01) from pairs) + 1 as bigint))) as i),
lf as (select i, sum(case when i > 0 then ln(i) else 0 end) over (order by i) as lf from ns),
tail as (
  select tool_a, tool_b, sum(exp(n.lf - a.lf - b.lf - (n10 + n01) * ln(2.0))) as half
  from pairs, lf n, lf a, lf b
  where n.i = n10 + n01 and a.i <= least(n10, n01) and b.i = n10 + n01 - a.i group by all),
tests as (
  select p.*, case when n10 + n01 = 0 then 1.0 else least(1.0, 2 * half) end as p
  from pairs p join tail using (tool_a, tool_b)),
adjusted as (
  select *, least(1.0, (count(*) over () - row_number() over (order by p, tool_a, tool_b) + 1) * p)
    as p_adj from tests)"""
_V = f"{SCORING}, {_VECTOR}"

_RUN_FINDINGS = f"""(select * replace (concat(case when starts_with(description, 'Enterprise') then 'run_1'
  when description = 'Parser flaw' then 'run_2' else 'run_3' end, '/', tool) as tool)
from ({sql('findings')}))"""
_RUNS = f"""with {ctes('gt0')}, findings as {_RUN_FINDINGS},
{MATCH},
gs as (select ecosystem, count(distinct (component, version)) as Components,
  count(*) as Vulnerabilities, count(distinct cve) as CVEs from gt0 group by 1),
c as (select tool, ecosystem, count(match_type) as TP, count(*) - count(match_type) as FN
      from m group by all),
x as (select tool, ecosystem, count(*) as FP from fp group by all),
runs as (
  select split_part(c.tool, '/', 1) as run, split_part(c.tool, '/', 2) as tool, ecosystem,
    Components, Vulnerabilities, CVEs, TP, coalesce(FP, 0) as FP, FN,
    case when TP + FN > 0 then TP / (TP + FN) else 0 end as Recall,
    case when TP + coalesce(FP, 0) > 0 then TP / (TP + coalesce(FP, 0)) else 0 end as Overlap
  from c left join x using (tool, ecosystem) join gs using (ecosystem)),
means as (select tool, ecosystem, avg(TP) as TP, avg(FP) as FP, avg(FN) as FN,
  avg(Recall) as Recall, avg(Overlap) as Overlap from runs group by all),
totals as (select tool, avg(Recall) as mean_recall, avg(Overlap) as mean_overlap, sum(TP) as total_tp,
  sum(FP) as total_fp, sum(FN) as total_fn from means group by all)"""
_LONG = """long as (unpivot (select run, tool, ecosystem, {cols} from runs)
  on {names} into name metric value value)"""


def _long(*names: str) -> str:
    cols = ", ".join(f"cast({n} as double) as {n}" for n in names)
    return _LONG.format(cols=cols, names=", ".join(names))


def _digest(source: str, by: str) -> str:
    """SQL form of the summed content hash."""
    parts = ", ".join(
        f"sum(cast(concat('0x', substr(h, {8 * i + 1}, 8)) as bigint)) as s{i}" for i in range(8)
    )
    joined = ", '|', ".join(["count(*)", *[f"s{i}" for i in range(8)]]).replace("count(*)", "n_rows")
    return f"""hashed as (
  select {by}, sha256(concat('["', ecosystem, '","', component, '","', version, '","',
    coalesce(cve, osv_id, ''), '"]')) as h from {source}),
summed as (select {by}, count(*) as n_rows, {parts} from hashed group by all),
prints as (select {by}, n_rows, sha256(concat({joined})) as fingerprint from summed)"""


def content_hash(spark, d):
    return drift.fingerprint(view(spark, d, "gt0"), ["ecosystem"])


QUERIES = {
    "detection_vector": (detection_vector, f"{_V} select * from vector"),
    "combined_vectors": (combined_vectors, f"""select *, 1 as repeat from ({_V} select * from vector)
union all
select *, 2 as repeat from (with {ctes('gt0')}, findings as (select * from ({sql('findings')}) where description <> ''),
{MATCH}, {_VECTOR} select * from vector)"""),
    "detection_matrix": (detection_matrix, f"""{_V}
select 1 as repeat, ord as gt_ord, max(detected) filter (tool = 'github') as github,
  max(detected) filter (tool = 'oss-index') as "oss-index",
  max(detected) filter (tool = 'trivy') as trivy from vector group by ord"""),
    "cochran_q": (cochran_q, f"""{_V},
cs as (select tool, cast(sum(detected) as double) as c from vector group by 1),
rs as (select ord, cast(sum(detected) as double) as r from vector group by 1),
q as (select 2 * (3 * (select sum(c * c) from cs) - power((select sum(c) from cs), 2))
  / (3 * (select sum(r) from rs) - (select sum(r * r) from rs)) as q)
select round(q, 9) as statistic, 2 as df, round(exp(-q / 2), 9) as p_value from q"""),
    "mcnemar_counts": (mcnemar_counts, f"{_V}, {_PAIRS} select * from pairs"),
    "mcnemar": (mcnemar, f"{_V}, {_PAIRS}, {_TEST} select tool_a, tool_b, n10, n01, round(p, 9) as p from tests"),
    "holm": (holm, f"""{_V}, {_PAIRS}, {_TEST}
select tool_a, tool_b, n10, n01, round(p, 9) as p, round(p_adj, 9) as p_adj from adjusted"""),
    "significance_markers": (significance_markers, f"""{_V}, {_PAIRS}, {_TEST}
select distinct case when tool_a = '{BASELINE}' then tool_b else tool_a end as tool, '*' as marker
from adjusted where p_adj < 0.05 and ((tool_a = '{BASELINE}' and n01 > n10)
  or (tool_b = '{BASELINE}' and n10 > n01))"""),
    "significance_matrix": (significance_matrix, f"""{_V}, {_PAIRS}, {_TEST},
cells as (select tool_a as tool, tool_b as other,
    case when p_adj < 0.05 then '*' else format('{{:.2f}}', p_adj) end as label from adjusted
  union all select distinct tool, tool, '-' from vector)
select tool, coalesce(max(label) filter (other = 'github'), '') as github,
  coalesce(max(label) filter (other = 'oss-index'), '') as "oss-index",
  coalesce(max(label) filter (other = 'trivy'), '') as trivy from cells group by 1"""),
    "runs_scan": (runs_scan, f"""{_RUNS} select * replace (round(Recall, 9) as Recall,
  round(Overlap, 9) as Overlap) from runs"""),
    "run_aggregate": (run_aggregate, f"""{_RUNS}, {_long('TP', 'FP', 'FN', 'Recall', 'Overlap')},
s as (select tool, ecosystem, metric, avg(value) as mean, stddev_pop(value) as std, count(*) as n
  from long group by all)
select tool, ecosystem, metric, round(mean, 9) as mean, round(std, 9) as std, n,
  round(case when n > 1 then 1.96 * std / sqrt(n) else 0 end, 9) as ci95 from s"""),
    "collapse_repeats": (collapse_repeats, f"""{_RUNS},
{_long('TP', 'FP', 'FN', 'Components', 'Vulnerabilities', 'CVEs', 'Recall', 'Overlap')}
select tool, ecosystem, metric, round(avg(value), 9) as value from long group by all"""),
    "tool_table": (tool_table, f"""{_RUNS}
select tool, coalesce(ecosystem, 'TOTAL') as ecosystem, sum(Components) as Components,
  sum(Vulnerabilities) as Vulnerabilities, sum(CVEs) as CVEs, cast(floor(sum(TP)) as bigint) as TP,
  cast(floor(sum(FP)) as bigint) as FP, cast(floor(sum(FN)) as bigint) as FN,
  round(avg(Recall), 9) as Recall, round(avg(Overlap), 9) as Overlap
from means join gs using (ecosystem) group by grouping sets ((tool, ecosystem), (tool))"""),
    "ecosystem_summary": (ecosystem_summary, f"""{_RUNS},
per as (select ecosystem, sum(TP) as TP, sum(FP) as FP, sum(FN) as FN, avg(Recall) as Recall,
  avg(Overlap) as Overlap from means group by 1),
e as (select * from per join (select ecosystem, Components, Vulnerabilities from gs) using (ecosystem))
select coalesce(ecosystem, 'TOTAL') as ecosystem, sum(Components) as Components,
  sum(Vulnerabilities) as Vulnerabilities, cast(floor(sum(TP)) as bigint) as TP,
  cast(floor(sum(FP)) as bigint) as FP, cast(floor(sum(FN)) as bigint) as FN,
  round(avg(Recall), 9) as Recall, round(avg(Overlap), 9) as Overlap
from e group by grouping sets ((ecosystem), ())"""),
    "tool_summary": (tool_summary, f"""{_RUNS}
select tool, round(mean_recall, 9) as mean_recall, round(mean_overlap, 9) as mean_overlap,
  round(total_tp, 9) as total_tp, round(total_fp, 9) as total_fp, round(total_fn, 9) as total_fn,
  row_number() over (order by mean_recall desc, tool) as rank from totals"""),
    "tool_ranking": (tool_ranking, f"""{_RUNS}
select tool, row_number() over (order by mean_recall desc, mean_overlap desc, tool) as rank from totals"""),
    "tool_deltas": (tool_deltas, f"""{_RUNS}
select a.tool as tool_a, b.tool as tool_b,
  {", ".join(f"round(a.{c} - b.{c}, 9) as delta_{c}" for c in _TOTALS)}
from totals a join totals b on a.tool < b.tool"""),
    "call_stats": (call_stats, """select coalesce(event_type, 'TOTAL') as api, count(*) as calls,
  round(sum(value), 3) as total_ms, round(avg(value), 6) as avg_ms
from events group by grouping sets ((event_type), ())"""),
    "content_hash": (content_hash, f"""with {ctes('gt0')}, {_digest('gt0', 'ecosystem')}
select ecosystem, n_rows, fingerprint from prints"""),
    "repeat_stability": (repeat_stability, f"""with {ctes('findings')},
both_runs as (select *, 1 as repeat from findings union all
  select * replace (case when tool = 'trivy' and description = 'Parser flaw' then null else cve end as cve),
    2 as repeat from findings),
{_digest('both_runs', 'tool, repeat')}
select tool, count(distinct fingerprint) = 1 as stable,
  string_agg(fingerprint, ',' order by repeat) as fingerprints from prints group by 1"""),
}
QUERIES["payload_statistics"] = (payload_statistics, QUERIES["run_aggregate"][1])
QUERIES["payload_results"] = (payload_results, QUERIES["collapse_repeats"][1])
