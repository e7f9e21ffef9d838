"""Ground truth, findings and releases derived from whole driver tables.

The same SELECT runs in Spark (as the query input) and in DuckDB (inside the checking
SQL); only the word for row generation differs. A third of all rows belong to one
package, so every query meets a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.session import written

TOOLS = ["github", "oss-index", "trivy"]

ORD = (
    "md5(concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), "
    "cast(l_partkey as string), cast(l_suppkey as string), "
    "cast(cast(round(l_extendedprice * 100) as bigint) as string)))"
)
ECO = (
    "case when l_suppkey % 3 = 0 then 'npm' when l_partkey % 4 = 0 then 'maven' "
    "when l_partkey % 4 = 1 then 'npm' when l_partkey % 4 = 2 then 'nuget' else 'pypi' end"
)
COMPONENT = (
    "case when l_suppkey % 3 = 0 then 'pkg-core' "
    "else concat('pkg-', cast(l_partkey as string)) end"
)
VERSION_TAIL = (
    "concat('.', cast(l_suppkey % 5 as string), '.', cast(l_partkey % 3 as string), "
    "case when l_orderkey % 11 = 0 then 'rc1' else '' end)"
)
VERSION = f"concat(cast(l_linenumber as string), {VERSION_TAIL})"
CVE = "case when l_orderkey % 10 < 9 then concat('CVE-2024-', cast(l_orderkey % 60 as string)) end"
OSV = "concat('OSV-', cast(l_orderkey % 90 as string))"

GT0 = f"""
select *, case when ord < '8' then concat('pkg:', ecosystem, '/', component, '@', version) end as purl
from (
  select {ORD} as ord, {ECO} as ecosystem, {COMPONENT} as component, {VERSION} as version,
         {CVE} as cve, cast(null as string) as ghsa, {OSV} as osv_id,
         case when l_returnflag = 'R' then 'Admin console of the server is exposed'
              when l_returnflag = 'A' then 'Parser flaw' else '' end as description
  from lineitem) g
"""

# Snapshot 1: late shipments only, some ids changed, some rows doubled.
GT1 = f"""
select concat({ORD}, '-', cast(copy as string)) as ord, {ECO} as ecosystem,
       {COMPONENT} as component, {VERSION} as version,
       case when l_orderkey % 97 = 0 then concat('CVE-2025-', cast(l_orderkey % 60 as string))
            else {CVE} end as cve,
       cast(null as string) as ghsa, {OSV} as osv_id
from (select *, {{each}}(case when l_orderkey % 89 = 0 then {{array}}(0, 1) else {{array}}(0) end)
             as copy
      from lineitem where l_shipdate >= date '1995-02-01') l
"""

# What advisories say: all shipments, the early ones under an older name of the package.
PUBLISHED = GT1.replace(
    f"{COMPONENT} as component",
    f"case when l_shipdate < date '1995-02-01' then concat('old-', {COMPONENT}) else {COMPONENT} end as component",
).replace("from lineitem where l_shipdate >= date '1995-02-01'", "from lineitem")

FINDINGS = f"""
select md5(concat_ws('|', tool, ord0)) as ord, tool, ecosystem, component, version, cve, ghsa,
       osv_id, affected_version_range, description
from (
  select {ORD} as ord0,
         case k when 0 then 'github' when 1 then 'oss-index' else 'trivy' end as tool,
         {ECO} as ecosystem, {COMPONENT} as component,
         concat(cast(case when (l_orderkey + k) % 5 = 0 then l_linenumber + 10
                          else l_linenumber end as string), {VERSION_TAIL}) as version,
         case when (l_orderkey + l_partkey + k) % 7 = 0
                then concat('CVE-2020-', cast(l_orderkey % 60 as string))
              when l_orderkey % 10 < 8
                then concat('CVE-2024-', cast(l_orderkey % 60 as string)) end as cve,
         case when (l_orderkey + k) % 13 = 0
                then concat('GHSA-', cast(l_orderkey % 50 as string)) end as ghsa,
         case when l_orderkey % 10 >= 8 then {OSV} end as osv_id,
         case when l_orderkey % 101 = 0 then '[1.0,2.0)'
              when l_orderkey % 103 = 0 then '<abc'
              when l_orderkey % 3 = 0
                then concat('>=1.0.0,<', cast(1 + l_suppkey % 7 as string), '.0.0') end
           as affected_version_range,
         case when l_returnflag = 'R' then 'Enterprise Management Console'
              when l_returnflag = 'A' then 'Parser flaw' else '' end as description
  from (select *, {{each}}({{array}}(0, 1, 2)) as k from lineitem) l) x
"""

RELEASES = f"""
select ecosystem, component as package, version, min(published) as published
from (select {ECO} as ecosystem, {COMPONENT} as component, {VERSION} as version,
             l_shipdate as published from lineitem) r
group by ecosystem, component, version
"""

_TEXTS = {"gt0": GT0, "gt1": GT1, "published": PUBLISHED, "findings": FINDINGS, "releases": RELEASES}


def sql(name: str) -> str:
    """The view's SELECT for DuckDB."""
    return _TEXTS[name].format(each="unnest", array="list_value").strip()


def ctes(*names: str) -> str:
    """``name as (...)`` for each view, for a WITH clause."""
    return ",\n".join(f"{n} as ({sql(n)})" for n in names)


#: A task derives what it makes from about so many rows of a table.
TASK_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.

    Its file may have one row group, which one task reads whatever its size, so the rows are dealt
    out once before anything is derived from them, to more tasks the more rows there are. The
    count reads no column. Random places need no sort, which a deal in turns does in the one task.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.repartition(_tasks(spark, rows.count()), F.rand(17))


def _tasks(spark: SparkSession, n_rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in ``sf_dir``."""
    return _over(spark, name, table(spark, sf_dir, "lineitem"))


def _over(spark: SparkSession, name: str, lineitem: DataFrame) -> DataFrame:
    text = _TEXTS[name].format(each="explode", array="array")
    text = text.replace("from lineitem", "from {lineitem}")
    return spark.sql(text, lineitem=lineitem)


_READ = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"]


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of lineitem that views read, dealt out by writing them once.

    Files have as many rows as a task takes, which needs no shuffle; a query that reads its views
    many times reads those.
    """
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_READ)
    n = lineitem.count()
    return written(lineitem, -(-n // _tasks(spark, n)))


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Several views over one table that is ``dealt`` out."""
    return views_over(dealt(spark, sf_dir), *names)


def views_over(lineitem: DataFrame, *names: str) -> list[DataFrame]:
    return [_over(lineitem.sparkSession, n, lineitem) for n in names]


def rows(spark: SparkSession, sf_dir: str, often: bool = False) -> DataFrame:
    """Snapshot 0 in the columns of the ground-truth build, for a query that reads it once or ``often``."""
    gt = views(spark, sf_dir, "gt0")[0] if often else view(spark, sf_dir, "gt0")
    return gt.select(
        "ord",
        "ecosystem",
        F.col("component").alias("component_name"),
        F.col("version").alias("component_version"),
        "purl",
        F.col("osv_id").alias("vulnerability_id"),
        "cve",
        F.col("description").alias("vulnerability_description"),
    )


ROWS = (
    "select ord, ecosystem, component as component_name, version as component_version, purl, "
    "osv_id as vulnerability_id, cve, description as vulnerability_description from gt0"
)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to nine places, so that summation order does not show."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


# --- checking SQL shared by the scoring queries -----------------------------------

# Versions are L.S.P with an optional rc1, so a list of numbers orders them.
VKEY = (
    "list_value(cast(split_part({v}, '.', 1) as int), cast(split_part({v}, '.', 2) as int), "
    "cast(regexp_extract(split_part({v}, '.', 3), '^[0-9]+') as int), "
    "case when contains({v}, 'rc') then 0 else 1 end)"
)


def vkey(column: str) -> str:
    return VKEY.format(v=column)


def in_range(version: str, expr: str) -> str:
    """Dialect-A verdict for the three range shapes that occur in ``findings``."""
    return (
        f"(case when {expr} = '[1.0,2.0)' then true when {expr} = '<abc' then false "
        f"else {vkey(version)} >= [1, 0, 0, 1] and {vkey(version)} < "
        f"[cast(regexp_extract({expr}, '<([0-9]+)', 1) as int), 0, 0, 1] end)"
    )


MATCH = f"""
gt_ids as (
  select * from (select ord, ecosystem, component, version,
                        unnest(list_value(cve, osv_id)) as id from gt0) where id is not null),
f_ids as (
  select * from (select ord, tool, ecosystem, component, version, affected_version_range,
                        unnest(list_value(cve, ghsa, osv_id)) as id from findings)
  where id is not null),
exact_hit as (
  select f.tool, g.ord, min(f.ord) as finding_ord
  from gt_ids g join f_ids f using (ecosystem, component, version, id) group by all),
spans as (
  select tool, ecosystem, component, id, affected_version_range, min(ord) as ord
  from f_ids where affected_version_range is not null group by all),
range_hit as (
  select f.tool, g.ord, min(f.ord) as finding_ord
  from gt_ids g join spans f using (ecosystem, component, id)
  where {in_range('g.version', 'f.affected_version_range')} group by all),
m as (
  select t.tool, g.*, case when e.ord is not null then 'TP_EXACT'
                           when r.ord is not null then 'TP_RANGE' end as match_type,
         coalesce(e.finding_ord, r.finding_ord) as finding_ord
  from gt0 g cross join (select distinct tool from findings) t
  left join exact_hit e on e.tool = t.tool and e.ord = g.ord
  left join range_hit r on r.tool = t.tool and r.ord = g.ord),
fp as (
  select f.* from findings f
  anti join (select tool, finding_ord from m where finding_ord is not null) c
    on c.tool = f.tool and c.finding_ord = f.ord)"""

SCORING = f"with {ctes('gt0', 'findings')},\n{MATCH}"
