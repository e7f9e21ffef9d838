"""Paired tests on what each tool detects.

Detections are long: tool, repeat, gt_ord, detected (0/1). All tests need only how
often each pattern of tools over one ground-truth row occurs; those counts combine
before the shuffle and number at most two to the power of the tools.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmark.operators.matching import (
    PACKAGE,
    by_package,
    crowded,
    for_each_tool,
    matched_by_axis,
    not_dealt,
    parsed_texts,
    said_by_pairs,
    with_signature,
)
from siftmark.operators.metrics import ordered_pairs
from siftmark.operators.ranking import row_number_within
from siftmark.functions.identity import preferred_id
from siftmark.functions.text import packed, unpacked
from siftmark.session import written

VECTOR_KEY = ["ecosystem", "component", "version", "vuln_id"]


def detection_vector(gt: DataFrame, findings: DataFrame, tools: list[str]) -> DataFrame:
    """0/1 per tool and ground-truth row; hits of a key mark the key's first rows."""
    return run_vectors(gt, findings.withColumn("repeat", F.array(F.lit(1))), tools, 1).drop("repeat")


def run_vectors(gt: DataFrame, findings: DataFrame, tools: list[str], repeats: int) -> DataFrame:
    """The vectors of all tools and repeats (1, 2, ...): tool, repeat, ord, detected.

    ``findings`` list the repeats that report them in ``repeat``. Rows and findings of small
    packages are dealt out once, and a key's rows are numbered in the task that matches its package;
    copies for repeats and tools are made behind that.
    """
    crowd = crowded(gt, findings)
    texts = written(parsed_texts(findings))
    each_run = lambda df: df.withColumn("repeat", F.explode("repeat"))
    # Only whether a tool finds a signature is asked, not which finding it chooses.
    found = findings.withColumn("ord", F.lit(""))
    said = said_by_pairs(
        by_package(gt, crowd), each_run(by_package(found, crowd)), ["tool", "repeat"], texts, "ord"
    )
    runs = [(t, r + 1) for t in tools for r in range(repeats)]
    hit = lambda t, r: F.exists("said", lambda v: (v["tool"] == t) & (v["repeat"] == r))
    keys = _keyed(said).groupBy(*VECTOR_KEY).agg(
        F.sort_array(F.flatten(F.collect_list("rows.ord"))).alias("ords"),
        *[F.sum(F.when(hit(*run), F.col("n_rows")).otherwise(0)).alias(f"_hits{i}") for i, run in enumerate(runs)],
    )
    marked = keys.select(F.posexplode("ords").alias("place", "ord"), *[f"_hits{i}" for i in range(len(runs))])
    small = marked.select("ord", F.inline(F.array(*[
        F.struct(F.lit(t).alias("tool"), F.lit(r).alias("repeat"),
                 F.when(F.col("place") < F.col(f"_hits{i}"), 1).otherwise(0).alias("detected"))
        for i, (t, r) in enumerate(runs)
    ]))).select("tool", "repeat", "ord", "detected")
    rest = not_dealt(gt, crowd)
    if crowd.isEmpty():
        # Rows without a package, which nothing finds.
        return small.unionByName(_each_run(rest, tools, repeats).select(
            "tool", "repeat", "ord", F.lit(0).alias("detected")))
    hits = matched_by_axis(rest.dropna(subset=PACKAGE), each_run(found.join(crowd, PACKAGE)), ["tool", "repeat"])
    return small.unionByName(detection_vectors(rest, hits, tools, repeats))


def _each_run(rows: DataFrame, tools: list[str], repeats: int) -> DataFrame:
    return for_each_tool(rows, tools).withColumn("repeat", F.explode(_numbers(repeats)))


def detection_vectors(gt: DataFrame, matched: DataFrame, tools: list[str], repeats: int) -> DataFrame:
    """The vectors of all tools and repeats (1, 2, ...) from one match with owners tool, repeat.

    A key with no hit is all 0 and a key with as many hits as rows is all 1; only keys in
    between need their rows numbered.
    """
    run = F.struct("tool", "repeat")
    said = _hits_per_key(matched).groupBy(*VECTOR_KEY).agg(
        F.map_from_entries(F.collect_list(F.struct(run, "n_hits"))).alias("said")
    )
    uneven = F.exists(F.map_values("said"), lambda n: n < F.col("n_rows"))
    tally = said.join(_rows_per_key(gt), VECTOR_KEY).withColumn("uneven", uneven)
    # Rows join once, with what all runs say of their key, and are copied afterwards.
    rows = _keyed(gt).select("ord", *VECTOR_KEY).join(tally, VECTOR_KEY, "left")
    partial = F.coalesce("uneven", F.lit(False))
    places = row_number_within(rows.where(partial), VECTOR_KEY, "ord", "place")
    marked = rows.where(~partial).select("ord", "said", F.lit(1).cast("bigint").alias("place")).unionByName(
        places.select("ord", "said", F.col("place").cast("bigint"))
    )
    n_hits = F.coalesce(F.try_element_at("said", run), F.lit(0))
    return _each_run(marked, tools, repeats).select(
        "tool", "repeat", "ord", F.when(F.col("place") <= n_hits, 1).otherwise(0).alias("detected")
    )


def _numbers(repeats: int) -> Column:
    return F.array(*[F.lit(i + 1) for i in range(repeats)])


def _keyed(gt: DataFrame) -> DataFrame:
    return with_signature(gt).withColumn("vuln_id", preferred_id(F.col("cve"), F.col("osv_id")))


def _rows_per_key(gt: DataFrame) -> DataFrame:
    return _keyed(gt).groupBy(*VECTOR_KEY).agg(F.count("*").alias("n_rows"))


def _hits_per_key(matched: DataFrame) -> DataFrame:
    return _keyed(matched).groupBy("tool", "repeat", *VECTOR_KEY).agg(F.sum("n_rows").alias("n_hits"))


def key_patterns(gt: DataFrame, findings: DataFrame, tools: list[str]) -> DataFrame:
    """What ``patterns`` gives for the vectors of ``detection_vector``, without making them."""
    crowd = crowded(gt, findings)
    texts = written(parsed_texts(findings))
    # Only whether a tool finds a signature is asked, not which finding it chooses.
    found = by_package(findings.withColumn("ord", F.lit("")), crowd)
    said = said_by_pairs(by_package(gt, crowd), found, ["tool"], texts)
    hit = lambda t: F.exists("said", lambda v: v["tool"] == t)
    # Keys lie inside packages, so counting them shuffles nothing either.
    keys = _keyed(said).groupBy(*VECTOR_KEY).agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.sum(F.when(hit(t), F.col("n_rows")).otherwise(0)).alias(f"_hits{i}") for i, t in enumerate(tools)],
    )
    listed = F.map_from_arrays(
        F.array(*[F.lit(t) for t in tools]), F.array(*[F.col(f"_hits{i}") for i in range(len(tools))])
    )
    small = _pattern_counts(keys.withColumn("said", listed), tools)
    rest = not_dealt(gt, crowd)
    hits = matched_by_axis(rest.dropna(subset=PACKAGE), findings.join(crowd, PACKAGE), ["tool"])
    large = run_patterns(rest, hits.withColumn("repeat", F.lit(1)), tools, 1)
    return small.unionByName(large).groupBy("pattern").agg(F.sum("n").alias("n"))


def run_patterns(gt: DataFrame, matched: DataFrame, tools: list[str], repeats: int) -> DataFrame:
    """The pattern counts of all repeats together, from one match with owners tool, repeat.

    Hits mark the first rows of a key, so with n rows and h hits of each tool the rows between
    two neighbouring values of h (and n) all have one pattern: a key has at most one more
    pattern than there are tools, and no row is numbered or shuffled.
    """
    said = _hits_per_key(matched).groupBy("repeat", *VECTOR_KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("tool", "n_hits"))).alias("said")
    )
    keys = _rows_per_key(gt).withColumn("repeat", F.explode(_numbers(repeats))).join(
        said, ["repeat", *VECTOR_KEY], "left"
    )
    return _pattern_counts(keys, tools)


def _pattern_counts(keys: DataFrame, tools: list[str]) -> DataFrame:
    """``keys``: n_rows, and ``said``, a map from tool to its number of hits."""
    n, tools = F.col("n_rows"), sorted(tools)
    marked = {t: F.least(n, F.coalesce(F.try_element_at("said", F.lit(t)), F.lit(0))) for t in tools}
    ends = F.array_sort(F.array_distinct(F.array(*marked.values(), n)))
    parts = keys.select(
        F.struct(*[c.alias(t) for t, c in marked.items()]).alias("h"), F.posexplode(ends).alias("i", "end"), ends.alias("ends")
    ).withColumn("start", F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(F.lit(0)))
    pattern = F.array(*[
        F.struct(F.lit(t).alias("tool"), (F.col("h").getField(t) >= F.col("end")).cast("int").alias("detected"))
        for t in tools
    ])
    return (
        parts.where("end > start").groupBy(pattern.alias("pattern"))
        .agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    )


def watched_runs(df: DataFrame, runs: list[tuple[str, int]]) -> tuple[DataFrame, Callable[[], dict]]:
    """The same rows, and how many of them each (tool, repeat) had, to be asked for when an
    action has read them: the counts are made in its pass."""
    seen = Observation()
    counts = [
        F.count_if((F.col("tool") == tool) & (F.col("repeat") == repeat)).alias(f"run{i}")
        for i, (tool, repeat) in enumerate(runs)
    ]
    watched = df.observe(seen, F.count(F.lit(1)).alias("all"), *counts)
    return watched, lambda: {None: seen.get["all"]} | {r: seen.get[f"run{i}"] for i, r in enumerate(runs)}


def combine_vectors(detections: DataFrame, manifest: DataFrame) -> DataFrame:
    """Detection vectors of archived runs (tool, repeat, ord, detected), written and checked.

    ``manifest`` says what there has to be: a row (tool, repeat, length) for each run, which is
    a short list. Lengths are counted while the vectors are written. Raises for a run without a
    vector, one of another length, and rows of no run in the manifest.
    """
    expected = {(r["tool"], r["repeat"]): r["length"] for r in manifest.select("tool", "repeat", "length").collect()}
    watched, counted = watched_runs(detections, list(expected))
    out = written(watched)
    seen = counted()
    lacking = sorted(r for r in expected if seen[r] == 0 and expected[r])
    if lacking:
        raise ValueError(f"no detections of {lacking}")
    uneven = sorted(r for r in expected if seen[r] != expected[r])
    if uneven:
        raise ValueError(f"detections of another length: {[(*r, seen[r], expected[r]) for r in uneven]}")
    if seen[None] != sum(expected.values()):
        raise ValueError("detections of runs that the manifest does not list")
    return out


def detection_matrix(detections: DataFrame, tools: list[str]) -> DataFrame:
    """One row per repeat and ground-truth row, one 0/1 column per tool in name order.

    One grouping: a pivot would first group by row and tool, and shuffle every detection. Digests
    in ``ord`` travel as bytes.
    """
    cell = lambda t: F.max(F.when(F.col("tool") == t, F.col("detected"))).alias(t)
    rows = detections.groupBy("repeat", packed(F.col("ord")).alias("_ord")).agg(*[cell(t) for t in sorted(tools)])
    return rows.select("repeat", unpacked(F.col("_ord")).alias("gt_ord"), *[F.col(f"`{t}`") for t in sorted(tools)])


def patterns(detections: DataFrame) -> DataFrame:
    """How often each combination of detections over one row occurs.

    ``pattern`` lists (tool, detected) in tool order, so it is never longer than the
    number of tools.
    """
    return (
        detections.groupBy("repeat", "ord")
        .agg(F.array_sort(F.collect_list(F.struct("tool", "detected"))).alias("pattern"))
        .groupBy("pattern")
        .agg(F.count("*").alias("n"))
    )


def chi2_tail(statistic: Column, df: Column) -> Column:
    """Upper tail of the chi-squared distribution with whole degrees of freedom."""
    half = statistic / 2
    even = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), (df / 2).cast("int"))),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct(
            (s["term"] * half / i).alias("term"), (s["sum"] + s["term"]).alias("sum")
        ),
        lambda s: s["sum"],
    ) * F.exp(-half)
    # Odd: start from one degree of freedom and add two at a time.
    odd = erfc(F.sqrt(half)) + F.when(
        df >= 3,
        F.exp(-half)
        * F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.lit(1), ((df - 1) / 2).cast("int"))),
            F.struct(
                (2 * F.sqrt(half / math.pi)).alias("term"), F.lit(0.0).alias("sum")
            ),
            lambda s, i: F.struct(
                (s["term"] * half / (i + 0.5)).alias("term"), (s["sum"] + s["term"]).alias("sum")
            ),
            lambda s: s["sum"],
        ),
    ).otherwise(F.lit(0.0))
    return F.when(statistic <= 0, F.lit(1.0)).when(df % 2 == 0, even).otherwise(odd)


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """Complementary error function; Spark has none. Runs on one-row results only."""
    return x.map(math.erfc)


def cochran_q(pattern_counts: DataFrame) -> DataFrame:
    """Cochran's Q over all tools: statistic, degrees of freedom, p."""
    hits = F.aggregate("pattern", F.lit(0), lambda a, p: a + p["detected"]).cast("double")
    # Every pattern shows once per tool, so each tool's rows carry the row sums as well.
    both = (
        pattern_counts.select("n", hits.alias("r"), F.inline("pattern"))
        .groupBy("tool")
        .agg(
            F.sum(F.col("n") * F.col("detected")).cast("double").alias("c"),
            F.sum(F.col("n") * F.col("r")).alias("sum_r"),
            F.sum(F.col("n") * F.col("r") * F.col("r")).alias("sum_r2"),
        )
        .agg(
            F.sum(F.col("c") * F.col("c")).alias("sum_c2"),
            F.count("*").cast("double").alias("k"),
            F.max("sum_r").alias("sum_r"),
            F.max("sum_r2").alias("sum_r2"),
        )
    )
    k, sum_r = F.col("k"), F.col("sum_r")
    below = k * sum_r - F.col("sum_r2")
    q = F.when(below == 0, F.lit(0.0)).otherwise(
        (k - 1) * (k * F.col("sum_c2") - sum_r * sum_r) / below
    )
    return (
        both.select(q.alias("statistic"), (k - 1).cast("int").alias("df"))
        .withColumn("p_value", chi2_tail(F.col("statistic"), F.col("df")))
    )


def mcnemar_counts(pattern_counts: DataFrame) -> DataFrame:
    """For each pair of tools, how often only the first (n10) and only the second (n01) hits."""
    pairs = ordered_pairs(pattern_counts, "pattern")
    only = lambda x, y: F.sum(
        F.when((F.col(f"{x}.detected") == 1) & (F.col(f"{y}.detected") == 0), F.col("n")).otherwise(0)
    )
    return pairs.groupBy(
        F.col("a.tool").alias("tool_a"), F.col("b.tool").alias("tool_b")
    ).agg(only("a", "b").alias("n10"), only("b", "a").alias("n01"))


def log_factorial(n: Column) -> Column:
    """ln n!, summed for small n and by Stirling's series beyond, exact to double precision."""
    x = n.cast("double")
    summed = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), F.least(n, F.lit(64).cast("bigint")))),
        F.lit(0.0),
        lambda s, i: s + F.log(i.cast("double")),
    )
    series = (
        x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x)
        + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    )
    return F.when(n <= 64, summed).otherwise(series)


def binomial_two_sided(n10: Column, n01: Column) -> Column:
    """Exact two-sided p of a fair coin.

    Terms are summed downwards from the largest, C(n, k), which is taken out in logs. Past
    nine times the square root of n a term is below e^-160 of the first, so leaving those
    out changes no digit, and the work grows with the root of the counts only.
    """
    n = n10 + n01
    k = F.least(n10, n01)
    reach = F.least(k, F.ceil(9 * F.sqrt(n)).cast("bigint") + 50)
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), reach),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct(
            (s["term"] * (k - i) / (n - k + i + 1)).alias("term"),
            (s["sum"] + s["term"]).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    log_choose = log_factorial(n) - log_factorial(k) - log_factorial(n - k)
    p = 2 * tail * F.exp(log_choose - n * math.log(2.0))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p))


def mcnemar(counts: DataFrame) -> DataFrame:
    return counts.withColumn("p", binomial_two_sided(F.col("n10"), F.col("n01")))


def holm(tests: DataFrame) -> DataFrame:
    """Holm's factors on ascending p, each capped at 1, without a running maximum.

    There is one row per pair of tools, so the global order is a short sort.
    """
    order = Window.orderBy("p", "tool_a", "tool_b")
    m = F.count("*").over(Window.partitionBy())
    factor = m - F.row_number().over(order) + 1
    return tests.withColumn("p_adj", F.least(F.lit(1.0), factor * F.col("p")))


def significance_markers(tests: DataFrame, baseline: str) -> DataFrame:
    """Tools significantly better than the baseline, marked ``*``."""
    better = F.when(
        (F.col("tool_a") == baseline) & (F.col("n01") > F.col("n10")), F.col("tool_b")
    ).when((F.col("tool_b") == baseline) & (F.col("n10") > F.col("n01")), F.col("tool_a"))
    return (
        tests.where(F.col("p_adj") < 0.05)
        .select(better.alias("tool"))
        .where("tool is not null")
        .distinct()
        .withColumn("marker", F.lit("*"))
    )


def significance_matrix(tests: DataFrame, tools: list[str]) -> DataFrame:
    """Upper-triangle labels: ``-`` on the diagonal, ``*`` or the adjusted p to two places."""
    label = F.when(F.col("p_adj") < 0.05, "*").otherwise(F.format_number("p_adj", 2))
    upper = tests.select(F.col("tool_a").alias("tool"), F.col("tool_b").alias("other"), label.alias("label"))
    return (
        upper.unionByName(
            tests.select(F.explode(F.array("tool_a", "tool_b")).alias("tool")).distinct().select(
                "tool", F.col("tool").alias("other"), F.lit("-").alias("label")
            )
        )
        .groupBy("tool")
        .pivot("other", sorted(tools))
        .agg(F.first("label"))
        .fillna("")
    )
