"""Operators against brute force and stated cases on small rows."""

import math
import random
from collections import Counter, defaultdict, deque
from statistics import median

import pytest
from pyspark.sql import functions as F

from siftmark.functions import ranges
from siftmark.operators import balancing, datasets, drift, intervals, matching, metrics, ranking, selection, taxonomy
from siftmark.operators import significance as sig

GT = "ord string, ecosystem string, component string, version string, cve string, ghsa string, osv_id string"
FOUND = "tool string, " + GT + ", affected_version_range string, description string"


def test_matching_against_brute_force(spark):
    from packaging.version import Version

    rnd = random.Random(3)
    ids = [None, "A", "B", "C"]
    gt = [(f"g{i:03}", "npm", rnd.choice("xy"), f"{rnd.randint(1, 6)}.0", rnd.choice(ids), None, rnd.choice(ids))
          for i in range(150)]
    found = [
        (rnd.choice(["s", "t"]), f"f{i:03}", "npm", rnd.choice("xyz"), f"{rnd.randint(1, 9)}.0", rnd.choice(ids), rnd.choice(ids),
         None, rnd.choice([None, "", f">={rnd.randint(1, 4)},<{rnd.randint(2, 7)}", "<=3", "odd", "<bad"]), "")
        for i in range(120)
    ]

    def inside(v, expr):
        if not expr or "bad" in expr:
            return False
        for p in expr.split(","):
            if p.startswith(">=") and Version(v) < Version(p[2:]):
                return False
            if p.startswith("<=") and Version(v) > Version(p[2:]):
                return False
            if p.startswith("<") and not p.startswith("<=") and Version(v) >= Version(p[1:]):
                return False
        return True

    want, classes = {}, {}
    for tool in "st":
        for g in gt:
            mine = [f for f in found if f[0] == tool and f[2:4] == g[1:3]]
            shared = [f for f in mine if ({g[4], g[6]} & {f[5], f[6]}) - {None}]
            exact = [f[1] for f in shared if f[4] == g[3]]
            ranged = [f[1] for f in shared if inside(g[3], f[8])]
            hit = ("TP_EXACT", min(exact)) if exact else ("TP_RANGE", min(ranged)) if ranged else (None, None)
            want[tool, g[0]] = hit
            if hit[0] is None:
                classes[tool, g[0]] = (
                    "FN_exact" if any(f[4] == g[3] for f in mine)
                    else "FN_range" if any(inside(g[3], f[8]) for f in mine) else "FN_true"
                )
    g, f = spark.createDataFrame(gt, GT), spark.createDataFrame(found, FOUND)
    matched = matching.match(g, f, ["s", "t"])
    got = {(r.tool, r.ord): (r.match_type, r.finding_ord) for r in matched.collect()}
    assert got == want
    misses = matching.classify_misses(matching.false_negatives(matched), f)
    assert {(r.tool, r.ord): r.fn_class for r in misses.collect()} == classes
    chosen = {(t, o) for (t, _), (_, o) in want.items() if o}
    extra = matching.false_positives(f, matching.matched_signatures(g, f, ["tool"]))
    assert {(r.tool, r.ord) for r in extra.collect()} == {(x[0], x[1]) for x in found} - chosen
    scores = {r.tool: r for r in metrics.report_summary(g, f, ["s", "t"]).collect()}
    for tool in "st":
        hits = sum(1 for (t, _), h in want.items() if t == tool and h[0])
        assert (scores[tool].TP, scores[tool].FN) == (hits, len(gt) - hits)
        assert scores[tool].FP == sum(1 for x in found if x[0] == tool) - sum(1 for c in chosen if c[0] == tool)


def _some_findings(spark):
    rnd = random.Random(8)
    ids = [None, "", "A", "B", "C"]
    some = lambda: [rnd.choice(ids) for _ in range(3)]
    gt = [(f"g{i:03}", "npm", rnd.choice(["x", "y", None]), rnd.choice(["1.0", "2.0", "3.0", None]), *some())
          for i in range(90)]
    found = [("st"[i % 2], f"f{i:03}", "npm", rnd.choice(["x", "y", "z", None]), rnd.choice(["1.0", "2", "5.0", None]),
              *some(), rnd.choice([None, ">=2.0", "<2.5", "<bad"]), "") for i in range(60)]
    return spark.createDataFrame(gt, GT), spark.createDataFrame(found, FOUND)


def test_pairs_and_axis_agree(spark, monkeypatch):
    """Packages matched in one task and packages of many rows give the same rows."""
    g, f = _some_findings(spark)
    tools = ["s", "t"]

    def outcomes():
        hits = matching.matched_signatures(g, f, ["tool"])
        vectors = sig.detection_vector(g, f, tools)
        frames = [matching.match(g, f, tools), hits.drop("n_chosen"), matching.classified_misses(g, f, tools),
                  metrics.component_outcomes(g, f, tools), matching.missed_signatures(g, f, tools, hits)]
        patterns = {(str(r.pattern), r.n) for r in sig.key_patterns(g, f, tools).collect()}
        counted = {(str(r.pattern), r.n) for r in sig.patterns(vectors.withColumn("repeat", F.lit(1))).collect()}
        assert patterns == counted
        return [sorted(map(repr, df.select(*sorted(df.columns)).collect())) for df in frames] + [patterns]

    small = outcomes()
    monkeypatch.setattr(matching, "FEW", 0)
    assert matching.crowded(g, f).count() == 2
    assert outcomes() == small


def test_extra_findings_in_one_step(spark, monkeypatch):
    """Rows that are no ground truth's choice, copies and rows without a package among them."""
    g, f = _some_findings(spark)
    f = f.unionByName(f.limit(20))
    rows = lambda df: sorted(map(repr, df.select(*f.columns).collect()))
    want = rows(f.join(
        matching.matched_signatures(g, f, ["tool"]).select("tool", F.col("finding_ord").alias("ord")), ["tool", "ord"], "left_anti"
    ))
    assert len(want) < f.count()
    for few in (128, 0):
        monkeypatch.setattr(matching, "FEW", few)
        assert rows(matching.extra_findings(g, f)) == want
        assert rows(matching.false_positives(f, matching.matched_signatures(g, f, ["tool"]))) == want


def test_top_groups_in_one_pass(spark, monkeypatch):
    """Groups are ranked, ties by where they first turn up, and hits are neither written nor joined again."""
    g, f = _some_findings(spark)
    f = f.unionByName(f.where("component = 'x'").withColumn("component", F.lit("w")).withColumn("ord", F.concat(F.lit("e"), "ord")))
    tools = ["s", "t"]
    listed = {}
    hits = [(r, {"TP_EXACT": 0, "TP_RANGE": 1}.get(r.match_type, 3)) for r in matching.match(g, f, tools).collect()]
    for r, place in hits + [(r, 2) for r in matching.extra_findings(g, f).collect()]:
        if r.component is not None:
            listed.setdefault((r.tool, r.component), []).append((place, r.ord))
    want = []
    for tool in tools:
        groups = [(-sum(p == 3 for p, _ in v), min(v), c) for (t, c), v in listed.items() if t == tool]
        want += [(tool, c, -n, i + 1) for i, (n, _, c) in enumerate(sorted(groups)[:3])]
    monkeypatch.setattr(metrics, "written", None, raising=False)
    for few in (128, 0):
        monkeypatch.setattr(matching, "FEW", few)
        top = metrics.top_groups(g, f, tools, ["ecosystem", "component"], "FN", 3)
        assert sorted((r.tool, r.component, r.FN, r.rank) for r in top.collect()) == sorted(want)


def test_misses_need_no_digests_of_findings(spark, monkeypatch, capsys):
    """Without the chosen finding, rows and types are the same and no finding's ``ord`` is dealt out."""
    g, f = _some_findings(spark)
    f = f.withColumn("ord", F.concat(F.lit("not sent "), "ord"))
    rows = lambda df: sorted(map(repr, df.collect()))
    for few in (128, 0):
        monkeypatch.setattr(matching, "FEW", few)
        lean = matching.match(g, f, ["s", "t"], chosen=False)
        assert rows(lean) == rows(matching.match(g, f, ["s", "t"]).drop("finding_ord"))
        assert rows(matching.false_negatives(lean)) == rows(matching.false_negatives(matching.match(g, f, ["s", "t"])))
    monkeypatch.setattr(matching, "FEW", 128)
    for chosen in (True, False):
        capsys.readouterr()
        matching.match(g, f, ["s", "t"], chosen).explain(True)
        plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        assert ("not sent" in plan) == chosen


def test_extra_findings_are_classified_where_they_are_told(spark, monkeypatch):
    """The same rows and classes as two steps give, with no second shuffle of the findings."""
    g, f = _some_findings(spark)
    f = f.unionByName(f.limit(20)).withColumn("description", F.expr("if(ord < 'f030', 'a Server', null)"))
    aliases = spark.createDataFrame(
        [("npm", "x", "A"), ("npm", "x", "A"), ("npm", "y", "B"), ("npm", "z", None), (None, "x", "C"), ("npm", None, "A")],
        "ecosystem string, component string, alias string")
    columns = ["tool", "ord", "ecosystem", "component", "cve", "fp_class", "fp_reason", "fp_class_computed"]
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    want = rows(taxonomy.classify_extra(matching.extra_findings(g, f), aliases))
    seen = []
    keep = taxonomy.classify_extra
    monkeypatch.setattr(taxonomy, "classify_extra", lambda extra, known: seen.append(extra) or keep(extra, known))
    for few in (128, 0):
        monkeypatch.setattr(matching, "FEW", few)
        assert rows(taxonomy.classified_extra(g, f, aliases)) == want
    # Only rows without a package, then those of crowded packages as well, take the step that shuffles them.
    assert seen[0].where("ecosystem is not null and component is not null").count() == 0
    assert seen[1].count() > seen[0].count()


def test_ranges_of_pairs_are_read_once_for_each_text(spark):
    """Verdicts by distinct versions and range texts are those of one range check for every pair."""
    versions = ["1.0", "2.0", "1.5rc1", "bad", "", None]
    texts = [">=1.0,<2.0", "<bad", "", ",", "<1,>2", "==2", "[1.0,2.0)", None]
    pairs = spark.createDataFrame([(v, t, w) for v in versions for t in texts for w in ("2.0", None)], "v string, t string, version string")
    told = matching.in_range_by_text(pairs, "v", "t", pairs.select("v"), pairs.select("t"))
    want = F.coalesce(ranges.in_bare_range(F.col("v"), F.col("t")), F.lit(False))
    got = told.select("v", "t", "version", "in_range", want.alias("want")).collect()
    assert len(got) == pairs.count() and all(r.in_range == r.want for r in got)
    assert {r.in_range for r in got} == {True, False}
    verdict = matching.pair_verdict(F.lit(True), F.col("v"), F.col("version"), F.col("in_range"))
    assert {r[0] for r in told.select(verdict).collect()} == {"TP", "TP_RANGE", "FN"}
    shared = matching.shared_id([F.lit("A"), F.lit("")], [F.lit(""), F.col("version")])
    assert not any(r[0] for r in told.select(shared).collect())


def test_digests_are_dealt_as_bytes(spark, capsys):
    """A finding's digest is shuffled as bytes, and not at all where only hits are counted."""
    g, f = _some_findings(spark)
    matching.by_package(f, matching.crowded(g, f)).explain(True)
    dealt = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("RepartitionByExpression")
    assert "unhex(ord" in dealt[1] and "hex(ord" in dealt[0]
    sig.key_patterns(g, f, ["s", "t"]).explain(True)
    assert "unhex(ord" not in capsys.readouterr().out.split("== Optimized Logical Plan ==")[1]


def test_small_packages_are_shuffled_once(spark):
    """After both sides are dealt out by package nothing is shuffled again."""
    g, f = _some_findings(spark)
    crowd = matching.crowded(g, f)
    said = matching.said_by_pairs(
        matching.by_package(g, crowd), matching.by_package(f, crowd), ["tool"],
        matching.written(matching.parsed_texts(f)), "ord",
    )
    plan = said._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2
    assert "hashpartitioning" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_covering_many_intervals(spark):
    rnd = random.Random(5)
    points = [(g, f"v{i}", f"{i:03}!1") for g in "ab" for i in range(0, 200, rnd.randint(1, 2))]
    spans = []
    for i in range(300):
        lo, hi = rnd.randint(0, 199), rnd.randint(0, 210)
        spans.append((rnd.choice("abc"), rnd.choice("pq"), f"{lo:03}!0", f"{hi:03}!0", f"o{i:03}"))
    got = {
        (r.g, r.v, r.t): r.o
        for r in intervals.covering(
            spark.createDataFrame(points, "g string, v string, position string"),
            spark.createDataFrame(spans, "g string, t string, lower string, upper string, o string"),
            ["g"], "v", ["t"], "o",
        ).groupBy("g", "v", "t").agg(F.min("o").alias("o")).collect()
    }
    want = {}
    for g, v, p in points:
        for sg, t, lo, hi, o in spans:
            if sg == g and lo < p < hi:
                want[g, v, t] = min(o, want.get((g, v, t), "z"))
    assert got == want


def brute_balance(rows, ecosystems, strategy):
    by = defaultdict(list)
    for r in rows:
        if r[1] in ecosystems:
            by[r[1]].append(r)
    sizes = [len(v) for v in by.values()]
    target = min(sizes) if strategy == "min" else int(median(sizes))
    kept = []
    for rs in by.values():
        groups, comps = defaultdict(list), Counter(r[2] for r in rs)
        for r in rs:
            groups[r[2], r[3]].append(r)
        queues = [deque(sorted(v, key=lambda r: (r[5] or "", r[6] or "", r[0]))) for _, v in sorted(
            groups.items(), key=lambda kv: (len(kv[1]), comps[kv[0][0]], kv[0][0].lower(), kv[0][1]))]
        got = []
        while len(got) < target and any(queues):
            for q in queues:
                if q and len(got) < target:
                    got.append(q.popleft()[0])
        kept += got
    return sorted(kept)


@pytest.mark.parametrize("strategy", ["min", "median"])
def test_balancing_deals_round_by_round(spark, strategy):
    rnd = random.Random(8)
    rows = []
    for eco, n in (("npm", 90), ("pypi", 41), ("maven", 60), ("nuget", 17), ("other", 5)):
        for i in range(n):
            comp = "hot" if rnd.random() < 0.4 else f"P{rnd.randint(1, 9)}"
            rows.append((f"{eco}{i:03}", eco, comp, f"{rnd.randint(1, 4)}.0", "p", f"V{rnd.randint(1, 30)}", None))
    df = spark.createDataFrame(
        rows, "ord string, ecosystem string, component_name string, component_version string, purl string, vulnerability_id string, cve string")
    ecos = ["npm", "pypi", "maven", "nuget"]
    got = sorted(r.ord for r in balancing.balance(df, ecos, strategy).collect())
    assert got == brute_balance(rows, ecos, strategy)
    with pytest.raises(ValueError):
        balancing.balance(df, ecos, "max")


def test_even_sampling(spark):
    for n, limit in [(10, 4), (6, 6), (7, 3), (5, 1), (9, 8), (3, 5), (6, None)]:
        if limit is None or n <= limit:
            want = list(range(n))
        elif limit == 1:
            want = [n - 1]
        else:
            want = sorted({round(k * (n - 1) / (limit - 1)) for k in range(limit)})
        df = spark.range(n).where(selection.sampled(F.col("id"), F.lit(n), limit))
        assert sorted(r.id for r in df.collect()) == want, (n, limit)


def test_row_numbers_over_slices(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), f"{rnd.randint(0, 9999):04x}{i:03}") for i in range(400)]
    got = ranking.row_number_within(spark.createDataFrame(rows, "k string, o string"), ["k"], "o", "n").collect()
    for k in "ab":
        order = sorted(o for kk, o in rows if kk == k)
        assert {r.o: r.n for r in got if r.k == k} == {o: i + 1 for i, o in enumerate(order)}


# Archived pairs of one published comparison: n10, n01, p, corrected p.
PAIRS = [
    ("oss-index", "trivy", 12, 706, 5.271534892806222e-191, 5.271534892806222e-190),
    ("github", "oss-index", 730, 62, 1.2075322047355519e-145, 1.0867789842619967e-144),
    ("oss-index", "snyk", 58, 634, 2.0766762919548928e-123, 1.6613410335639142e-122),
    ("dtrack", "oss-index", 686, 100, 2.975069247543054e-108, 2.0825484732801377e-107),
    ("dtrack", "trivy", 32, 140, 2.5960289994977246e-17, 1.5576173996986347e-16),
    ("snyk", "trivy", 72, 190, 1.9012544675036762e-13, 9.50627233751838e-13),
    ("github", "snyk", 194, 102, 9.773834194609848e-08, 3.9095336778439394e-07),
    ("dtrack", "github", 94, 176, 6.82911414437845e-07, 2.048734243313535e-06),
    ("github", "trivy", 70, 96, 0.05200575499696468, 0.10401150999392936),
    ("dtrack", "snyk", 192, 182, 0.641718581977318, 0.641718581977318),
]


def test_paired_tests_give_published_values(spark):
    df = spark.createDataFrame([p[:4] for p in PAIRS], "tool_a string, tool_b string, n10 bigint, n01 bigint")
    tests = sig.holm(sig.mcnemar(df))
    got = {(r.tool_a, r.tool_b): r for r in tests.collect()}
    for a, b, _, _, p, p_adj in PAIRS:
        assert math.isclose(got[a, b].p, p, rel_tol=1e-9)
        assert math.isclose(got[a, b].p_adj, p_adj, rel_tol=1e-9)
    assert {r.tool for r in sig.significance_markers(tests, "oss-index").collect()} == {
        "trivy", "github", "snyk", "dtrack"}


def test_binomial_for_large_counts(spark):
    df = spark.createDataFrame([(0, 0), (3, 3), (0, 5), (50_000_000, 50_010_000)], "n10 bigint, n01 bigint")
    got = [r.p for r in sig.mcnemar(df).collect()]
    assert got[:3] == [1.0, 1.0, pytest.approx(2 / 32)]
    z = (10_000 - 1) / math.sqrt(100_010_000)
    assert got[3] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)


def test_chi_squared_tail(spark):
    # df 1 and 3 by closed form, df 2 and 4 by the exponential series.
    df = spark.createDataFrame([(3.0, 1), (3.0, 2), (3.0, 3), (3.0, 4), (0.0, 2)], "q double, k int")
    got = [r.p for r in df.select(sig.chi2_tail(F.col("q"), F.col("k")).alias("p")).collect()]
    one = math.erfc(math.sqrt(1.5))
    want = [one, math.exp(-1.5), one + math.sqrt(2 * 3 / math.pi) * math.exp(-1.5), math.exp(-1.5) * 2.5, 1.0]
    assert got == pytest.approx(want, rel=1e-12)


def test_cochran_q_by_hand(spark):
    rows = [(1, f"r{i}", t, d) for i, bits in enumerate(["110", "100", "111", "000", "101", "100"])
            for t, d in zip("abc", map(int, bits))]
    df = spark.createDataFrame(rows, "repeat int, ord string, tool string, detected int")
    r = sig.cochran_q(sig.patterns(df)).collect()[0]
    c, rs = [5, 2, 2], [2, 1, 3, 0, 2, 1]
    want = 2 * (3 * sum(x * x for x in c) - sum(c) ** 2) / (3 * sum(rs) - sum(x * x for x in rs))
    assert (r.statistic, r.df) == (pytest.approx(want), 2)
    same = df.withColumn("detected", F.lit(1))
    r = sig.cochran_q(sig.patterns(same)).collect()[0]
    assert (r.statistic, r.p_value) == (0.0, 1.0)


def test_fingerprint_ignores_order_and_keeps_copies(spark):
    rows = [("1", "npm", "a", "1", "C1", None, None), ("2", "npm", "b", "1", None, None, "O"), ("3", "npm", "a", "1", "C1", None, None)]
    fp = lambda rs: drift.fingerprint(spark.createDataFrame(rs, GT), []).collect()[0].fingerprint
    assert fp(rows) == fp(rows[::-1])
    assert fp(rows) != fp(rows[:2])


def test_empty_diff_is_equal(spark):
    empty = spark.createDataFrame([], GT)
    r = drift.diff_summary(drift.key_counts(empty, empty)).collect()[0]
    assert (r.jaccard, r.equal, r.added_rows) == (1.0, True, 0)


def test_validation_fails_loudly(spark):
    rows = spark.createDataFrame([("1", "npm", "a", "1", "V1")],
                                 "ord string, ecosystem string, component_name string, component_version string, vulnerability_id string")
    good = spark.createDataFrame([("npm", "a", "1", ["V1"])],
                                 "ecosystem string, component_name string, component_version string, vulnerability_ids array<string>")
    assert datasets.validated(rows, good).count() == 1
    bad = good.withColumn("vulnerability_ids", F.array(F.lit("V2")))
    with pytest.raises(Exception, match="invalid"):
        datasets.validated(rows, bad).collect()


def test_medians_from_histograms(spark):
    import random
    import statistics

    rnd = random.Random(4)
    values = {g: [rnd.randint(1, 9) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 30), ("d", 31))}
    rows = [(g, v) for g, vs in values.items() for v in vs]
    counted = spark.createDataFrame(rows, "g string, n long").groupBy("g", "n").agg(F.count("*").alias("times"))
    got = {r.g: r[1:] for r in datasets.histogram_spread(counted, "g", "x").collect()}
    assert got == {g: (max(v), sum(v) / len(v), min(v), statistics.median(v)) for g, v in values.items()}


def test_statistics_of_rows_without_names(spark):
    rows = spark.createDataFrame(
        [("npm", None, "1", "V", "CVE-1"), ("npm", "a", "1", "V", "CVE-1"), ("npm", "a", "1", "V", ""), ("npm", "a", "1", None, None),
         ("pypi", "a", "2", "W", "CVE-1")],
        "ecosystem string, component_name string, component_version string, vulnerability_id string, cve string")
    got = {r.ecosystem: r for r in datasets.gt_statistics(rows).collect()}
    npm, total = got["npm"], got["TOTAL"]
    assert (npm.components, npm.osv_vulns, npm.cve_findings, npm.cves, npm.median_comp_freq) == (1, 1, 2, 1, 2.0)
    assert (total.components, total.osv_vulns, total.cves, total.max_compver_freq) == (2, 2, 1, 3)
    before = {r.ecosystem: tuple(r)[1:] for r in datasets.pre_balance_stats(rows).select(
        "ecosystem", "rows", "osv_vuln_entries", "unique_components", "cve_findings", "unique_cves").collect()}
    assert before == {"npm": (4, 1, 1, 2, 1), "pypi": (1, 1, 1, 1, 1)}


def test_first_rows_beyond_the_group_limit(spark):
    df = spark.range(5000).selectExpr("'k' as k", "lpad(cast(id * 7919 % 5000 as string), 5, '0') as o")
    for n in (3, ranking.GROUP_LIMIT + 500):
        got = sorted(r.o for r in ranking.first_rows_per(df, ["k"], n, "o").collect())
        assert got == [f"{i:05}" for i in range(n)]
