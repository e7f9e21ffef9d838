"""What keeps work per row and per task bounded: dealt tables, values computed once, exact sums."""

import hashlib
import json
from collections import defaultdict

from pyspark.sql import functions as F

from siftmark.functions import text
from siftmark.operators import coverage, drift, matching, metrics, significance, taxonomy
from siftmark.sources import advisories, authority, scanners
from workload import comparison, views


def _plan(df, capsys):
    capsys.readouterr()
    df.explain(True)
    return capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_tables_are_dealt_by_their_rows(spark, tmp_path, monkeypatch, capsys):
    """More rows go to more tasks, and the one task that reads a row group need not sort them."""
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(views, "TASK_ROWS", 50)
    dealt = views.table(spark, str(tmp_path), "t")
    held = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == 20 and max(held) < 150 and sum(held) == 1000
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))
    dealt.explain()
    assert "RoundRobin" not in capsys.readouterr().out


def test_finding_values_are_computed_once(spark, capsys):
    """No filter computes a finding's ids or its ecosystem a second time."""
    raw = spark.createDataFrame([("a", "{}")], "ord string, payload string")
    gt = spark.createDataFrame([("a", "npm", "x", "1", None)], "ord string, ecosystem string, component string, version string, purl string")
    plan = _plan(advisories.oss_index(raw, gt), capsys)
    assert plan.count("CVE-[") <= 4 and plan.count("GHSA-[") <= 4
    for read in (scanners.snyk, scanners.trivy, scanners.dtrack):
        assert _plan(read(raw), capsys).count("pkg:npm/") == 1


def test_oss_index_ids_of_odd_reports(spark):
    gt = spark.createDataFrame([("a", "npm", "x", "1", None), ("b", "npm", "x", "1", None)],
                               "ord string, ecosystem string, component string, version string, purl string")
    report = lambda c, **v: json.dumps([{"coordinates": c, "vulnerabilities": [v]}])
    raw = spark.createDataFrame([
        ("1", report(" pkg:npm/x@1 ", id="s", title=" ", description="text\nCVE-1-2, GHSA-q", cve="x")),
        ("2", report("pkg:maven/g/a@2?x=y", cve=" cve-3")),
        ("3", report("pkg:maven/g/a@2", cveId="cve-4 ")),
        ("4", report("pkg:maven/a@2", cve="CVE-5")),
        ("5", report(None, cve="CVE-6")),
    ], "ord string, payload string")
    got = {(r.ord[0], r.ecosystem, r.component, r.version, r.cve, r.ghsa, r.description)
           for r in advisories.oss_index(raw, gt).collect()}
    assert got == {("1", "npm", "x", "1", "CVE-1-2", "GHSA-Q", "[OSSINDEX:s] text"),
                   ("3", "maven", "g:a", "2", "CVE-4", None, "")}


def test_fingerprint_sums_stay_exact(spark, capsys):
    """Chunks add up in a task as 64-bit numbers; the value is that of the plain definition."""
    rows = [("t" + str(i % 2), "npm", f"c{i}", "1", None if i % 3 else f"CVE-{i}", None) for i in range(500)]
    df = spark.createDataFrame(rows * 2, "tool string, ecosystem string, component string, version string, cve string, osv_id string")
    prints = drift.fingerprint(df.repartition(7), ["tool"])
    assert "SPARK_PARTITION_ID" in _plan(prints, capsys)
    sums = defaultdict(lambda: [0] * 9)
    for tool, *parts, cve, _ in rows * 2:
        text = json.dumps([*parts, cve or ""], separators=(",", ":"))
        digest = hashlib.sha256(text.encode()).hexdigest()
        sums[tool][0] += 1
        for i in range(8):
            sums[tool][i + 1] += int(digest[8 * i:8 * i + 8], 16)
    want = {t: (s[0], hashlib.sha256("|".join(map(str, s)).encode()).hexdigest()) for t, s in sums.items()}
    assert {r.tool: (r.n_rows, r.fingerprint) for r in prints.collect()} == want
    none = drift.fingerprint(df.where("false"), []).first()
    assert (none.n_rows, none.fingerprint) == (0, hashlib.sha256(b"0").hexdigest())


def test_parsed_documents_are_not_written(spark, monkeypatch):
    """The first step of a walk follows the parse; what is written holds no whole document."""
    seen = []
    keep = authority.written
    monkeypatch.setattr(authority, "written", lambda df: seen.append(df.columns) or keep(df))
    m = lambda **x: {"criteria": "cpe:2.3:a:v:p:1:*", **x}
    matches = [m(), 3, None, "x", [1], m(vulnerable=False), m(vulnerable="false"), m(vulnerable=""), m(vulnerable=0),
               m(vulnerable=None), m(vulnerable={}), {"versionEndExcluding": 1.5}]
    tree = {"id": " C1 ", "configurations": [{"nodes": [{"cpeMatch": matches, "children": {"cpeMatch": [m()]}}]}]}
    deep = {"cpeMatch": [m(versionStartIncluding="2")]}
    for _ in range(12):
        deep = {"children": [deep]}
    docs = {"1": tree, "2": {"vulnerabilities": [{"cve": tree}]}, "3": {"vulnerabilities": [{"id": "C3", "cve": None}]},
            "4": {"vulnerabilities": []}, "5": {"vulnerabilities": {"cve": tree}}, "6": [tree], "7": {"id": "C7", "configurations": deep},
            "8": {"id": None}, "9": {"vulnerabilities": [4]}}
    raw = [(k, json.dumps(v)) for k, v in docs.items()] + [("bad", "{"), ("blank", " "), ("none", None)]
    found, rejects = authority.landed_records(spark.createDataFrame(raw, "ord string, payload string"))
    got = {r.ord: (r.cve, [(n.vendor, n.version, n.version_start_including, n.version_end_excluding) for n in r.cpe_nodes])
           for r in found.collect()}
    one = ("v", "1", None, None)
    whole = [one, one, one, ("", None, None, "1.5"), one]
    assert got == {"1": ("C1", whole), "2": ("C1", whole), "3": ("C3", []), "7": ("C7", [("v", "1", "2", None)])}
    assert [r.ord for r in rejects.collect()] == ["bad"]
    assert len(seen) > 1 and not any("body" in columns for columns in seen)


def test_node_names_are_read_once(spark, capsys):
    df = spark.createDataFrame([("A_b", " c ", ["a-b"]), ("xx", "yc", ["c"]), (None, "", ["", "z"]), ("q", "r", None)],
                               "vendor string, product string, tokens array<string>")
    out = df.select(coverage.node_match(F.struct("vendor", "product"), F.col("tokens")).alias("m"))
    assert [r.m for r in out.collect()] == ["exact", "substring", None, None]
    assert _plan(out, capsys).count("translate(") == 1


def test_views_are_dealt_by_files(spark, tmp_path, monkeypatch):
    """One row group becomes files of the same number of rows, without dealing rows at random."""
    spark.sql("""select id as l_orderkey, id as l_partkey, id as l_suppkey, 1 as l_linenumber, 1.0D as l_extendedprice,
        'R' as l_returnflag, timestamp'1995-03-01' as l_shipdate from range(1000)""").coalesce(1).write.parquet(
        f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(views, "TASK_ROWS", 50)
    (gt,) = views.views(spark, str(tmp_path), "gt0")
    held = [r["count"] for r in gt.groupBy(F.input_file_name()).count().collect()]
    assert held == [50] * 20


def test_packed_texts_come_back(spark):
    """Digests are sent as half as many bytes, and every text comes back as it was."""
    texts = ["0" * 32, "ab12" * 16, "AB", "abc", "", "0", "é\x01", "-1", "ff ", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.packed(F.col("t")).alias("p"))
    got = got.select("t", F.octet_length("p").alias("n"), text.unpacked(F.col("p")).alias("back")).collect()
    assert [(r.t, r.back) for r in got] == [(t, t) for t in texts]
    assert [r.n for r in got[:2]] == [17, 33]


def test_product_words_are_told_before_the_shuffle(spark, capsys):
    """Descriptions do not go through the join with the aliases."""
    extra = spark.createDataFrame([("t", "o", "npm", "x", "C", "a server")],
                                  "tool string, ord string, ecosystem string, component string, cve string, description string")
    aliases = spark.createDataFrame([("npm", "x", "C")], "ecosystem string, component string, alias string")
    out = taxonomy.classify_extra(extra, aliases)
    assert [r.fp_class for r in out.collect()] == ["FP-LIKELY"]
    assert "description" not in _plan(taxonomy.fp_tally(out), capsys).split("Join")[0]


def _lineitem(spark, folder):
    """A table of 1000 shipments, no supplier of them divisible by 3, in one row group."""
    spark.sql("""select id as l_orderkey, id % 40 as l_partkey, 3 * id + 1 as l_suppkey, 1 as l_linenumber, 1.0D as l_extendedprice,
        'R' as l_returnflag, timestamp'1995-03-01' as l_shipdate from range(1000)""").coalesce(1).write.parquet(
        f"{folder}/lineitem.parquet")
    return str(folder)


def test_ground_truth_is_summed_up_once(spark, tmp_path, monkeypatch):
    """The summary of the ground truth, which shuffles its component versions, is made once for a query."""
    made = []
    keep = metrics.gt_summary
    monkeypatch.setattr(metrics, "gt_summary", lambda gt: made.append(1) or keep(gt))
    comparison.ecosystem_summary(spark, _lineitem(spark, tmp_path))
    assert len(made) == 1


def _shuffles(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.count(" Exchange hashpartitioning")


def _all_crowded(monkeypatch):
    monkeypatch.setattr(matching, "FEW", 0)
    monkeypatch.setattr(matching, "ONE_TASK", 0)


def test_advisories_meet_versions_without_a_shuffle(spark, monkeypatch, capsys):
    """Pairs of a small package stay in its task; the index of intervals gives the same rows."""
    rng = [None, "", "< 2.0", "[1.0,2.0)", ">=1.0.0 <2.0.0", ">= 1.0, < 2.0", "===1.5", "~=1.4", "oops", "[x,2)"]
    node = lambda i, r, cve: {"vulnerableVersionRange": r, "advisory": {
        "ghsaId": f"ghsa-{i}", "summary": f"s{i}", "identifiers": [{"type": "CVE", "value": cve}] if cve else []}}
    raw = [(f"{eco}{p}{i}", eco, p, json.dumps({"data": {"securityVulnerabilities": {"nodes": [
        # One id with two ranges: the first that keeps the version counts.
        node(i, r, f"CVE-{i % 6}"), node(i, rng[(i + 3) % len(rng)], None if i % 2 else f"CVE-{i % 6}")]}}}))
        for eco in ("PIP", "NPM", "?") for p in ("a", "b", None) for i, r in enumerate(rng)]
    versions = ["0.9", "1.0", "1.5", "1.5.0", "1.5rc1", "2.0", "abc", "", None, "1.4.post1"]
    gt = [(e, p, v) for e in ("pypi", "npm", None) for p in ("a", "b", "c", None) for v in versions] * 2
    raw = spark.createDataFrame(raw, "ord string, github_ecosystem string, package string, payload string")
    gt = spark.createDataFrame(gt, "ecosystem string, component string, version string")
    small = advisories.github(raw, gt)
    assert _shuffles(small, capsys) == 2
    rows = sorted(map(str, small.collect()))
    _all_crowded(monkeypatch)
    assert len(rows) > 100 and rows == sorted(map(str, advisories.github(raw, gt).collect()))


def test_rows_meet_osv_advisories_in_one_task(spark, monkeypatch, capsys):
    """The lookup deals rows and advisories out once, and only findings are shuffled again."""
    event = lambda **x: {"events": [{k: v} for k, v in x.items()]}
    affected = [None, [], [{"versions": ["1.0", "2.0"]}], [{"ranges": [event(introduced="1.0", fixed="2.0")]}],
                [{"ranges": None}, {"versions": ["3"], "ranges": [event(introduced="0", last_affected="1.5"), event(introduced="1.2")]}],
                [{"ranges": [event(introduced="=1")]}], [{"versions": None, "ranges": [event(introduced="0")]}]]
    raw = [(f"{eco}{p}{i}", eco, p, json.dumps({"vulns": [
        {"id": f"OSV-{i}", "aliases": [f"CVE-{i % 3}", f"GHSA-{i}"] if i % 4 else None, "details": f"d{i}", "affected": a}]}))
        for eco in ("PyPI", "npm") for p in ("a", "@s/b", None) for i, a in enumerate(affected)]
    gt = [(f"{e}{n}{v}{p}{i}", e, n, v, p, f"CVE-{i}" if i % 2 else None, "", f"OSV-{2 * i}")
          for e in ("pypi", "npm", None) for n in ("a", "@s/b", None) for v in ("1.0", "1.4", "3", "x", None)
          for p in (None, "pkg:npm/a@1", "pkg:npm/@s/b@2") for i in range(4)]
    raw = spark.createDataFrame(raw, "ord string, osv_ecosystem string, package string, payload string")
    gt = spark.createDataFrame(gt, "ord string, ecosystem string, component string, version string, purl string, "
                                   "cve string, ghsa string, osv_id string")
    small = advisories.osv(raw, gt)
    assert _shuffles(small, capsys) == 3
    rows = sorted(map(str, small.collect()))
    _all_crowded(monkeypatch)
    assert len(rows) == 20 and rows == sorted(map(str, advisories.osv(raw, gt).collect()))


def test_rows_meet_the_verdict_on_their_product(spark, capsys):
    """Versions are no part of the product's verdict, so rows are not grouped by them to meet it."""
    node = lambda end: f"array(named_struct('vendor', 'v', 'product', 'Pkg_a', 'version', null, 'version_start_including', null, 'version_start_excluding', null, 'version_end_including', null, 'version_end_excluding', '{end}'))"
    records = spark.sql(f"select 'C1' as cve, {node('2.0')} as cpe_nodes union all select 'C2', array() union all select null, {node('3.0')}")
    gt = [(f"{i}", e, c, v, cve, "x") for i, (e, c, v, cve) in enumerate(
        (e, c, v, cve) for e in ("npm", None) for c in ("pkg-a", "other", None) for v in ("1.0", "2.0", "odd", None)
        for cve in ("C1", "C2", "C3", " ", None))] * 2
    gt = spark.createDataFrame(gt, "ord string, ecosystem string, component string, version string, cve string, more string")
    out = coverage.nvd_coverage(gt, records)
    assert not [x for x in _plan(out, capsys).splitlines() if "Aggregate" in x and "version" in x]
    got = sorted((r.ord, r.cve, r.more, r.bucket, r.matched_nodes, r.precise_bucket) for r in out.collect())
    per_key = {(r.ecosystem, r.component, r.version, r.cve): (r.bucket, r.matched_nodes, r.precise_bucket)
               for r in coverage.classify(gt, records).collect()}
    want = [(r.ord, (r.cve or "").strip(), "x", *per_key[r.ecosystem, r.component, r.version, (r.cve or "").strip() or None])
            for r in gt.collect() if r.ecosystem and r.component and r.version]
    assert got == sorted(want) and {b for *_, b in got} == {
        "NO_CVE", "CVE_ABSENT", "NO_CPE_CONFIG", "PRODUCT_MISMATCH", "COVERED", "VERSION_OUT_OF_RANGE"}


def test_detections_are_told_where_packages_match(spark, monkeypatch, capsys):
    """Small packages and the version axis give the same vectors, and findings go out once for all repeats."""
    ids = "cve string, ghsa string, osv_id string"
    gt = [(f"{c}{v}{i}" if i else None, e, c, v, f"CVE-{i % 2}", None, "O")
          for e, c in (("npm", "a"), ("npm", "b"), (None, "a"), ("npm", None)) for v in ("1.0", "2.0", None) for i in range(4)]
    gt = spark.createDataFrame(gt, "ord string, ecosystem string, component string, version string, " + ids)
    found = [(f"f{t}{c}{v}", t, "npm", c, v, cve, None, None, r, rep) for t in ("t", "u", None) for c in ("a", "b", None)
             for v, cve, r, rep in (("1.0", "CVE-1", None, [1, 2]), ("9", "CVE-0", ">=2.0", [2]), ("2.0", "CVE-7", "<1", [1]))]
    found = spark.createDataFrame(found, "ord string, tool string, ecosystem string, component string, version string, "
                                         f"{ids}, affected_version_range string, repeat array<int>")
    pairs = significance.run_vectors(gt, found, ["t", "u", "w"], 2)
    rows = sorted(map(str, pairs.collect()))
    assert len(rows) == gt.count() * 6 and any("detected=1" in r for r in rows) and _shuffles(pairs, capsys) <= 4
    _all_crowded(monkeypatch)
    assert rows == sorted(map(str, significance.run_vectors(gt, found, ["t", "u", "w"], 2).collect()))


def test_matrix_is_grouped_once(spark, capsys):
    cells = [("b", 1, "ff", 1), ("a", 1, "ff", 0), ("a", 1, "not hex", 1), ("b", 2, "ff", 1), ("z", 2, None, 1), ("a", 2, "", None)]
    cells = spark.createDataFrame(cells, "tool string, repeat int, ord string, detected int")
    out = significance.detection_matrix(cells, ["b", "a"])
    assert out.columns == ["repeat", "gt_ord", "a", "b"] and _shuffles(out, capsys) == 1
    assert set(map(tuple, out.collect())) == {
        (1, "ff", 0, 1), (1, "not hex", 1, None), (2, "ff", None, 1), (2, None, None, None), (2, "", None, None)}
