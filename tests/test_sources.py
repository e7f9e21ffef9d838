"""Files in and out, and the odd shapes of raw documents."""

import json

import pytest

from siftmark.operators import datasets
from siftmark.sources import advisories, authority, base, ground_truth, registries, scanners

RAW = "ord string, payload string"


def raw(spark, *docs):
    return spark.createDataFrame([(f"d{i}", json.dumps(d)) for i, d in enumerate(docs)], RAW)


def test_ground_truth_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("pypi", "My_Pkg", "1.0", None, "OSV-1", "cve-2024-1", 'has "quotes", commas\nand lines', True),
         ("maven", "g:a", "2.0", "pkg:maven/g/a@2.0", "GHSA-x", None, "", True)],
        "ecosystem string, component_name string, component_version string, purl string, "
        "vulnerability_id string, cve string, vulnerability_description string, is_vulnerable boolean")
    path = str(tmp_path / "gt")
    datasets.write_ground_truth(rows, path)
    got = {r.component: r for r in ground_truth.ground_truth(ground_truth.read_rows(spark, path)).collect()}
    assert set(got) == {"my-pkg", "g:a"}
    assert got["my-pkg"].cve == "CVE-2024-1" and got["my-pkg"].purl is None
    assert got["my-pkg"].description == 'has "quotes", commas\nand lines'
    assert got["g:a"].osv_id == "GHSA-X" and got["g:a"].cve is None
    datasets.write_ground_truth(rows, str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_run_results(spark, tmp_path):
    cell = {"Components": 1, "Vulnerabilities": 2, "CVEs": 1, "TP": 1, "FP": 0, "FN": 1, "Recall": 0.5, "Overlap": 1.0}
    for run, text in [("run_1", json.dumps({"t": {"npm": cell}})), ("run_2", "")]:
        (tmp_path / run).mkdir()
        (tmp_path / run / "experimental_results.json").write_text(text)
    rows = ground_truth.read_runs(spark, str(tmp_path)).collect()
    assert [(r.run, r.tool, r.ecosystem, r.Recall) for r in rows] == [("run_1", "t", "npm", 0.5)]
    (tmp_path / "none" / "run_9").mkdir(parents=True)
    (tmp_path / "none" / "run_9" / "experimental_results.json").write_text("{}")
    with pytest.raises(ValueError):
        ground_truth.read_runs(spark, str(tmp_path / "none"))


def test_cve_records(spark):
    deep = {"cpeMatch": [{"criteria": "cpe:2.3:a:deep:er:-"}]}
    for _ in range(9):
        deep = {"children": [deep]}
    flat = {"nodes": [{"cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:v:p:1.0"},
                                    {"vulnerable": False, "criteria": "cpe:2.3:a:x:y:1.0"}]}]}
    got = {r.cve: [(n.vendor, n.product, n.version) for n in r.cpe_nodes] for r in authority.records(raw(
        spark,
        {"vulnerabilities": [{"cve": {"id": "CVE-1", "configurations": [flat]}}]},
        {"vulnerabilities": []},
        {"id": "CVE-2"},
        {"id": "CVE-3", "configurations": [deep]},
        {"id": "CVE-4", "configurations": flat},
    )).collect()}
    assert got == {"CVE-1": [("v", "p", "1.0")], "CVE-2": [], "CVE-3": [("deep", "er", None)],
                   "CVE-4": [("v", "p", "1.0")]}


def test_deep_and_odd_cve_records(spark):
    def nested(levels):
        return '{"children": [' * levels + '{"cpeMatch": [{"criteria": "cpe:2.3:a:deep:er:1"}]}' + "]}" * levels

    docs = [
        ("deep", '{"id": "D", "configurations": %s}' % nested(120)), ("deepest", '{"id": "E", "configurations": %s}' % nested(100_000)),
        ("odd", '{"id": 7, "configurations": [[{"nodes": {"cpeMatch": ["x", {"vulnerable": 0}, {"vulnerable": ""}, {"vulnerable": "no", "criteria": 5},'
                '{"vulnerable": 1, "criteria": "cpe:2.3:a:v:p:*:*", "versionEndExcluding": 2}]}}]]}'),
        ("empty", ""), ("broken", "{"), ("null", None), ("list", "[1]"), ("none", '{"x": 1}'), ("no object", '{"vulnerabilities": [3]}'),
        ("wrapped", '{"vulnerabilities": [{"cve": null, "id": "W"}]}'),
    ]
    found, rejects = authority.landed_records(spark.createDataFrame(docs, RAW))
    got = {r.ord: (r.cve, [(n.vendor, n.product, n.version, n.version_end_excluding) for n in r.cpe_nodes]) for r in found.collect()}
    assert got == {"deep": ("D", [("deep", "er", "1", None)]), "wrapped": ("W", []),
                   "odd": ("7", [("", "", None, None), ("v", "p", None, "2")])}
    assert sorted(r.ord for r in rejects.collect()) == ["broken", "deepest"]


def test_reports_with_missing_parts(spark):
    assert scanners.snyk(raw(spark, {"vulnerabilities": [{}, {"name": "x"}]}, {})).count() == 0
    assert scanners.trivy(raw(spark, {"Results": None}, {"Results": [{"Vulnerabilities": None}]})).count() == 0
    assert scanners.dtrack(raw(spark, [{"component": None, "vulnerability": {"vulnId": "CVE-1"}}])).count() == 0


def test_oss_index_reads_unknown_coordinates(spark):
    gt = spark.createDataFrame([("1", "npm", "a", "1.0", "pkg:npm/a@1.0")],
                               "ord string, ecosystem string, component string, version string, purl string")
    docs = [[{"coordinates": "pkg:maven/g/x@2.0?y", "vulnerabilities": [{"id": "i", "references": "see CVE-9-1!"}]},
             {"coordinates": "pkg:cargo/z@1", "vulnerabilities": [{"cve": "CVE-1"}]},
             {"coordinate": "pkg:npm/a@1.0", "vulnerabilities": [{"title": "GHSA-a-b in x"}]}]]
    got = {(r.component, r.version): (r.cve, r.ghsa) for r in advisories.oss_index(raw(spark, *docs), gt).collect()}
    assert got == {("g:x", "2.0"): ("CVE-9-1", None), ("a", "1.0"): (None, "GHSA-A-B")}


def test_osv_package_names(spark):
    from pyspark.sql import functions as F

    rows = [("maven", "g:a", "pkg:maven/g/a@1", "g:a"), ("npm", "x", "pkg:npm/%40s/p@1.0", "@s/p"),
            ("nuget", "N", "pkg:nuget/N.X@1", "N.X"), ("pypi", "p", "pkg:pypi/q@1", "p"), ("npm", "x", None, "x"),
            ("maven", "g:a", "pkg:npm/a@1", None)]
    df = spark.createDataFrame(rows, "e string, c string, p string, want string")
    got = df.select("want", advisories.osv_package(F.col("e"), F.col("c"), F.col("p")).alias("x")).collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_nuget_linked_pages(spark):
    index = spark.createDataFrame([("p", json.dumps({"items": [{"@id": "u1"}]}))], "package string, payload string")
    assert registries.nuget(index).count() == 0
    entry = {"items": [{"catalogEntry": {"version": "1.0", "published": "2020-01-02T00:00:00Z"}}]}
    pages = spark.createDataFrame([("u1", json.dumps(entry))], "page_id string, payload string")
    assert [r.version for r in registries.nuget(index, pages).collect()] == ["1.0"]


def test_source_registry(spark, tmp_path):
    assert {"dtrack", "github", "oss-index", "osv", "snyk", "trivy"} <= set(base.source_names())
    with pytest.raises(ValueError):
        base.source("none")
    (tmp_path / "a.json").write_text('{"vulnerabilities": []}')
    assert base.read_documents(spark, str(tmp_path)).count() == 1


def test_plans(spark):
    from siftmark.plans import comparison, scoring
    from workload.views import TOOLS, view

    d = "/root/testdata/sf0.001"
    gt, found = view(spark, d, "gt0"), view(spark, d, "findings")
    aliases = gt.selectExpr("ecosystem", "component", "cve as alias")
    out = scoring.score(gt, found, [*TOOLS, "quiet"], aliases, silent=["quiet"])
    scores = out["metrics"].collect()
    assert {r.tool for r in scores} == {*TOOLS, "quiet"}
    assert all(r.TP + r.FN == r.Vulnerabilities for r in scores if r.tool != "quiet")
    assert all(r.TP == r.FN == 0 for r in scores if r.tool == "quiet")
    n_missed = sum(r.FN for r in scores)
    missed = out["false_negatives"].agg({"n_rows": "sum"}).collect()[0][0]
    assert missed == n_missed
    both = comparison.compare(gt, [found, found], TOOLS, "oss-index")
    assert both["tests"].count() == 3
    assert all(r.std == 0 for r in both["aggregate"].collect())
