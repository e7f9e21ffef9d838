"""Landed files, broken documents, white space and escapes, rows that come twice."""

import json

import pytest
from pyspark.sql import functions as F

from siftmark.functions import purl, ranges, text
from siftmark.operators import balancing, coverage, datasets, matching, ranking, significance
from siftmark.plans import authority as authority_plan
from siftmark.plans import comparison, scoring
from siftmark.session import discard_written, shared_folder, written
from siftmark.sources import authority, base, ground_truth, registries, scanners

FINDING = ("tool string, ord string, ecosystem string, component string, version string, cve string, "
           "ghsa string, osv_id string, affected_version_range string")
GT = "ord string, ecosystem string, component string, version string, cve string, ghsa string, osv_id string"


def value(spark, column, given):
    return spark.createDataFrame([(given,)], "x string").select(column(F.col("x"))).first()[0]


def test_lines_keep_their_order_and_their_copies(spark, tmp_path):
    for name, ns in (("b.jsonl", [2, 1, 2]), ("a.jsonl", [7, 7])):
        (tmp_path / name).write_text("".join(json.dumps({"n": n}) + "\n" for n in ns))
    rows = base.read_lines(spark, str(tmp_path)).orderBy("ord").collect()
    assert [json.loads(r.payload)["n"] for r in rows] == [7, 7, 2, 1, 2]
    assert len({r.ord for r in rows}) == 5


def test_csv_rows_keep_their_order_and_their_copies(spark, tmp_path):
    names = ["ecosystem", "component_name", "component_version", "vulnerability_id"]
    lines = ["npm,z,1,V1", "npm,a,1,V2", "npm,z,1,V1"]
    (tmp_path / "gt.csv").write_text("\n".join([",".join(names), *lines]) + "\n")
    rows = ground_truth.read_rows(spark, str(tmp_path / "gt.csv")).orderBy("ord").collect()
    assert [r.component_name for r in rows] == ["z", "a", "z"] and len({r.ord for r in rows}) == 3


def test_equal_findings_count_like_their_rows(spark, tmp_path):
    lines = [{"tool": "t", "ecosystem": "npm", "component": "a", "version": "1", "cve": "CVE-1"}] * 2
    (tmp_path / "f.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    landed = base.read_lines(spark, str(tmp_path))
    schema = FINDING.replace("ord string, ", "")
    findings = landed.select("ord", F.from_json("payload", schema).alias("f")).select("ord", "f.*")
    gt = spark.createDataFrame([("g", "npm", "a", "1", "CVE-1", None, None)], GT)
    hits = matching.matched_signatures(gt, findings, ["tool"])
    assert matching.false_positives(findings, hits).count() == 1


def test_documents_that_are_no_reports_are_named(spark):
    docs = [("1", '{"vulnerabilities": []}'), ("2", "oops"), ("3", "{}"), ("4", '{"vulnerabilities": "x"}'), ("5", "[]"), ("6", None)]
    raw = spark.createDataFrame(docs, "ord string, payload string")
    findings, rejects = base.source("snyk").collect(raw)
    assert findings.count() == 0
    assert {r.ord: r.reason for r in rejects.collect()} == {
        "2": "no JSON", "3": "no vulnerabilities", "4": "vulnerabilities is of another kind", "5": "no vulnerabilities", "6": "no JSON"}
    assert base.accepted(raw.where("ord = '1'"), scanners.SNYK, "vulnerabilities").count() == 1
    with pytest.raises(Exception, match="no JSON"):
        base.accepted(raw.where("ord in ('1', '2')"), scanners.SNYK, "vulnerabilities").collect()
    _, rejects = base.source("trivy").collect(spark.createDataFrame(
        [("1", "{}"), ("2", '{"Results": null}'), ("3", '{"Results": 3}'), ("4", '{"Results": [')], "ord string, payload string"))
    assert {r.ord: r.reason for r in rejects.collect()} == {"3": "Results is of another kind", "4": "no JSON"}


def test_findings_and_rejects_of_several_tools(spark):
    v = {"packageName": "a", "version": "1", "packageUrl": "pkg:npm/a@1", "identifiers": {"CVE": ["CVE-1"]}}
    t = {"PkgName": "b", "InstalledVersion": "2", "PkgIdentifier": {"PURL": "pkg:npm/b@2"}, "VulnerabilityID": "CVE-2"}
    raw = {
        "snyk": spark.createDataFrame([("1", json.dumps({"vulnerabilities": [v]})), ("2", "{")], "ord string, payload string"),
        "trivy": spark.createDataFrame([("1", json.dumps({"Results": [{"Vulnerabilities": [t]}]})), ("2", "{")], "ord string, payload string"),
    }
    findings, rejects = scoring.collect_findings(raw, None)
    assert {(r.tool, r.component, r.cve) for r in findings.collect()} == {("snyk", "a", "CVE-1"), ("trivy", "b", "CVE-2")}
    assert {tuple(r) for r in rejects.collect()} == {("snyk", "2", "no JSON"), ("trivy", "2", "no JSON")}


def test_maven_metadata_is_read_as_xml(spark):
    docs = [
        ("p", "<metadata><versioning><versions><version> 1.0 </version><!-- <version>9</version> --></versions></versioning></metadata>"),
        ("q", "<bad"), ("r", "<a><version>2.0</version><version>3.0-rc1</version>"), ("s", None), ("t", ""),
        ("u", "<a xmlns:m='x'><version><![CDATA[4.0]]></version><version>5&#46;0</version><m:version>6.0</m:version>"
              "<b><version k='1'>7.0</version><version/></b><versions>8.0</versions></a>"),
    ]
    raw = spark.createDataFrame([(p, p, x) for p, x in docs], "ord string, package string, payload string")
    parsed = registries.landed_xml(raw)
    assert {(r.package, r.version) for r in registries.maven(parsed).collect()} == {("p", "1.0"), ("u", "4.0"), ("u", "5.0"), ("u", "7.0")}
    assert {(r.ord, r.reason) for r in base.rejects(parsed).collect()} == {(x, "no XML") for x in "qrst"}


def test_every_white_space_counts(spark):
    odd = "  one  two\x1f　"
    assert value(spark, text.strip, odd) == "one  two"
    assert value(spark, lambda c: text.clean_description(c, F.lit("")), odd) == "one two"
    assert value(spark, text.shorten, odd) == "one two"


def test_a_stray_percent_sign_stays(spark):
    for given, wanted in [("%40a%zz", "@a%zz"), ("a+b%", "a+b%"), ("%2F%", "/%"), ("100%25", "100%")]:
        assert value(spark, purl.percent_decode, given) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("[2.1,2.9)", ">=2.1,<2.9"), ("(,7]", "<=7"), ("[4.0.1,)", ">=4.0.1"), ("(,)", None), ("[1,2),[3,4)", None),
    ("3.1 - 3.8", ">=3.1,<=3.8"), ("3.1-rc - 3.8", ">=3.1-rc,<=3.8"), ("v5-6", ">=5,<=6"), ("3- 4", ">=3,<=4"),
    ("1 - 2 - 3", None), ("5-", None), (">= 6.2, < 8", ">=6.2,<8"), ("^2.0", None), (">=", None), ("", None), ("9.9", None),
    ("!=3,~=4.1", "!=3,~=4.1"),
])
def test_notations(spark, given, wanted):
    assert value(spark, ranges.normalized_specifier, given) == wanted


def test_an_advisory_that_comes_twice_multiplies_nothing(spark):
    rows = spark.createDataFrame([("1", "npm", "a", "1", "V1", None)],
                                 "ord string, ecosystem string, component_name string, component_version string, vulnerability_id string, cve string")
    texts = spark.createDataFrame([("V1", "b", ""), ("V1", "a", "")], "id string, summary string, details string")
    assert [r.vulnerability_description for r in datasets.enrich(rows, texts).collect()] == ["a"]


def test_a_record_that_comes_twice_multiplies_nothing(spark):
    gt = spark.createDataFrame([("1", "npm", "a", "1", "CVE-1", None, None)], GT)
    doc = '{"id": "CVE-1", "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:a:a:1", "vulnerable": %s}]}]}]}'
    raw = spark.createDataFrame([("x", doc % "true"), ("y", doc % "true")], "ord string, payload string")
    assert coverage.nvd_coverage(gt, authority.records(raw)).count() == 1
    plans = authority_plan.cover(gt, raw)
    assert plans["verdicts"].first()["bucket"] == "PRODUCT_MATCHED" and plans["completeness"].count() > 0
    nulls = spark.createDataFrame([("x", doc % "null")], "ord string, payload string")
    assert authority.records(nulls).first()["cpe_nodes"] == []
    with pytest.raises(ValueError, match="empty"):
        authority_plan.cover(gt.limit(0), raw)


def test_nothing_to_balance_is_an_error(spark):
    rows = spark.createDataFrame([], "ord string, ecosystem string, component_name string, component_version string")
    with pytest.raises(ValueError):
        balancing.allotments(rows, ["npm"])


def test_rows_of_one_key_are_numbered_in_many_tasks(spark):
    prefix = "the same sixty characters stand in front of every order text "
    df = spark.range(20000).selectExpr("'k' as k", f"concat('{prefix}', lpad(cast(id * 7919 % 20000 as string), 6, '0')) as o")
    got = ranking.row_number_within(df.repartition(8), ["k"], "o", "n")
    assert got.selectExpr("bool_and(n = cast(right(o, 6) as int) + 1) ok", "count(*) n").first() == (True, 20000)
    same = spark.range(3000).selectExpr("cast(null as string) as k", "'x' as o")
    assert sorted(r.n for r in ranking.row_number_within(same, ["k"], "o", "n").collect()) == list(range(1, 3001))


def test_patterns_from_keys_are_those_of_the_vectors(spark):
    gt = spark.createDataFrame([(f"{i:03}", "npm", f"c{i % 4}", "1", f"CVE-{i % 3}", None, f"O{i % 5}") for i in range(40)], GT)
    found = [(t, f"{t}{i}", "npm", f"c{i % 4}", "1", f"CVE-{i % 3}" if t != "b" else None, None, f"O{i % 5}" if t == "b" else None, None)
             for t, n in (("a", 5), ("b", 9), ("c", 1)) for i in range(n)]
    findings = spark.createDataFrame(found, FINDING)
    tools = ["a", "b", "c", "none"]
    vectors = significance.detection_vector(gt, findings, tools).withColumn("repeat", F.lit(1))
    bag = lambda df: {tuple(map(tuple, r.pattern)): r.n for r in df.collect()}
    assert bag(significance.key_patterns(gt, findings, tools)) == bag(significance.patterns(vectors))
    out = comparison.compare(gt, [findings, findings], tools, "a")
    assert out["tests"].count() == 6 and out["cochran_q"].count() == 1
    payload = json.loads(out["payload"].first()["payload"])
    assert sorted(payload["ranking_by_avg_recall"]) == tools and len(payload["per_tool"]) == 4


def test_a_missing_repeat_is_an_error(spark):
    gt = spark.createDataFrame([(f"{i}", "npm", "a", "1", f"CVE-{i}", None, None) for i in range(3)], GT)
    found = spark.createDataFrame([(t, t, "npm", "a", "1", "CVE-1", None, None, None) for t in "ab"], FINDING)
    runs = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("c", 1), ("c", 2)], "tool string, repeat int")
    with pytest.raises(ValueError, match=r"\('b', 2\)"):
        comparison.compare(gt, [found, found.where("tool = 'a'")], ["a", "b", "c"], "a", runs)
    out = comparison.compare(gt, [found, found.where("tool = 'a'")], ["a", "c"], "a", runs)
    assert {(r.tool, r.TP) for r in out["runs"].collect()} == {("a", 1), ("c", 0)}


def test_archived_vectors_are_held_against_their_manifest(spark):
    rows = [(t, r, f"{i}", i % 2) for t in "ab" for r in (1, 2) for i in range(4)]
    archived = spark.createDataFrame(rows, "tool string, repeat int, ord string, detected int")
    manifest = spark.createDataFrame([(t, r, 4) for t in "ab" for r in (1, 2)], "tool string, repeat int, length long")
    assert significance.combine_vectors(archived, manifest).count() == 16
    with pytest.raises(ValueError, match="no detections of"):
        significance.combine_vectors(archived.where("tool = 'a' or repeat = 1"), manifest)
    with pytest.raises(ValueError, match=r"another length: \[\('b', 2, 3, 4\)\]"):
        significance.combine_vectors(archived.where("tool = 'a' or repeat = 1 or ord < '3'"), manifest)
    with pytest.raises(ValueError, match="does not list"):
        significance.combine_vectors(archived, manifest.where("tool = 'a'"))


def test_written_tables_can_be_discarded(spark):
    import glob

    kept = written(spark.range(3))
    folder = shared_folder(spark).removeprefix("file:")
    assert kept.count() == 3 and glob.glob(f"{folder}/written-*")
    discard_written(spark)
    assert not glob.glob(f"{folder}/written-{spark.sparkContext.applicationId}-*")


def test_sizes_and_prefix_of_package_lists(spark):
    listed = spark.createDataFrame([("npm", f"p{i}", f"{i:05}") for i in range(1500)] + [("pypi", "q", "1")],
                                   "ecosystem string, component_name string, ord string")
    assert [tuple(r) for r in datasets.universe_sizes(listed, {"npm": 1500, "pypi": 2}).collect()] == [("pypi", 1, 2)]
    got = datasets.universe_prefix(listed, 1200).collect()
    assert {r.ord for r in got if r.ecosystem == "npm"} == {f"{i:05}" for i in range(1200)} and len(got) == 1201
