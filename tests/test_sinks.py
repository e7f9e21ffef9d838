"""Sets of tables that are switched at once, and results as documents."""

import json
import os

import pytest
from pyspark.sql import functions as F

from siftmark.operators import payloads
from siftmark.plans import comparison, dataset_build
from siftmark.sinks import committed


def test_a_killed_writer_leaves_the_old_set(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(ValueError):
        committed.read_set(spark, path)
    numbers, empty = spark.range(5), spark.createDataFrame([], "a string, b array<int>")
    made = committed.write_set(spark, {"numbers": numbers, "empty": empty}, path)
    assert {t: x["rows"] for t, x in made["tables"].items()} == {"numbers": 5, "empty": 0}
    broken = numbers.select(F.raise_error(F.lit("killed")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        committed.write_set(spark, {"numbers": spark.range(9), "broken": broken}, path)
    old = committed.read_set(spark, path)
    assert old["numbers"].count() == 5 and old["empty"].schema == empty.schema
    # The run that is made again is the current set and the only one.
    committed.write_set(spark, {"numbers": spark.range(9)}, path)
    assert committed.read_set(spark, path)["numbers"].count() == 9
    assert committed.manifest(spark, path)["tables"]["numbers"]["rows"] == 9
    assert len([x for x in os.listdir(path) if not x.startswith(".")]) == 2


def payload(df):
    return json.loads(df.first()["payload"])


def test_payloads(spark):
    stats = spark.createDataFrame([("t", "npm", "TP", 1.5, 0.5, 2, 0.7), ("a", "npm", "TP", 1.0, 0.0, 2, 0.0)],
                                  "tool string, ecosystem string, metric string, mean double, std double, n long, ci95 double")
    assert payload(payloads.statistics_payload(stats)) == {"metrics": {
        "a": {"npm": {"TP": {"mean": 1.0, "std": 0.0, "n": 2, "ci95": 0.0}}},
        "t": {"npm": {"TP": {"mean": 1.5, "std": 0.5, "n": 2, "ci95": 0.7}}}}}
    assert payload(payloads.results_payload(stats.selectExpr("tool", "ecosystem", "metric", "mean as value"))) == {
        "a": {"npm": {"TP": 1.0}}, "t": {"npm": {"TP": 1.5}}}
    stable = spark.createDataFrame([("t", True, "x,x"), ("a", False, "x,y")], "tool string, stable boolean, fingerprints string")
    assert payload(payloads.repeats_payload(stable)) == {
        "a": {"stable": False, "hashes": ["x", "y"]}, "t": {"stable": True, "hashes": ["x", "x"]}}
    q = spark.createDataFrame([(2.0, 1, 0.1)], "statistic double, df int, p_value double")
    tests = spark.createDataFrame([("b", "c", 1, 2, 0.5, 0.5), ("a", "b", 3, 4, 0.1, None)],
                                  "tool_a string, tool_b string, n10 long, n01 long, p double, p_adj double")
    said = payload(payloads.significance_payload(q, tests, ["b", "a"], 2, 7))
    assert said["matrix_shape"] == [14, 2] and said["cochran_q"] == {"statistic": 2.0, "p_value": 0.1}
    assert [(r["tool_a"], r["p_adj"]) for r in said["pairwise_mcnemar"]] == [("a", None), ("b", 0.5)]
    summary = spark.createDataFrame([("b", 2), ("a", 1)], "tool string, rank int")
    none = spark.createDataFrame([], "tool string, marker string")
    assert payload(payloads.summary_payload(summary, none, "a")) == {
        "baseline": "a", "markers": {}, "tools": [{"rank": 1, "tool": "a"}, {"rank": 2, "tool": "b"}]}


def test_plans_give_their_documents(spark):
    gt = spark.createDataFrame([(f"{i}", "npm", "a", "1", f"CVE-{i}", None, None) for i in range(4)],
                               "ord string, ecosystem string, component string, version string, cve string, ghsa string, osv_id string")
    found = spark.createDataFrame([(t, f"{t}{i}", "npm", "a", "1", f"CVE-{i}", None, None, None) for t, n in (("a", 3), ("b", 1)) for i in range(n)],
                                  "tool string, ord string, ecosystem string, component string, version string, cve string, "
                                  "ghsa string, osv_id string, affected_version_range string")
    out = comparison.compare(gt, [found, found], ["a", "b"], "b")
    assert payload(out["significance_payload"])["matrix_shape"] == [8, 2]
    assert {t: x["stable"] for t, x in payload(out["repeats_payload"]).items()} == {"a": True, "b": True}
    assert payload(out["statistics_payload"])["metrics"]["a"]["npm"]["TP"]["mean"] == 3.0
    assert payload(out["summary_payload"])["baseline"] == "b" and set(payload(out["results_payload"])) == {"a", "b"}
    rows = spark.createDataFrame([(f"{i}", e, f"c{i % 3}", "1", f"pkg:{e}/c{i % 3}@1", f"V{i}", None) for e, n in (("npm", 9), ("pypi", 4)) for i in range(n)],
                                 "ord string, ecosystem string, component_name string, component_version string, purl string, vulnerability_id string, cve string")
    responses = rows.groupBy("ecosystem", "component_name", "component_version").agg(F.collect_list("vulnerability_id").alias("vulnerability_ids"))
    texts = rows.selectExpr("vulnerability_id as id", "'s' as summary", "'' as details").distinct()
    built = dataset_build.build(rows, responses, texts, ["npm", "pypi"], strategy="min", timestamp="2024")
    assert built["rows"].groupBy("ecosystem").count().collect()[0]["count"] == 4 == built["rows"].count() / 2
    properties = json.loads(built["bom_envelope"].first()["envelope"])["metadata"]["component"]["properties"]
    assert {p["name"]: p["value"] for p in properties}["dataset.vulnerabilities"] == "8"
