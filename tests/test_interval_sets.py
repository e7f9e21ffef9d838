"""Compiled ranges against the tests they replace, and the index of all intervals over a point."""

import random

import pytest
from pyspark.sql import functions as F

from siftmark.functions import interval_sets as I
from siftmark.functions import ranges as R
from siftmark.functions import versions as V
from siftmark.operators.intervals import stabbing
from siftmark.sources import advisories


def random_version(rnd):
    v = rnd.choice(["", "", "", "v", "1!"]) + ".".join(str(rnd.choice([0, 0, 1, 2, 10, 123456])) for _ in range(rnd.randint(1, 3)))
    v += rnd.choice([""] * 6 + ["rc1", "a0", ".dev1", "b2.dev3"]) + rnd.choice([""] * 5 + [".post0", ".post1", "-2"])
    v += rnd.choice([""] * 7 + [".dev2"]) + rnd.choice([""] * 6 + ["+abc", "+1.2"])
    return v if rnd.random() > 0.03 else "x" + v


def random_set(rnd):
    parts = []
    for _ in range(rnd.choice([0, 1, 1, 2, 3])):
        bound = random_version(rnd)
        if rnd.random() < 0.25:
            bound = ".".join(str(rnd.choice([0, 1, 2])) for _ in range(rnd.randint(1, 3))) + ".*"
        parts.append(rnd.choice(["===", "~=", "==", "!=", "<=", ">=", "<", ">", "<", ">", ""]) + rnd.choice(["", " "]) + bound)
    return ",".join(parts)


def crossed(spark, versions, texts):
    return spark.createDataFrame([(v, t) for v in versions for t in texts], "version string, text string")


def test_specifier_sets(spark):
    rnd = random.Random(1)
    both = crossed(spark, [random_version(rnd) for _ in range(60)], [random_set(rnd) for _ in range(120)])
    told = both.select(
        R.in_specifier_set(F.col("version"), F.col("text")).alias("want"),
        I.in_specifier_intervals(F.col("version"), I.specifier_set(F.col("text"))).alias("got"), "version", "text",
    )
    assert told.where("not (want <=> got)").collect() == []
    assert {r["want"] for r in told.select("want").distinct().collect()} == {True, False, None}


def test_npm_sets(spark):
    texts = [">=1.0.0-alpha <2.0.0", "^1.2.3 || ~0.2", "<1.0.0-rc.1 || >=3", "1.x || >=2.0.0-beta.2 <2.1.0", "*", ">1 <1", "^0.0.3"]
    versions = ["1.0.0", "1.0.0-alpha", "1.0.0-beta", "1.2.9", "2.0.0-beta.2", "2.0.0-beta.1", "2.0.5", "3.1.0", "0.2.7", "0.0.3", "0.9"]
    both = crossed(spark, versions, texts).select(
        "version", "text", R.semver_key(F.col("version")).alias("key"), R.npm_range(F.col("text")).alias("groups"))
    inside = F.exists(I.npm_set(F.col("groups")), lambda i: F.array_contains(I.semver_lanes(F.col("key")), i["lane"])
                      & (i["lower"] < V.point(F.col("key"))) & (V.point(F.col("key")) < i["upper"]))
    assert both.where(inside != R._npm_holds(F.col("key"), F.col("groups"))).collect() == []


def test_disjoint(spark):
    rows = [[("a", "1", "3"), ("a", "2", "5"), ("b", "2", "3"), ("a", "7", "7"), ("a", "5", "6"), ("a", "8", "9")], []]
    got = spark.createDataFrame([(r,) for r in rows], f"x {I.INTERVALS}").select(I.disjoint(F.col("x")).alias("y")).collect()
    assert sorted([[tuple(i) for i in r["y"]] for r in got]) == [[], [("a", "1", "6"), ("a", "8", "9"), ("b", "2", "3")]]


@pytest.mark.parametrize("hot", [False, True])
def test_stabbing(spark, hot):
    """Every interval over a point and no other, also when a third of all is in one group."""
    rnd = random.Random(2)
    group = lambda: "hot" if hot and rnd.random() < 0.4 else rnd.choice("abc")
    points = [(group(), f"p{i}", f"{rnd.randint(0, 99):03d}!") for i in range(150)]
    intervals = []
    for i in range(80):
        low, high = sorted(rnd.sample(range(100), 2))
        intervals.append((group(), i, f"{low:03d}", f"{high:03d}"))
    got = stabbing(
        spark.createDataFrame(points, "g string, name string, position string"),
        spark.createDataFrame(intervals, "g string, i long, lower string, upper string"), ["g"], "name", ["i"],
    )
    want = sorted((g, n, i) for g, n, p in points for h, i, lo, hi in intervals if g == h and lo < p < hi)
    assert sorted(map(tuple, got.collect())) == want


def test_github_verdicts(spark):
    """Each pair of version and range as a verdict on the pair would have it."""
    ranges = ["<2.0", ">= 1.0, < 2.0", "[1.0,2.0)", "(,1.5]", "[1.0,abc)", "[abc,2.0]", None, "", "===1.5", "===V1.5", ">=1.0.0-rc.1 <2.0.0",
              "~=1.4", "!=1.5", "nonsense", "<1.5||>=2.0.0", "==1.*"]
    versions = ["1.0", "1.5", "1.5.post1", "1.5+x", "2.0rc1", "2.0.0-rc.1", "1.0.0-rc.2", "3", "abc", "v1.5", "1.0-weird", ""]
    raw = [(f"{k}", gh, "pkg", '{"data":{"securityVulnerabilities":{"nodes":[{"vulnerableVersionRange":%s,"advisory":{"ghsaId":"GHSA-%d"}}]}}}'
            % ("null" if r is None else f'"{r}"', k)) for k, r in enumerate(ranges) for gh in ("PIP", "NPM")]
    gt = [(e, "pkg", v) for e in ("pypi", "npm") for v in versions]
    got = advisories.github(
        spark.createDataFrame([(f"{gh}{o}", gh, p, x) for o, gh, p, x in raw], "ord string, github_ecosystem string, package string, payload string"),
        spark.createDataFrame(gt, "ecosystem string, component string, version string"),
    )
    pairs = spark.createDataFrame([(e, v, r, f"GHSA-{k}") for e, _, v in gt for k, r in enumerate(ranges)],
                                  "ecosystem string, version string, text string, ghsa string")
    verdict = R.semver_range_verdict(F.col("ecosystem"), F.col("version"), F.col("text"))
    want = pairs.where(verdict != R.OUT_OF_RANGE).select("ecosystem", "version", "ghsa")
    assert sorted(map(tuple, got.select("ecosystem", "version", "ghsa").collect())) == sorted(map(tuple, want.collect()))
