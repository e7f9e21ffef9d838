"""Version keys and range dialects against the packaging library and stated cases."""

import random

import pytest
from pyspark.sql import functions as F

from siftmark.functions import ranges as R
from siftmark.functions import versions as V

packaging = pytest.importorskip("packaging.version")
from packaging.specifiers import InvalidSpecifier, SpecifierSet  # noqa: E402
from packaging.version import InvalidVersion, Version  # noqa: E402


def parse(text):
    try:
        return Version(text)
    except InvalidVersion:
        return None


def random_version(rnd):
    text = rnd.choice(["", "", "", "v", "1!"])
    numbers = [0, 0, 1, 2, 10, 9, 100, 99999, 100000, 20240131]
    text += ".".join(str(rnd.choice(numbers)) for _ in range(rnd.randint(1, 5)))
    text += rnd.choice(["", "", "", "a1", "b", "rc2", ".alpha.3", "-preview-1", "c9", "pre"])
    text += rnd.choice(["", "", "", ".post1", "-3", "post", "r4", ".rev"])
    text += rnd.choice(["", "", "", ".dev0", "dev", "-dev3"])
    text += rnd.choice(["", "", "", "+l", "+1.abc", "+abc-2", "+12"])
    if rnd.random() < 0.05:
        text += rnd.choice(["x", " ", "-", "beta beta", "..1"])
    return text


def test_key_orders_like_packaging(spark):
    rnd = random.Random(7)
    texts = sorted({random_version(rnd) for _ in range(1500)} | {"", "1.0", "1.0.0", "01.0"})
    rows = (
        spark.createDataFrame([(t,) for t in texts], "v string")
        .select("v", V.version_key(F.col("v")).alias("k"), V.is_stable(F.col("v")).alias("stable"))
        .collect()
    )
    assert [r.v for r in rows if (parse(r.v) is None) != (r.k is None)] == []
    known = [(parse(r.v), r.k) for r in rows if r.k is not None]
    for _ in range(100_000):
        (a, ka), (b, kb) = rnd.choice(known), rnd.choice(known)
        assert (a < b, a == b) == (ka < kb, ka == kb), (a, b)
    for r in rows:
        v = parse(r.v)
        assert r.stable == (v is not None and not v.is_prerelease and not v.is_devrelease)


def test_specifier_sets_like_packaging(spark):
    rnd = random.Random(11)
    pairs = []
    for _ in range(2500):
        parts = []
        for _ in range(rnd.choice([1, 1, 2])):
            v = random_version(rnd)
            if rnd.random() < 0.2:
                v = ".".join(str(rnd.choice([0, 1, 2])) for _ in range(rnd.randint(1, 3))) + ".*"
            parts.append(rnd.choice(["~=", "==", "!=", "<=", ">=", "<", ">"]) + v)
        base = parts[0].lstrip("~=!<>").replace(".*", "").split("+")[0]
        v = base + rnd.choice(["", ".post1", "+l", ".dev1", "a1", ".0", ".1"])
        # A post-release above a development bound differs between library releases.
        if not (any(p.startswith(">") and "dev" in p for p in parts) or parse(v) is None):
            pairs.append((v, ",".join(parts)))
    got = (
        spark.createDataFrame(pairs, "v string, s string")
        .select("v", "s", R.in_specifier_set(F.col("v"), F.col("s")).alias("r"))
        .collect()
    )
    for r in got:
        try:
            want = Version(r.v) in SpecifierSet(r.s)
        except InvalidSpecifier:
            want = None
        assert r.r == want, (r.v, r.s)


def check(spark, rows, column):
    width = len(rows[0]) - 1
    names = [f"c{i}" for i in range(width)]
    df = spark.createDataFrame([r[:-1] for r in rows], ", ".join(f"{n} string" for n in names))
    got = df.select(*names, column(*[F.col(n) for n in names]).alias("x")).collect()
    want = {r[:-1]: r[-1] for r in rows}
    assert {tuple(r)[:-1]: r.x for r in got} == want


def test_bare_ranges(spark):
    check(spark, [
        ("1.5", ">=1.0,<2.0", True), ("2.0", ">=1.0,<2.0", False), ("1.0", ">1.0", False),
        ("1.0", "<=1.0.0", True), ("2.0rc1", "<2.0", True), ("bad", "<2.0", False),
        ("1.0", "<bad", False), ("9.0", "[1.0,2.0)", True), ("9.0", "~=1", True),
        ("1.0", "==1", True), ("1.1", "== 1.0 , <3", False), ("1.0", "!=1.0", True),
    ], R.in_bare_range)


def test_normalised_ranges(spark):
    check(spark, [
        ("1.5", "[1.0,2.0)", True), ("2.0", "[1.0,2.0)", False), ("1.4.4", "(,1.4.4]", True),
        ("5", "[1.0,)", True), ("1.5", "1.0 - 2.0", True), ("v1.2+b", ">=v1.0, < 2", True),
        ("1.2.9", "==1.2.*", True), ("1.3", "~=1.2", True), ("2.0", "~=1.2", False),
        ("1.0", "", False), ("1.0", "latest", False), ("1.0", "^1.0", False),
    ], R.in_normalized_range)


def test_semver_verdicts(spark):
    check(spark, [
        ("npm", "1.2.3", "^1.0.0", "IN_RANGE"), ("npm", "1.2.3", ">=1.0 <1.2", "OUT_OF_RANGE"),
        ("npm", "1.2.3", ">= 1.0, < 2.0", "UNDECIDABLE"), ("npm", "1.2.3", "1.x || 3", "IN_RANGE"),
        ("npm", "2.0.0-rc.1", "<2.0.0", "OUT_OF_RANGE"),
        ("npm", "2.0.0-rc.1", ">=2.0.0-rc.0 <3", "IN_RANGE"),
        ("maven", "1.5", "[1.0,2.0)", "IN_RANGE"), ("maven", "2.0", "[1.0,2.0)", "OUT_OF_RANGE"),
        ("maven", "x", "[1.0,2.0)", "UNDECIDABLE"), ("pypi", "1.0", "< 2.0", "IN_RANGE"),
        ("npm", "1.3.0", "~1.2", "OUT_OF_RANGE"), ("npm", "1.3.0", "1.0.0 - 1.3", "IN_RANGE"),
        ("npm", "0.3.0", "^0.2.3", "OUT_OF_RANGE"), ("npm", "1.0", "", "UNDECIDABLE"),
        ("npm", "1.3.0", ">1.2", "IN_RANGE"), ("npm", "1.2.9", ">1.2", "OUT_OF_RANGE"),
    ], R.semver_range_verdict)
    check(spark, [("npm", "1.2.3", ">= 1.0, < 2.0", "IN_RANGE")],
          lambda e, v, r: R.semver_range_verdict(e, v, r, join_spaced=True))


def test_event_lists(spark):
    schema = "v string, events array<struct<introduced string, fixed string, last_affected string>>"
    rows = [
        ("1.0", [("0", None, None), (None, "2.0", None)], True, True),
        ("2.0", [("0", None, None), (None, "2.0", None)], False, False),
        ("9.0", [("1.0", None, None)], True, True),
        ("9.0", [("0", None, None)], True, False),
        ("2.5", [("1.0", None, None), (None, "2.0", None), ("3.0", None, None), (None, "4.0", None)], False, False),
        ("3.5", [("1.0", None, None), (None, "2.0", None), ("3.0", None, None), (None, "4.0", None)], True, True),
        ("1.0", [("0", None, None), (None, "bad", None)], False, False),
        ("2.0", [("1.0", None, None), (None, None, "2.0")], True, True),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], schema)
    affected = F.array(F.struct(
        F.array().cast("array<string>").alias("versions"),
        F.array(F.struct(F.lit("SEMVER").alias("type"), F.col("events"))).alias("ranges"),
    ))
    got = df.select(
        R.is_affected(F.col("v"), affected).alias("walk"),
        F.coalesce(R.in_specifier_set(F.col("v"), R.events_to_specifier(F.col("events"))), F.lit(False)).alias("last"),
    ).collect()
    assert [(r.walk, r.last) for r in got] == [r[2:] for r in rows]


def test_cpe_bounds(spark):
    schema = ("v string, version string, version_start_including string, version_start_excluding string,"
              "version_end_including string, version_end_excluding string")
    rows = [
        (("1.0", None, None, None, None, None), True), (("1.0", "1.0.0", None, None, None, None), True),
        (("1.1", "1.0", None, None, None, None), False), (("1.0", None, "1.0", None, None, "2.0"), True),
        (("2.0", None, "1.0", None, None, "2.0"), False), (("1.0", None, None, "1.0", None, None), False),
        (("2.0", None, None, None, "2.0", None), True), (("x", None, None, None, None, None), False),
        (("1.0", None, None, None, "x", None), False),
    ]
    df = spark.createDataFrame([r[0] for r in rows], schema)
    node = F.struct(*df.columns[1:])
    got = [r.x for r in df.select(R.in_cpe_bounds(F.col("v"), node).alias("x")).collect()]
    assert got == [r[1] for r in rows]
