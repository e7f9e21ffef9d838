"""Operators on documents against plain versions, with the awkward cases."""

import pytest

from siftmark.llm import decontamination, lines, packing, quality, queries, sharding, simhash
from tests.llm import brute
from tests.llm.data import ODD, SF, odd_documents, ordered, pairs, rows

ITEMS = [(1, " ".join(f"word{i}é" for i in range(20, 60))), (2, "one TWO three, four"), (3, None), (4, ""),
         (5, "zz yy"), (5, "zz yy"), (None, "one two three four"), (6, "a b a b a b a b a b a b a b a b")]


def documents(spark, which):
    if which == "odd":
        return odd_documents(spark)
    if which == "twice":
        return odd_documents(spark).union(odd_documents(spark))
    if which == "empty":
        return odd_documents(spark).limit(0)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("which", ["odd", "twice", "empty", "sf"])
def test_decontamination(spark, which):
    docs = documents(spark, which)
    if which == "sf":
        items = spark.read.parquet(f"{SF}/benchmark.parquet")
        plain = [tuple(r) for r in items.select("item_id", "text").collect()]
    else:
        plain, items = ITEMS, spark.createDataFrame(ITEMS, "item_id long, text string")
    want = ordered(brute.decontamination(pairs(docs), plain))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for block in (32 << 20, 200):
        got = queries.decontamination_digests(docs, items, block_bytes=block)
        assert rows(got, *columns) == want
    kept = decontamination.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(rows(kept, "doc_id")) == sorted((w[0],) for w in want if not w[-1])


def test_decontamination_without_tests(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    found = decontamination.find_matches(odd_documents(spark, False), items)
    assert {(r["n_words"] >= 0, len(r["hits"]), len(r["items"]), r["longest"]) for r in found.collect()} == {(True, 0, 0, 0)}


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(30)) + " y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(5, 40)))], "item_id long, text string")
    row = decontamination.find_matches(docs, items).first()
    assert (row["longest"], [tuple(h) for h in row["hits"]], row["items"]) == (25, [(6, 31)], [1])


@pytest.mark.parametrize("which", ["odd", "twice", "empty", "sf"])
def test_packing(spark, which):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    tokenizer.encode_special_tokens = True
    docs = documents(spark, which)
    got = packing.digests(packing.pack_documents(docs, queries.TOKENIZER)).cache()
    want = brute.pieces(pairs(docs), tokenizer)
    assert rows(got, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == ordered(want)
    assert got.select("sequence_id").distinct().count() == len(want)
    assert {r["offset"] for r in got.select("offset").distinct().collect()} <= {0}


def test_buckets(spark, tmp_path):
    pieces = packing.pack_documents(odd_documents(spark), queries.TOKENIZER, max_len=64)
    packing.write_buckets(pieces, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == pieces.count()
    assert back.selectExpr("bool_and(length(ids) = 4 * length and length <= 64) as ok").first()["ok"]
    with pytest.raises(ValueError):
        packing.pack_documents(odd_documents(spark), queries.TOKENIZER, max_len=100)


@pytest.mark.parametrize("which", ["odd", "twice", "empty", "sf"])
def test_simhash(spark, which):
    docs = documents(spark, which)
    got = simhash.near_duplicates(docs)
    want = brute.near_duplicates(pairs(docs))
    assert rows(got, "doc_id", "fingerprint", "component_id") == ordered(want)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in rows(kept, "doc_id")) == sorted({w[2] for w in want})


def test_simhash_links_close_prints_in_tiles(spark):
    import random

    rnd, values = random.Random(4), set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(12):  # chains, so that components hold pairs farther apart
            values.add(x - (1 << 64) if x >> 63 else x)
            for _ in range(rnd.randint(1, 6)):
                x ^= 1 << rnd.randrange(64)
    marked = spark.createDataFrame([(i, v) for i, v in enumerate(sorted(values))], "doc_id long, fingerprint long")
    nodes = marked.select("fingerprint")
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    for count, tile in ((len(values), 2048), (len(values), 2), (1 << 30, 2048)):
        links = simhash.connected(simhash.near_links(nodes, count, tile=tile))
        got = {r["node"]: r["root"] for r in links.collect()}
        assert {v: got.get(v, v) for v in values} == {v: find(v) for v in values}


def test_repeats_and_counts(spark):
    docs = odd_documents(spark)
    got = quality.measure(docs).select("doc_id", "measures.*").drop("n_lines")
    assert rows(got, *got.columns) == ordered((i, *brute.words_base(t)) for i, t in enumerate(ODD))


def test_quality_guarantee(spark):
    """With enough labels the rule is certified; with few it rejects nothing."""
    clean = "these are plain words of a text that nobody would want to reject at all because it is long enough now"
    junk = " ".join(w + "***" for w in clean.split())
    docs = [(i, junk if i % 10 == 0 else clean, "en" if i < 9000 else "few", "s", 1) for i in range(9100)]
    labels = [(i, 0 if i % 10 == 0 else 1, 0) for i in range(9100)] + [(None, 1, 0), (1, None, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_verdicts(d, y)
    bad = {r["doc_id"] for r in got.where("not kept").collect()}
    assert bad == {i for i in range(0, 9000, 10)}
    assert quality.quality_verdicts(d, y.limit(0)).where("not kept").count() == 0
    assert quality.quality_verdicts(d.limit(0), y).count() == 0
    kept = quality.keep_good(odd_documents(spark), y)
    assert kept.columns == odd_documents(spark).columns


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 50, 0.05), (3, 100, 0.1), (9, 100, 0.1), (10, 100, 0.1), (40, 9000, 0.01)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(
            *[__import__("pyspark").sql.functions.lit(x).cast("bigint") for x in (k, n)], p)).first()[0]
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert got == pytest.approx(want if k < n * p else 1.0, rel=1e-9)


@pytest.mark.parametrize("which", ["odd", "twice", "empty", "sf"])
def test_sharding(spark, which):
    import zlib

    docs = documents(spark, which)
    got = sharding.shard_documents(docs, 7).collect()
    plain = pairs(docs)
    assert ordered((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == ordered(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in plain
    )
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 7) and 0 <= r["shard"] < 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    more = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 8).collect()}
    assert all(more[r["doc_id"]] == r["grown_shard"] for r in got)


def test_shard_weights(spark):
    keys = spark.range(20000).withColumnRenamed("id", "k")
    count = {r["shard"]: r["count"] for r in sharding.assign(keys, "k", [1.0, 2.0, 1.0]).groupBy("shard").count().collect()}
    assert abs(count[1] / 20000 - 0.5) < 0.02 and abs(count[0] / 20000 - 0.25) < 0.02
    with pytest.raises(ValueError):
        sharding.assign(keys, "k", [1.0, 0.0])


def test_patience_blocks():
    a, b = list("abcXdefg"), list("YabcdefZg")
    assert lines.patience_blocks(a, b) == [(0, 1, 3), (4, 4, 3), (7, 8, 1)]
    assert lines.patience_blocks([], b) == [] == lines.patience_blocks(a, [])
    assert lines.patience_blocks(a, a) == [(0, 0, 8)]


@pytest.mark.parametrize("which", ["odd", "twice", "empty", "sf"])
def test_line_dedup(spark, which):
    docs = documents(spark, which)
    got = lines.line_digests(docs)
    assert rows(got, *got.columns) == ordered(brute.line_dedup(pairs(docs)))
    kept = lines.drop_lines(docs)
    assert kept.columns == docs.columns
