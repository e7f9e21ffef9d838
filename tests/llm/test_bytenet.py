"""The byte network: answers against plain sums, gradients against differences, held-out accuracy."""

import zlib

import numpy as np
import pytest

from siftmark.llm import bytenet
from tests.llm.data import SF, odd_documents


def plain_score(net, text):
    """One window and one chunk at a time."""
    width = len(net.weights)
    text = text.ljust(width, b"\0")
    last = len(text) - width + 1
    answers = []
    for start in range(0, last, bytenet.CHUNK):
        windows = range(start, min(start + bytenet.CHUNK, last))
        best = [max(sum(float(net.vectors[text[w + k]] @ net.weights[k, :, f]) for k in range(width)) for w in windows)
                for f in range(len(net.bias))]
        seen = [max(0, b + c) for b, c in zip(best, net.bias)] + [len(windows) / bytenet.CHUNK]
        answers.append(np.maximum(np.array(seen) @ net.hidden + net.hidden_bias, 0))
    z = np.concatenate([np.max(answers, axis=0), np.mean(answers, axis=0)]) @ net.dense + net.constant[0]
    return 1 / (1 + np.exp(-z))


def test_scores_are_those_of_single_windows():
    net = bytenet.Net.fresh(np.random.default_rng(2))
    net.bias[:] = np.linspace(-1, 1, len(net.bias))
    texts = [b"", b"abc", b"abcdef", bytes(range(200)) * 3, b"xy z" * 64 + b"ab", b"\xff" * 261, b"\xff" * 262]
    assert np.allclose(net.score(texts), [plain_score(net, t) for t in texts], atol=1e-5)
    assert net.score([]).tolist() == []


def test_gradients():
    rng = np.random.default_rng(4)
    net = bytenet.Net.fresh(rng)
    for name in ("vectors", "weights", "bias", "hidden", "hidden_bias", "dense", "constant"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    chunks = rng.integers(0, 256, (5, bytenet.CHUNK + bytenet.WIDTH - 1)).astype(np.uint8)
    windows, begin, good = np.array([256, 40, 256, 1, 200]), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        tables, out = net.tables(), []
        for a, b in ((0, 2), (2, 3), (3, 5)):
            pooled = np.array([
                sum(tables[k][chunks[c, k : k + windows[c]]] for k in range(bytenet.WIDTH)).max(axis=0) for c in range(a, b)
            ])
            seen = np.concatenate([np.maximum(pooled + net.bias, 0), windows[a:b, None] / bytenet.CHUNK], axis=1)
            live = np.maximum(seen @ net.hidden + net.hidden_bias, 0)
            out.append(np.concatenate([live.max(axis=0), live.mean(axis=0)]) @ net.dense + net.constant[0])
        p = 1 / (1 + np.exp(-np.array(out)))
        return -np.mean(good * np.log(p) + (1 - good) * np.log(1 - p))

    grads = bytenet._gradients(net, chunks, windows, begin, good)
    for parameter, gradient in zip(net.parameters(), grads, strict=True):
        flat, g = parameter.reshape(-1), gradient.reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            kept, eps = flat[i], 1e-4
            flat[i] = kept + eps
            up = loss()
            flat[i] = kept - eps
            down = loss()
            flat[i] = kept
            assert np.isclose((up - down) / (2 * eps), g[i], rtol=0.02, atol=1e-4)


def test_held_out_accuracy(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    net = bytenet.fit(docs, labels)
    scored = bytenet.quality_scores(docs, net).cache()
    assert scored.count() == docs.count()
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 80
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    for r in scored.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    # Not the order or number of the rows, and none of the held-out labels, changes the network.
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    again = bytenet.fit(docs.repartition(5), flipped.union(flipped))
    assert all((a == b).all() for a, b in zip(net.parameters(), again.parameters()))
    # The end of a long text counts.
    good = docs.join(labels, "doc_id").where("quality = 1 and length(text) between 3000 and 9000").first()["text"].encode()
    clean, junk = net.score([good * 3, good * 3 + b" a### b$$$ c%%% d&&&" * 300])
    assert junk < clean


@pytest.mark.parametrize("which", ["odd", "twice", "empty"])
def test_odd_tables(spark, which):
    docs = odd_documents(spark)
    docs = {"twice": docs.union(docs), "empty": docs.limit(0)}.get(which, docs)
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (4, 1), (5, 0), (6, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        scored = bytenet.quality_scores(docs, bytenet.fit(docs, known)).collect()
        assert len(scored) == docs.count()
        assert all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored}) <= 1


def test_null_id(spark):
    docs = spark.createDataFrame([(None, "x"), (1, None)], "doc_id long, text string")
    net = bytenet.train([], np.zeros(0, bool))
    assert [(r["doc_id"], r["held_out"], r["score"]) for r in bytenet.quality_scores(docs, net).collect()] == [
        (None, False, 0.5), (1, zlib.crc32(b"1") % 3 == 1, 0.5)]
