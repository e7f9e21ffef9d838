"""Hard negatives against plain lists, on tables with ties, copies and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark.llm import hardneg
from siftmark.llm.hardneg import Goal, Tree, packed_order, search


def plain(vectors, every, positives=5, negatives=5, low=80, high=100):
    """vectors: (vec_id, embedding, label)."""
    usable = [
        (i, [math.floor(256 * float(x)) for x in v], y) for i, v, y in vectors
        if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (i, v, y) in enumerate(usable):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for k, (j, w, z) in enumerate(usable) if k != at)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            window = [x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, vectors, every, **options):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3)
    for name in ("q", "place", "w", "anchor", "shard"):
        df = df.withColumn(name, F.lit("x"))
    got = hardneg.hard_negatives(df, F.col("vec_id") % every == 0, **options)
    return sorted(map(tuple, got.collect()))


def made(n, width, seed, values=None):
    rnd = random.Random(seed)
    one = (lambda: rnd.choice(values)) if values else (lambda: float(np.float32(rnd.gauss(0, 0.3))))
    rows = [(i, [one() for _ in range(width)], rnd.randint(0, 3)) for i in range(n)]
    return rows


@pytest.mark.parametrize("which", ["plain", "ties", "copies"])
def test_hard_negatives(spark, which, monkeypatch):
    monkeypatch.setattr(hardneg, "TILE_BYTES", 1)  # tiles of one leaf
    rows = made(700, 5, 1, [0.0, 0.5, -0.25] if which == "ties" else None)
    if which == "copies":  # a third of the rows is one vector
        rows = [(i, rows[0][1], y) if i % 3 == 0 else (i, v, y) for i, v, y in rows]
    assert mined(spark, rows, 20) == plain(rows, 20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(90, 4, 2)
    rows += [(None, [1.0] * 4, 1), (200, None, 1), (201, [nan, 1.0, 1.0, 1.0], 1), (202, [inf, 0.0, 0.0, 0.0], 2),
             (203, [None, 1.0, 1.0, 1.0], 1), (204, [1.0] * 4, None), (205, [], 1), (210, [0.5, 0.5], 2)]
    rows += rows[:30]  # repeated rows are rows of their own
    assert mined(spark, rows, 10) == plain(rows, 10)
    assert mined(spark, rows, 10, positives=2, negatives=3, low=50, high=90) == plain(rows, 10, 2, 3, 50, 90)


def test_few_rows(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [(0, [1.0], 1)], 1) == []
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)], 1) == plain([(0, [], 1), (1, [], 1), (2, [], 2)], 1)
    with pytest.raises(Exception, match="beyond"):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 1)], 1)


def test_search_prunes_and_keeps_ties():
    rng = np.random.default_rng(5)
    q = rng.integers(-6, 7, (3000, 2))
    q = q[packed_order(q)]
    tree, ids = Tree(q), rng.permutation(3000)
    looked = []
    tree_vectors = tree.vectors

    class Counted(np.ndarray):
        def __matmul__(self, other):
            looked.append(len(self))
            return np.asarray(self) @ other

    tree.vectors = tree_vectors.view(Counted)
    for low, high in ((-(1 << 62), 1 << 62), (10, 20), (5, 5), (1000, 2000)):
        anchor = np.array([4, -3])
        goal = Goal(low, high, low, 7)
        looked.clear()
        search(tree, ids, np.ones(3000, bool), anchor, [goal])
        scores = q @ anchor
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if low <= s <= high)[:7]
        assert [(s, i) for s, i, _ in goal.best] == want
        assert sum(looked) < 2000
    assert sum(looked) == 0


def test_leaves_are_tiles():
    q = np.stack(np.meshgrid(np.arange(64), np.arange(64)), axis=-1).reshape(-1, 2)
    lo, hi = Tree(q[packed_order(q)]).levels[0]
    assert len(lo) == 64 and ((hi - lo).max(axis=1) <= 8).all()
