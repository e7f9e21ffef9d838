"""Line deduplication against alignments with earlier texts."""

import random

from siftmark.llm import lines
from tests.llm import brute
from tests.llm.data import SF


def removed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [list(r["removed"]) for r in lines.cut_lines(docs).orderBy("doc_id").collect()]


def every_earlier(texts):
    """What distinct texts lose in alignments with each text before them."""
    split, out = [t.split("\n") for t in texts], []
    for i, b in enumerate(split):
        gone = set()
        for a in split[:i]:
            for _, j, n in lines.patience_blocks(a, b):
                if any(x.strip(" \t\n\x0b\x0c\r") for x in b[j : j + n]):
                    gone.update(range(j, j + n))
        out.append(sorted(gone))
    return out


def test_lines_of_most_texts(spark):
    """A family of near copies and a line of all texts lose what the first text has."""
    family = [f"all have it\nbody of the family\n\nown line {i}" for i in range(9)]
    others = [f"another text {i}\nall have it" for i in range(9)]
    assert removed(spark, family + others) == [[]] + [[0, 1, 2]] * 8 + [[1]] * 9


def test_next_holders(spark):
    """A line that crosses the chain with its first holder aligns with a later one."""
    texts = ["A\nB", "B\nA", "B\nA\nC", "C\nA\nB", "D\nB\nA", "D\nC\nA\nx"]
    assert removed(spark, texts) == every_earlier(texts)
    assert removed(spark, texts)[2] == [0, 1]


def test_blank_lines_of_a_nearer_copy(spark):
    """R1 and R2 are first seen in two texts, the line between them only in the third."""
    texts = ["R1\nx", "R2\ny", "z\nR1\n\nR2", "w\nR1\n\nR2"]
    assert removed(spark, texts) == [[], [], [1, 3], [1, 2, 3]] == every_earlier(texts)


def test_all_earlier_texts(spark):
    rnd = random.Random(3)
    texts = list(dict.fromkeys(
        "\n".join(rnd.choice(["a", "b", "c", "d", "e", "f", "", " "]) for _ in range(rnd.randint(1, 9)))
        for _ in range(120)
    ))
    assert removed(spark, [t for t in texts if t]) == every_earlier([t for t in texts if t])


def test_all_earlier_texts_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 0").orderBy("doc_id")
    texts = list(dict.fromkeys(r["text"] for r in docs.collect()))
    assert removed(spark, texts) == every_earlier(texts)


def test_repeated_lines(spark):
    assert removed(spark, ["x\nL\ny", "p\nL\nq\nL\nr"]) == [[], [1]]
    assert removed(spark, ["x\nL\ny\nL\nz", "p\nL\nq\nL\nr"]) == [[], [1, 3]]


def test_alignments_are_those_of_a_plain_recursion():
    rnd = random.Random(11)
    for _ in range(3000):
        a, b = ([rnd.choice("abcdefgh"[: rnd.randint(1, 8)]) for _ in range(rnd.randint(0, 12))] for _ in "ab")
        got = [(i + k, j + k) for i, j, n in lines.patience_blocks(a, b) for k in range(n)]
        assert got == brute.aligned(a, b)


def test_no_gap_has_a_common_line():
    """Chains rise on both sides, hold equal lines, and leave nothing common between them."""
    rnd = random.Random(5)
    for _ in range(3000):
        a, b = ([rnd.choice("abcdef"[: rnd.randint(1, 6)]) for _ in range(rnd.randint(0, 12))] for _ in "ab")
        at = [(i + k, j + k) for i, j, n in lines.patience_blocks(a, b) for k in range(n)]
        assert all(a[i] == b[j] for i, j in at)
        edges = [(-1, -1), *at, (len(a), len(b))]
        for (i, j), (k, m) in zip(edges, edges[1:], strict=False):
            assert i < k and j < m and not set(a[i + 1 : k]) & set(b[j + 1 : m])
