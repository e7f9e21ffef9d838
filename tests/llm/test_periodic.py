"""Periodic runs against a plain search, and the grammar's extensions against comparisons."""

import random
import zlib

import numpy as np
import pytest

from siftmark.llm import grammar, periodic
from tests.llm.brute import WORD, sha
from tests.llm.data import SF, odd_documents, ordered, pairs, rows


def plain_runs(words):
    """Every stretch that is equal p words apart, unless a smaller period gives the same."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if i > start and length >= max(6, 4 * p):
                found.setdefault((start, length), p)
            i += i == start
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_digests(docs):
    out = []
    for doc, text in docs:
        words = WORD.findall(text or "")
        h = zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = min(((-n, s, p) for s, n, p in runs), default=None)
        out.append((
            doc, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
        ))
    return out


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("which", ["odd", "twice", "empty", "sf"])
def test_digests(spark, which):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if which == "sf" else odd_documents(spark)
    docs = {"twice": docs.union(docs), "empty": docs.limit(0)}.get(which, docs)
    got = periodic.run_digests(periodic.with_repeated_tails(docs))
    assert rows(got, *COLUMNS) == ordered(plain_digests(pairs(docs)))


def test_null_ids_and_other_columns(spark):
    docs = spark.createDataFrame(
        [(None, "a b a b a b a b", 1), (None, None, 2), (7, "x " * 5000, 3)], "doc_id long, text string, runs int"
    )
    got = {(r["doc_id"], r["n_words"]): ([tuple(x) for x in r["runs"]], r["collapsed_text"])
           for r in periodic.periodic_runs(docs).collect()}
    assert got == {(None, 8): ([(0, 8, 2)], "a b"), (None, 0): ([], ""), (7, 5000): ([(0, 5000, 1)], "x")}


def test_runs_of_random_texts():
    rnd = random.Random(7)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(0, 5)):
            words = [rnd.randint(0, rnd.choice([1, 2, 9])) for _ in range(rnd.randint(0, 50))]
            for _ in range(rnd.randint(0, 3)):
                unit = [rnd.randint(0, 3) for _ in range(rnd.randint(1, 9))] * rnd.randint(2, 8)
                at = rnd.randint(0, len(words))
                words[at:at] = unit[: rnd.randint(0, len(unit))]
            texts.append(np.array(words, np.int64))
        got = [[] for _ in texts]
        for t, *r in zip(*(c.tolist() for c in periodic.find_runs(texts)), strict=True):
            got[t].append(tuple(r))
        assert got == [plain_runs(t.tolist()) for t in texts]


def test_a_text_beyond_the_kept_grids():
    words = np.concatenate([np.arange(100, 5000), np.tile(np.arange(40), 9), np.arange(5000, 6000)])
    assert [c.tolist() for c in periodic.find_runs([words])] == [[0], [4900], [360], [40]]


def test_extensions():
    rnd = np.random.default_rng(3)
    for symbols in (2, 3, 50):
        text = np.append(rnd.integers(1, symbols + 1, 400), 0)
        text[100:220] = np.tile(text[90:100], 12)
        levels = grammar.compress(text)
        assert len(levels[-1].symbols) == 1
        a, b = rnd.integers(0, 400, (2, 3000))
        a, b = a[a != b], b[a != b]
        want = [next(k for k in range(401) if text[i + k] != text[j + k]) for i, j in zip(np.minimum(a, b), np.maximum(a, b))]
        assert grammar.extensions(levels, a, b).tolist() == want
