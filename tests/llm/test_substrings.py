"""Removal of repeated windows and byte strings against plain versions."""

import re

import numpy as np
import pytest

from siftmark.llm import anchors, runindex, windows
from tests.llm import brute
from tests.llm.data import SF, odd_documents, ordered, pairs, rows


def documents(spark, which):
    if which == "sf":
        return spark.read.parquet(f"{SF}/documents.parquet")
    odd = odd_documents(spark)
    return odd.limit(0) if which == "empty" else odd


@pytest.mark.parametrize("which", ["odd", "empty", "sf"])
def test_windows(spark, which):
    docs = documents(spark, which)
    want = ordered(brute.word_dedup(pairs(docs)))
    got = windows.window_digests(docs)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_windows_random(spark):
    """Few words, so that windows repeat in every way; a tiny filter only makes more candidates."""
    rnd = np.random.default_rng(5)
    texts = [" ".join(rnd.choice(["a", "b", "c"], int(n))) for n in rnd.integers(0, 200, 60)]
    texts += texts[:5] + ["x y " * 60, " ".join(texts[:4])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for window, gram, bits in ((20, 6, 1 << 28), (5, 3, 1 << 12), (4, 4, 1 << 12)):
        got = windows.removal_spans(docs, window, gram, bits)
        want = brute.word_dedup(pairs(docs), window)
        assert rows(got, "doc_id", "n_words", "n_removed") == ordered(w[:3] for w in want)
        assert all(len(r["spans"]) <= r["n_removed"] and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
                   for r in got.collect())


def test_windows_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_removed"]) for r in windows.removal_spans(docs).collect()}
    assert got == {(1, 0), (None, 30), (2, 30)}


def test_a_third_of_all_ids_is_null(spark):
    """Rows without an id come last and none of them before another, however many there are."""
    rnd = np.random.default_rng(9)
    passages = [" ".join(f"p{k}w{i}" for i in range(25)) for k in range(6)]
    texts = [(i if i % 3 else None, f"own{i} " + passages[rnd.integers(6)] + f" end{i} " + passages[rnd.integers(6)]) for i in range(60)]
    texts += [(7, texts[7][1]), (7, passages[0]), (None, texts[0][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    least = {}
    for doc, text in texts:
        words = text.split()
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            least[key] = min(least.get(key, 1 << 63), (1 << 63) - 1 if doc is None else doc)
    want = []
    for doc, text in texts:
        words, gone, seen = text.split(), set(), set()
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen or least[key] < ((1 << 63) - 1 if doc is None else doc):
                gone.update(range(i, i + 20))
            seen.add(key)
        want.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    got = windows.removal_spans(docs)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_text") == ordered(want)


def test_anchors_depend_on_content():
    rnd = np.random.default_rng(1)
    grams = rnd.integers(0, 1 << 63, 500).astype(np.uint64)
    both = np.concatenate([grams[100:180], grams[:50], grams[100:180]])
    at, anchor = anchors.window_anchors(both, 40, np.ones(len(both) - 39, bool))
    first = {int(i): int(a - i) for i, a in zip(at, anchor) if i <= 40}
    second = {int(i) - 130: int(a - i) for i, a in zip(at, anchor) if i >= 130}
    assert first == second and len(first) == 41


def test_filter_has_no_false_no(spark):
    values = spark.range(1, 3000).selectExpr("xxhash64(id) as v")
    known = np.array([r["v"] for r in values.collect()])
    for bits in (1 << 20, 1 << 10):
        assert anchors.build_filter(values, bits).maybe(known).all()
    others = np.random.default_rng(2).integers(0, 1 << 62, 10000)
    assert anchors.build_filter(values, 1 << 20).maybe(others).mean() < 0.01
    assert not anchors.build_filter(values.limit(0), 1 << 12).maybe(known).any()


def brute_spans(parts, length):
    times = {}
    for p in parts:
        for i in range(len(p) - length + 1):
            times[p[i : i + length]] = times.get(p[i : i + length], 0) + 1
    out = []
    for p in parts:
        gone = bytearray(len(p))
        for i in range(len(p) - length + 1):
            if times[p[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        out.append([m.span() for m in re.finditer(rb"\x01+", bytes(gone))])
    return out


def test_index_finds_long_matches():
    rnd = np.random.default_rng(0)
    for _ in range(150):
        length, letters = int(rnd.integers(1, 12)), int(rnd.integers(1, 4))
        parts = [bytes(rnd.integers(0, letters, int(n)).astype(np.uint8)) for n in rnd.integers(0, 60, 5)]
        parts += parts[: int(rnd.integers(0, 3))]
        got = [list(zip(a.tolist(), b.tolist())) for a, b in runindex.long_matches(parts, length)]
        assert got == brute_spans(parts, length)


def test_index_is_run_compressed():
    part = bytes(np.random.default_rng(3).integers(97, 123, 500).astype(np.uint8))
    text = np.frombuffer((part + b"!") * 50, np.uint8).astype(np.int16) + 2
    assert runindex.RunIndex(text).runs < len(text) / 20


@pytest.mark.parametrize("which", ["odd", "twice", "empty", "sf"])
def test_byte_strings(spark, which):
    docs = documents(spark, which)
    docs = docs.union(docs) if which == "twice" else docs
    want = ordered(brute.byte_dedup(pairs(docs)))
    got = runindex.repeat_digests(docs)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_byte_strings_random(spark, most):
    """Bounds of 1 and 3 send grams the way of hot ones; a tiny filter only adds candidates."""
    rnd = np.random.default_rng(7)
    core = "".join(rnd.choice(list("abcdefé"), 120))
    texts = ["".join(rnd.choice(list("abcé"), int(n))) + core[int(a) :] + "".join(rnd.choice(list("xy"), 30))
             for n, a in zip(rnd.integers(0, 90, 70), rnd.integers(0, 100, 70))]
    texts += texts[:6] + ["ab" * 150, core * 3, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    for length, gram in ((40, 8), (25, 25)):
        got = runindex.remove_repeats(docs, length, gram, most, 1 << 14)
        want = brute.byte_dedup(pairs(docs), length)
        assert rows(got.selectExpr("doc_id", "n_bytes", "n_removed", "size(spans) n", "sha2(kept, 256) h"),
                    "doc_id", "n_bytes", "n_removed", "n", "h") == ordered(want)


def test_long_texts_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(runindex, "SLICE", 100)
    rnd = np.random.default_rng(9)
    core = bytes(rnd.integers(97, 101, 300).astype(np.uint8))
    texts = [bytes(rnd.integers(97, 101, 250).astype(np.uint8)) + core, core + b"zz", b"q" * 450]
    whole = runindex.Segments(texts, 60, 10)
    strings = sorted((d, s + i) for d, s, n in zip(whole.doc, whole.start, whole.size) for i in range(n - 59))
    assert strings == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 59)]


@pytest.mark.parametrize("size, share", [(300, 0), (399, 0), (400, 1), (401, 1), (2000, 1)])
def test_planted_passages_by_length(spark, size, share):
    """A passage in several documents goes from all of them if it has 400 bytes, else from none."""
    rnd = np.random.default_rng(size)
    word = lambda: "".join(rnd.choice(list("abcdefghij"), 5))
    filler = lambda: " ".join(word() for _ in range(120))
    passage = (" ".join(word() for _ in range(400)))[: size - 2]
    texts = [f"{filler()}{chr(65 + i)}\u0001{passage}\u0002{chr(65 + i)}{filler()}" if i % 3 else filler() for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in runindex.remove_repeats(docs).collect()}
    for i, text in enumerate(texts):
        cut = size if share and i % 3 else 0
        at = text.find("\u0001")
        assert got[i] == (cut, (text[:at] + text[at + size :] if cut else text).encode())
