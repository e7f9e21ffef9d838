"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each task cuts its documents into shards and builds a suffix array of the words of a shard.
Every suffix of the test items that begins a window is looked up by binary search. That gives the
interval of suffixes that begin with the window, so all its places, and the longest verbatim
match at each place. The tests are a query set that every shard is searched for: they are
broadcast in blocks of a bounded size, one pass over the documents for each block.

Words are compared by 64-bit hashes. Suffixes that begin with fewer test words in a row than the
shortest window are left out of the array, since no window can begin there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmark.llm.common import (
    LOWER, joined, list_array, packed, pieces, ranges, runs, small_batches, texts_of, word_hashes,
)

WINDOW = 13
SHARD_BYTES = 24 << 20
BLOCK_BYTES = 32 << 20  # of test texts in one broadcast

#: Word bytes after lower-casing: digits, a-z and all bytes of characters beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


class Tests:
    """One block of test items as word numbers; ``begins`` are the places where a window begins."""

    def __init__(self, texts: list[str | None], window: int):
        data, starts = joined([(x or "").encode().translate(LOWER) for x in texts])
        at, _, hashes = word_hashes(data, WORD_BYTE)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        first = np.searchsorted(at, starts)
        counts = np.diff(first)
        item = np.repeat(np.arange(len(texts)), counts)
        # A zero stands after each item, and enough of them at the end for any look ahead.
        self.longest = int(counts.max(initial=0))
        self.words = np.zeros(len(at) + len(texts) + self.longest + 1, np.int64)
        place = np.arange(len(at)) + item
        self.words[place] = numbers + 1
        width = np.minimum(counts, window)
        within = np.arange(len(at)) - first[:-1][item]
        begins = within + width[item] <= counts[item]
        self.begins, self.item = place[begins], item[begins]
        self.width = width[item][begins]
        self.left = (counts[item] - within)[begins]  # words up to the end of the item
        self.shortest = int(self.width.min(initial=1))


class Shard:
    """The suffix array of the documents of a shard, over the words of the tests."""

    def __init__(self, texts: list[bytes], tests: Tests):
        data, starts = joined(texts)
        data = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
        at, _, hashes = word_hashes(data, WORD_BYTE)
        first = np.searchsorted(at, starts)
        self.counts = np.diff(first)
        n = len(texts)
        vocabulary = tests.vocabulary
        numbers = np.zeros(len(at), np.int64)
        if len(vocabulary):
            found = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            numbers = np.where(vocabulary[found] == hashes, found + 1, 0)
        self.doc_start = first[:-1] + np.arange(n)  # a zero after each document
        self.depth = max(tests.longest, 1)
        self.words = np.zeros(len(at) + n + self.depth + 1, np.int64)
        self.words[np.arange(len(at)) + np.repeat(np.arange(n), self.counts)] = numbers
        zeros = np.flatnonzero(self.words == 0)
        # Runs of test words that a shortest window fits in; suffixes inside them are kept.
        before = np.concatenate([[-1], zeros[:-1]])
        room = zeros - before - 1 - (tests.shortest - 1)
        fits = room > 0
        self.suffixes = self._ordered(ranges(before[fits] + 1, room[fits]), len(vocabulary))

    def _ordered(self, places: np.ndarray, vocabulary: int) -> np.ndarray:
        """The places in the order of the words from there on, to the depth of the longest test.

        A key packs as many words as fit in 63 bits; places that are alike so far, and only
        these, are ordered by the next key.
        """
        bits = max(1, int(vocabulary + 1).bit_length())
        step = max(1, 63 // bits)

        def key(at: np.ndarray, depth: int) -> np.ndarray:
            out = np.zeros(len(at), np.int64)
            for k in range(step):
                out = (out << bits) | self.words[np.minimum(at + depth + k, len(self.words) - 1)]
            return out

        places = places[np.argsort(key(places, 0), kind="stable")]
        group = np.concatenate([[0], np.cumsum(np.diff(key(places, 0)) != 0)]) if len(places) else places
        depth = step
        while depth < self.depth and len(places):
            alike = np.zeros(len(places), bool)
            same = group[1:] == group[:-1]
            alike[1:] |= same
            alike[:-1] |= same
            index = np.flatnonzero(alike)
            if not len(index):
                break
            next_key = key(places[index], depth)
            order = np.lexsort((next_key, group[index]))
            places[index] = places[index][order]
            next_key = next_key[order]
            changed = np.zeros(len(places), np.int64)
            split = np.flatnonzero((np.diff(next_key) != 0) & (np.diff(group[index]) == 0)) + 1
            changed[index[split]] = 1
            group = group + np.cumsum(changed)
            depth += step
        return places

    def find(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """For each window of the tests the interval of suffixes that begin with it."""
        bounds = []
        for upper in (False, True):
            low = np.zeros(len(tests.begins), np.int64)
            high = np.full(len(tests.begins), len(self.suffixes), np.int64)
            while (open_ := low < high).any():
                q = np.flatnonzero(open_)
                middle = (low[q] + high[q]) // 2
                order = self._compare(self.suffixes[middle], tests, q)
                right = order < 0 if not upper else order <= 0
                low[q[right]] = middle[right] + 1
                high[q[~right]] = middle[~right]
            bounds.append(low)
        return bounds[0], bounds[1]

    def _compare(self, places: np.ndarray, tests: Tests, q: np.ndarray) -> np.ndarray:
        """-1, 0, 1 as the words at each place are before, in or after the window."""
        order = np.zeros(len(q), np.int64)
        width, begin = tests.width[q], tests.begins[q]
        undecided = np.arange(len(q))
        for k in range(int(width.max(initial=0))):
            undecided = undecided[k < width[undecided]]
            order[undecided] = np.sign(self.words[places[undecided] + k] - tests.words[begin[undecided] + k])
            undecided = undecided[order[undecided] == 0]
            if not len(undecided):
                break
        return order

    def lengths(self, places: np.ndarray, tests: Tests, q: np.ndarray) -> np.ndarray:
        """Words of the longest verbatim match of the test suffix at each place."""
        length = tests.width[q].copy()
        active = np.flatnonzero(length < tests.left[q])
        while len(active):
            k = length[active]
            same = self.words[places[active] + k] == tests.words[tests.begins[q[active]] + k]
            active = active[same]
            length[active] += 1
            active = active[length[active] < tests.left[q[active]]]
        return length


def _matches(texts: list[bytes], tests: Tests, ids: pa.Array) -> list[pa.Array]:
    """n_words, hits, items and longest for each text."""
    shard, n = Shard(texts, tests), len(texts)
    low, high = shard.find(tests)
    counts = high - low
    q = np.repeat(np.arange(len(low)), counts)
    places = shard.suffixes[ranges(low, counts)] if len(q) else np.empty(0, np.int64)
    lengths = shard.lengths(places, tests, q)
    doc = np.searchsorted(shard.doc_start, places, "right") - 1
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, lengths)
    edges = np.zeros(len(shard.words) + 1, np.int64)
    np.add.at(edges, places, 1)
    np.add.at(edges, places + tests.width[q], -1)
    start, end = runs(np.cumsum(edges)[:-1] > 0)
    owner = np.searchsorted(shard.doc_start, start, "right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array((x - shard.doc_start[owner]).astype(np.int64)) for x in (start, end)], ["start", "end"]
    )
    pairs = np.unique(doc * len(ids) + tests.item[q]) if len(q) else np.empty(0, np.int64)
    items = ids.take(pa.array(pairs % max(1, len(ids))))
    return [
        pa.array(shard.counts.astype(np.int64)),
        list_array(spans, np.bincount(owner, minlength=n)),
        list_array(items, np.bincount(pairs // max(1, len(ids)), minlength=n)),
        pa.array(longest),
    ]


def _merged(spans: Column) -> Column:
    """Overlapping or touching spans of a list as one."""
    span = "struct<start:bigint,end:bigint>"
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(f"array<{span}>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(
                    F.element_at(done, -1)["start"].alias("start"),
                    F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )


def find_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows without the text, with n_words, hits, items and longest.

    ``hits`` are the maximal runs of words inside an occurrence of a window, as [start, end);
    ``items`` the distinct ids of items with an occurring window (a null id is left out);
    ``longest`` the words of the longest verbatim match, 0 if there is none. A window is
    ``window`` words in a row of an item; an item of fewer words is one window, one without
    words (or null) has none. Null texts have no words. Repeated items count once, repeated
    documents each. Empty tables on either side are allowed. Other columns are passed on; those
    with the names of the results must be renamed before.
    """
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    id_type = items.schema["id"].dataType
    names = [f for f in docs.schema.fields if f.name != text]
    found = T.StructType([
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        ]))),
        T.StructField("items", T.ArrayType(id_type)),
        T.StructField("longest", T.LongType()),
    ])
    out = docs
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).toArrow()
        block = context.broadcast((Tests(mine["text"].to_pylist(), window), mine["id"].combine_chunks()))

        def search(batches: Iterator[pa.RecordBatch], block=block, b=b) -> Iterator[pa.RecordBatch]:
            tests, ids = block.value
            for table in pieces(batches, text, SHARD_BYTES):
                for x in table.combine_chunks().to_batches():
                    result = _matches(texts_of(x.column(text)), tests, ids)
                    made = pa.StructArray.from_arrays(result, [f.name for f in found.fields])
                    yield pa.RecordBatch.from_arrays([*x.columns, made], names=[*x.schema.names, f"_found{b}"])

        schema = T.StructType([*out.schema.fields, T.StructField(f"_found{b}", found)])
        out = out.mapInArrow(search, schema)
    every = [F.col(f"_found{b}") for b in range(blocks)]
    hits, ids, longest = every[0]["hits"], every[0]["items"], every[0]["longest"]
    if blocks > 1:
        hits = _merged(F.flatten(F.array(*[x["hits"] for x in every])))
        ids = F.array_distinct(F.flatten(F.array(*[x["items"] for x in every])))
        longest = F.greatest(*[x["longest"] for x in every])
    return out.select(
        *[F.col(f"`{f.name}`") for f in names], every[0]["n_words"].alias("n_words"), hits.alias("hits"),
        F.array_distinct(F.filter(ids, lambda x: x.isNotNull())).alias("items"), longest.alias("longest"),
    )


def n_hit() -> Column:
    return F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])


def contaminated(n_words: Column, hit: Column) -> Column:
    """A twentieth of the words are hit, and one at least."""
    return (hit > 0) & (20 * hit >= n_words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = find_matches(packed(docs, "text"), benchmark)
    return found.where(~contaminated(F.col("n_words"), n_hit())).select("row.*")
