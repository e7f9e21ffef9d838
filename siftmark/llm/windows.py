"""Substring deduplication: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

Every window of every document gets a rolling hash. A window can only repeat if its anchor gram
(see ``anchors``) does, so grams are counted first, and only windows over a repeated gram are
counted themselves; all others are known to occur once. Of the documents that hold a window the
one with the least doc_id keeps it; the repeated windows of the others, and later places in the
same document, merge into maximal removal intervals.

Hashes have 64 bits. Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.anchors import FILTER_BITS, Filter, build_filter, repeated, window_anchors
from siftmark.llm.common import (
    NOT_BLANK, joined, list_array, pieces, prefix_sums, runs, small_batches, span_hashes, texts_of, word_hashes,
)
from siftmark.session import written

WINDOW = 20
GRAM = 6
BATCH = 1 << 20


class Words:
    """The words of some texts: ``first[d]`` is the number of the first word of text d."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        self.data, starts = joined(texts)
        self.start, self.end, hashes = word_hashes(self.data, NOT_BLANK)
        self.first = np.searchsorted(self.start, starts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.sums, n = prefix_sums(hashes), len(hashes)
        at = np.arange(max(0, n - gram + 1))
        self.grams = span_hashes(self.sums, at, at + gram)
        count = max(0, n - window + 1)
        valid = np.arange(count) + window <= self.first[self.doc[:count] + 1]
        self.window, self.anchor = window_anchors(self.grams, window - gram + 1, valid)

    def candidates(self, filter: Filter, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose anchor gram may be repeated, and their hashes, in order."""
        places, index = np.unique(self.anchor, return_inverse=True)
        at = self.window[filter.maybe(self.grams[places])[index]] if len(places) else self.window
        return at, span_hashes(self.sums, at, at + window).view(np.int64)


def _id(docs: DataFrame) -> DataFrame:
    """Ids as longs, with the null id as the last of all."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("id"), "text")


def anchor_grams(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each place that anchors a window: its gram hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", BATCH):
            words = Words(texts_of(table["text"].combine_chunks()), window, gram)
            grams = words.grams[np.unique(words.anchor)] if len(words.anchor) else words.grams[:0]
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], names=["gram"])

    return docs.select("text").mapInArrow(run, "gram bigint")


def first_holders(docs: DataFrame, filter: Broadcast, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(hash, id): the windows over repeated grams, and the least id of the documents with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", BATCH):
            words = Words(texts_of(table["text"].combine_chunks()), window, gram)
            at, hashes = words.candidates(filter.value, window)
            # Of equal windows in this batch only those of the least id matter.
            ids = table["id"].combine_chunks().to_numpy()[words.doc[at]]
            order = np.lexsort((ids, hashes))
            least = order[np.concatenate([[True], np.diff(hashes[order]) != 0])] if len(order) else order
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[least]), pa.array(ids[least])], names=["hash", "id"]
            )

    return _id(docs).mapInArrow(run, "hash bigint, id bigint").groupBy("hash").agg(F.min("id").alias("id"))


def held_hashes(
    docs: DataFrame, filter: Broadcast, window: int = WINDOW, gram: int = GRAM
) -> tuple[DataFrame, DataFrame | None]:
    """The windows that each document is the first holder of, as lists of hashes.

    By id (of, hashes) for ids that one row has. Rows that share an id, such as all with a null
    id, have lists of their own, (of, text_hash, hashes), so a list never holds more than the
    windows of one text.
    """
    first = first_holders(docs, filter, window, gram)
    listed = F.collect_list("hash").alias("hashes")
    ids = _id(docs).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if ids.isEmpty():
        return first.groupBy(F.col("id").alias("of")).agg(listed), None
    first, ids = written(first), written(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", BATCH):
            words = Words(texts_of(table["text"].combine_chunks()), window, gram)
            at, hashes = words.candidates(filter.value, window)
            doc = pa.array(words.doc[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes), *(table[c].combine_chunks().take(doc) for c in ("id", "text_hash"))],
                names=["hash", "id", "text_hash"],
            )

    shared = _id(docs).join(ids, "id", "left_semi").select("id", F.xxhash64("text").alias("text_hash"), "text")
    tuples = shared.mapInArrow(run, "hash bigint, id bigint, text_hash bigint").distinct()
    own = first.join(ids, "id", "left_anti").groupBy(F.col("id").alias("of")).agg(listed)
    return own, tuples.join(first, ["hash", "id"]).groupBy(F.col("id").alias("of"), "text_hash").agg(listed)


def removal_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, spans and kept_text of every row.

    ``spans`` are maximal removal intervals [start, end) of word places; ``kept_text`` has the
    other words joined by single blanks. ``doc_id`` must be a whole number; rows of one doc_id
    are separate documents of which none is the earlier, and null ids come last. A null text has
    no words; texts shorter than a window lose nothing. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    filter = spark.sparkContext.broadcast(build_filter(repeated(anchor_grams(docs, window, gram)), filter_bits))
    own, shared = held_hashes(docs, filter, window, gram)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", BATCH):
            texts = texts_of(table["text"].combine_chunks())
            words = Words(texts, window, gram)
            at, hashes = words.candidates(filter.value, window)
            doc = words.doc[at]
            lists = table["hashes"].combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(texts)), sizes)
            own = lists.flatten().to_numpy(zero_copy_only=False)
            # A window stays if its document is the first holder and it starts nowhere before in it.
            every_doc = np.concatenate([owner, doc])
            every_hash = np.concatenate([own, hashes])
            place = np.concatenate([np.full(len(own), -1), at])
            order = np.lexsort((place, every_hash, every_doc))
            same = np.zeros(len(order), np.int64)
            same[1:] = (every_doc[order][1:] == every_doc[order][:-1]) & (every_hash[order][1:] == every_hash[order][:-1])
            after_own = np.zeros(len(order), bool)
            after_own[1:] = (place[order][:-1] < 0) & (same[1:] > 0)
            gone = at[np.sort((order - len(own))[(place[order] >= 0) & ~after_own])]
            edges = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(edges, gone, 1)
            np.add.at(edges, gone + window, -1)
            removed = np.cumsum(edges)[:-1] > 0
            start, end = _spans(removed, words.first)
            span_doc = words.doc[start]
            data = words.data.tobytes()
            kept = np.flatnonzero(~removed)
            bounds = np.searchsorted(kept, words.first)
            left = list(zip(words.start[kept].tolist(), words.end[kept].tolist(), strict=True))
            made = pa.StructArray.from_arrays(
                [pa.array(start - words.first[span_doc]), pa.array(end - words.first[span_doc])], ["start", "end"]
            )
            total = np.concatenate([[0], np.cumsum(removed)])[words.first]
            yield pa.RecordBatch.from_arrays([
                table["doc_id"].combine_chunks(), pa.array(np.diff(words.first)), pa.array(np.diff(total)),
                list_array(made, np.bincount(span_doc, minlength=len(texts))),
                pa.array([b" ".join([data[s:e] for s, e in left[a:b]]).decode() for a, b in zip(bounds, bounds[1:])]),
            ], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("id"), "text")
    nothing = F.array().cast("array<bigint>")
    known = rows.join(own, F.col("id") == F.col("of"), "left").drop("of")
    if shared is not None:
        many = shared.select("of", F.col("text_hash").alias("th"), F.col("hashes").alias("more"))
        same = (F.col("id") == F.col("of")) & (F.xxhash64("text") == F.col("th"))
        known = known.join(many, same, "left").withColumn("hashes", F.coalesce("hashes", "more"))
    return (
        known.select("doc_id", "text", F.coalesce("hashes", nothing).alias("hashes"))
        .mapInArrow(
            run,
            f"doc_id {id_type}, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, "
            "kept_text string",
        )
    )


def _spans(marks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of marks that don't cross from one document to the next."""
    start, end = runs(marks)
    if not len(start):
        return start, end
    cuts = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(marks))]
    cuts = np.unique(cuts[marks[cuts] & marks[cuts - 1]]) if len(cuts) else cuts
    return np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))


def window_digests(docs: DataFrame) -> DataFrame:
    return removal_spans(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )
