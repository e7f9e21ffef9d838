"""Byte-string deduplication with a run-length compressed Burrows-Wheeler transform.

Every string of ``length`` bytes that also starts anywhere else is removed from all its places.

Strings are anchored (see ``anchors``), and those of one document that share an anchor place form
a segment, so that each string is in exactly one segment, and equal strings are in segments of the
same anchor gram. Segments are folded first: of equal ones a single text is indexed, and all
strings of a segment seen twice repeat. Segments of grams with several different texts are dealt
to bins by gram. A bin is indexed: its transform is cut into runs, the text places at the ends of
runs are sampled, and the longest match with the neighbour in the order is measured at these
samples only. Matching statistics of all other places follow by streaming along the text, since a
place inside a run has the match of the place before less one. Places with ``length`` or more are
marked.

A gram whose different segments have more than ``most`` bytes would make too large a bin. Its
segments, one of each, are then documents of their own for the same steps with grams four times as long:
fewer strings share a longer anchor, so segments become shorter and more of them equal or alone.
The longest gram is a whole string, whose segments are single strings, equal or alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.anchors import FILTER_BITS, build_filter, window_anchors
from siftmark.llm.common import (
    byte_values, list_array, mixed, pieces, prefix_sums, runs, small_batches, span_hashes, texts_of,
)
from siftmark.session import written

LENGTH = 400
GRAM = 32
MOST = 1 << 20  # bytes of the different segments of a gram in a bin
BATCH = 1 << 20
SLICE = 1 << 20  # string starts of one text that are looked at together
BIN_BYTES = 1 << 19


# --- the index ----------------------------------------------------------------------


class RunIndex:
    """Run-length compressed transform of a text of symbols, with samples at run ends."""

    PACK = 7  # symbols below 512 in one key

    def __init__(self, text: np.ndarray):
        """``text`` has symbols from 1 to 511."""
        self.text = text
        n = len(text)
        order = self._sorted(n)
        before = np.where(order == 0, -1, text[order - 1])  # the transform; nothing stands before place 0
        change = before[1:] != before[:-1]
        head = np.concatenate([[True], change])
        tail = np.concatenate([change, [True]])
        self.runs = int(head.sum())
        rows = np.flatnonzero(head)
        self.heads = order[rows]
        self.head_match = np.where(rows > 0, self._common(self.heads, order[rows - 1]), 0)
        rows = np.flatnonzero(tail)
        self.tails = order[rows]
        self.tail_match = np.where(rows < n - 1, self._common(self.tails, order[(rows + 1) % n]), 0)

    def _sorted(self, n: int) -> np.ndarray:
        """The suffix order, by doubling the compared length; only ties are sorted again.

        Ranks of all lengths are kept, to measure common lengths with them.
        """
        padded = np.concatenate([self.text, np.zeros(self.PACK, self.text.dtype)]).astype(np.int64)
        key = np.zeros(n, np.int64)
        for k in range(self.PACK):
            key = (key << 9) | padded[k : k + n]
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], np.diff(key[order]) != 0])
        self.levels: list[tuple[int, np.ndarray]] = []
        length = self.PACK
        while True:
            group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank = np.empty(n, np.int32)
            rank[order] = group
            self.levels.append((length, rank))
            tied = ~new
            tied[:-1] |= ~new[1:]
            rows = np.flatnonzero(tied)
            if not len(rows):
                return order
            places = order[rows]
            later = places + length
            second = np.where(later < n, rank[np.minimum(later, n - 1)].astype(np.int64) + 1, 0)
            key = group[rows].astype(np.int64) * (n + 1) + second
            by = np.argsort(key, kind="stable")
            order[rows] = places[by]
            key = key[by]
            new[rows] = np.concatenate([[True], np.diff(key) != 0])
            length *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at each pair of places have in common."""
        n, total = len(self.text), np.zeros(len(a), np.int64)
        a, b = a.astype(np.int64), b.astype(np.int64)
        for length, rank in reversed(self.levels):
            inside = (a + total < n) & (b + total < n)
            x, y = np.minimum(a + total, n - 1), np.minimum(b + total, n - 1)
            total += np.where(inside & (rank[x] == rank[y]) & (a != b), length, 0)
        active = np.arange(len(a))
        for _ in range(self.PACK):
            x, y = a[active] + total[active], b[active] + total[active]
            ok = (x < n) & (y < n)
            ok[ok] = self.text[x[ok]] == self.text[y[ok]]
            active = active[ok]
            total[active] += 1
        return total

    def matching_statistics(self) -> np.ndarray:
        """For each place the longest string from there on that also starts elsewhere."""
        n = len(self.text)
        out = np.zeros(n, np.int64)
        for places, match in ((self.heads, self.head_match), (self.tails, self.tail_match)):
            by = np.argsort(places)
            places, match = places[by], match[by]
            # Nothing stands before place 0, so it is alone in its run and sampled.
            last = np.searchsorted(places, np.arange(n), "right") - 1
            out = np.maximum(out, match[last] - (np.arange(n) - places[last]))
        return out


def long_matches(parts: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part the maximal spans covered by strings that also start elsewhere in the parts."""
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.int16) + 2
    text[ends] = 1  # between the parts and at the end
    left = np.repeat(ends, sizes + 1) - np.arange(len(text))
    starts = np.flatnonzero((left >= length) & (RunIndex(text).matching_statistics() >= length))
    return _covered(starts, length, ends - sizes, len(text), len(parts))


def _covered(starts, length, begins, total, count):
    edges = np.zeros(total + 1, np.int64)
    edges[starts] += 1
    np.add.at(edges, starts + length, -1)
    a, b = runs(np.cumsum(edges)[:-1] > 0)
    owner = np.searchsorted(begins, a, "right") - 1
    bounds = np.searchsorted(owner, np.arange(count + 1))
    return [(a[x:y] - begins[i], b[x:y] - begins[i]) for i, (x, y) in enumerate(zip(bounds, bounds[1:]))]


# --- segments -----------------------------------------------------------------------


class Segments:
    """The segments of a batch of texts: gram, key, text number, start in it, and size in bytes."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.length = length
        self.slices = [
            (d, s, t[s : s + SLICE + length - 1])
            for d, t in enumerate(texts) for s in range(0, max(1, len(t) - length + 1), SLICE) if len(t) >= length
        ]
        found = [self._of(group, gram) for group in self._grouped()]
        columns = list(zip(*found, strict=True)) if found else [[np.empty(0, np.int64)]] * 5
        self.gram, self.key, self.doc, self.start, self.size = (np.concatenate(c) for c in columns)

    def _grouped(self) -> Iterator[list]:
        held, size = [], 0
        for x in self.slices:
            if size + len(x[2]) > SLICE and held:
                yield held
                held, size = [], 0
            held.append(x)
            size += len(x[2])
        if held:
            yield held

    def _of(self, group: list, gram: int) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(x[2]) for x in group])]).astype(np.int64)
        sums = prefix_sums(byte_values(data))
        at = np.arange(len(data) - gram + 1)
        grams = span_hashes(sums, at, at + gram)
        valid = np.zeros(max(0, len(data) - self.length + 1), bool)
        for a, b in zip(edges, edges[1:], strict=False):
            valid[a : b - self.length + 1] = True
        window, anchor = window_anchors(grams, self.length - gram + 1, valid)
        piece = np.searchsorted(edges, window, "right") - 1
        new = np.ones(len(window), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new)
        start, anchor, piece = window[first], anchor[first], piece[first]
        size = np.diff(np.append(first, len(window))) + self.length - 1
        key = mixed(span_hashes(sums, start, start + size) ^ mixed(((anchor - start) << 32 | size).astype(np.uint64)))
        doc = np.array([x[0] for x in group], np.int64)[piece]
        offset = np.array([x[1] for x in group], np.int64)[piece]
        return grams[anchor].view(np.int64), key.view(np.int64), doc, start - edges[piece] + offset, size

    def tags(self, text_hash: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A number for each occurrence of a segment, from its document and place."""
        own = mixed(text_hash.view(np.uint64)) ^ mixed(ids.view(np.uint64) + np.uint64(1))
        return mixed(own[self.doc] + self.start.astype(np.uint64)).view(np.int64)


def _scan(docs: DataFrame, make, schema: str, length: int, gram: int) -> DataFrame:
    """``make(segments, texts, table)`` gives the columns of a batch of (doc_id, id, text_hash, text)."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", BATCH):
            texts = texts_of(table["text"].combine_chunks())
            yield pa.RecordBatch.from_arrays(make(Segments(texts, length, gram), texts, table), names=names)

    rows = docs.select(
        "doc_id", F.xxhash64("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    return rows.mapInArrow(run, schema)


def _tags(segments: Segments, table: pa.Table) -> np.ndarray:
    return segments.tags(table["text_hash"].combine_chunks().to_numpy(), table["id"].combine_chunks().to_numpy())


def folded_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, key, n, tag, size): how often each different segment occurs, and one of its tags."""

    def make(s: Segments, texts, table):
        return [pa.array(x) for x in (s.gram, s.key, _tags(s, table), s.size)]

    rows = _scan(docs, make, "gram bigint, key bigint, tag bigint, size bigint", length, gram)
    return rows.groupBy("gram", "key").agg(
        F.count("*").alias("n"), F.min("tag").alias("tag"), F.max("size").alias("size")
    )


def dealt_segments(docs: DataFrame, chosen: Broadcast, hot: Broadcast, bins: int, length: int, gram: int) -> DataFrame:
    """(part, gram, key, bytes): texts of the chosen segments by bin; those of hot grams have part -1."""

    def make(s: Segments, texts, table):
        mine = np.flatnonzero(chosen.value.maybe(_tags(s, table)))
        part = (mixed(s.gram[mine].view(np.uint64)) % np.uint64(bins)).astype(np.int64)
        part[hot.value.maybe(s.gram[mine])] = -1
        cut = [texts[s.doc[i]][s.start[i] : s.start[i] + s.size[i]] for i in mine]
        return [pa.array(part), pa.array(s.gram[mine]), pa.array(s.key[mine]), pa.array(cut, pa.binary())]

    return _scan(docs, make, "part bigint, gram bigint, key bigint, bytes binary", length, gram)


def marked_segments(dealt: DataFrame, length: int) -> DataFrame:
    """(gram, key, spans): what of each dealt segment is covered by strings that occur elsewhere."""

    def mark(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A document that comes several times with the same id and text deals its segments as often:
        # one of each is enough.
        held: dict[tuple[int, int], bytes] = {}
        for batch in batches:
            names = zip(batch.column("gram").to_pylist(), batch.column("key").to_pylist(), strict=True)
            for name, text in zip(names, batch.column("bytes"), strict=True):
                if name not in held:
                    held[name] = text.as_py()
        grams, keys = np.array(list(held), np.int64).T
        yield _marks(grams, keys, long_matches(list(held.values()), length))

    return dealt.groupBy("part").applyInArrow(
        mark, "gram bigint, key bigint, spans array<struct<start:bigint,end:bigint>>"
    )


def _marks(grams: np.ndarray, keys: np.ndarray, spans: list) -> pa.RecordBatch:
    counts = np.fromiter((len(a) for a, _ in spans), np.int64, len(spans))
    a, b = (np.concatenate([s[i] for s in spans]).astype(np.int64) if spans else np.empty(0, np.int64) for i in (0, 1))
    values = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["start", "end"])
    return pa.RecordBatch.from_arrays(
        [pa.array(grams), pa.array(keys), list_array(values, counts)], names=["gram", "key", "spans"]
    )


def _filter_of(values: DataFrame, count: int, most: int):
    """A filter with 64 bits or more a value, up to ``most`` bits in all."""
    return build_filter(values, min(most, 1 << max(12, (64 * count).bit_length())))


def repeated_spans(docs: DataFrame, length: int, gram: int, most: int, filter_bits: int) -> DataFrame:
    """(doc_id, text_hash, spans) of the documents with strings that occur elsewhere; spans may overlap."""
    context = docs.sparkSession.sparkContext
    folded = written(folded_segments(docs, length, gram))
    sizes = folded.groupBy(F.col("gram").alias("of")).agg(
        F.sum("n").alias("total"), F.count("*").alias("segments"), F.sum("size").alias("bytes")
    ).where("total > 1")
    known = written(folded.join(sizes, F.col("gram") == F.col("of")).drop("of"))
    several = F.col("segments") > 1
    hot = several & (F.col("bytes") > most) if gram < length else F.lit(False)
    amounts = known.agg(
        F.sum(F.when(several & ~hot, F.col("size"))), F.count(F.when(hot, 1)), F.count(F.when(several, 1))
    ).first()
    bins = max(1, math.ceil((amounts[0] or 0) / BIN_BYTES))
    chosen = context.broadcast(_filter_of(known.where(several).select("tag"), amounts[2], filter_bits))
    hot_grams = context.broadcast(_filter_of(known.where(hot).select("gram").distinct(), amounts[1], filter_bits))
    dealt = dealt_segments(docs, chosen, hot_grams, bins, length, gram)
    whole = known.where("n > 1").select(
        "gram", "key", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end"))).alias("spans")
    )
    if amounts[1]:
        dealt = written(dealt)
        split = dealt.where("part < 0").select(F.struct("gram", "key").alias("doc_id"), F.col("bytes").alias("text"))
        deeper = repeated_spans(split, length, min(4 * gram, length), most, filter_bits)
        whole = whole.union(deeper.select("doc_id.gram", "doc_id.key", "spans"))
        dealt = dealt.where("part >= 0")
    marks = written(marked_segments(dealt, length).where(F.size("spans") > 0).union(whole))
    chosen.destroy()
    hot_grams.destroy()
    found = context.broadcast(_filter_of(marks.select("key"), marks.count(), filter_bits))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def occurrences(s: Segments, texts, table):
        at = np.flatnonzero(found.value.maybe(s.key))
        doc = pa.array(s.doc[at])
        return [
            pa.array(s.gram[at]), pa.array(s.key[at]), table["doc_id"].combine_chunks().take(doc),
            table["text_hash"].combine_chunks().take(doc), pa.array(s.start[at]),
        ]

    schema = f"g bigint, k bigint, doc_id {id_type}, text_hash bigint, at bigint"
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["end"] + F.col("at")).alias("end")))
    return (
        _scan(docs, occurrences, schema, length, gram)
        .join(marks, (F.col("g") == F.col("gram")) & (F.col("k") == F.col("key")))
        .groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set(moved)).alias("spans"))
    )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes) and kept (binary) per row.

    Texts are UTF-8 bytes, null as empty; a cut may fall inside a character, so ``kept`` is
    binary. Texts shorter than ``length`` lose nothing. Repeated rows lose all strings of that
    length, as each starts elsewhere too. An empty table gives an empty one; other columns are
    left out.
    """
    small_batches(docs.sparkSession)
    spans = repeated_spans(docs, length, gram, most, filter_bits).select(
        F.col("doc_id").alias("of"), F.col("text_hash").alias("h"), "spans"
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", BATCH):
            out = []
            for text, found in zip(texts_of(table["text"].combine_chunks()), table["spans"].to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((s["start"], s["end"]) for s in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                edges = [0, *(x for s in merged for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), [{"start": a, "end": b} for a, b in merged], kept))
            n, gone, merged_all, kept_all = zip(*out, strict=True)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([
                table["doc_id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                pa.array(merged_all, kind), pa.array(kept_all, pa.binary()),
            ], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("h"))
    return rows.join(spans, same, "left").select("doc_id", "text", "spans").mapInArrow(
        cut,
        f"doc_id {id_type}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary",
    )


def repeat_digests(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
