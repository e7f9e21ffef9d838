"""Line deduplication by pairwise alignment.

Documents are lists of lines. Two texts that share a line with a word are aligned by patience diff:
lines that occur once on both sides, longest increasing chain, runs of equal lines around them, and
the same again in the gaps. A gap without such lines pairs the k-th occurrences of its lines, so none
is left with a common line. Common blocks that hold a line with a word are deleted from the later
text, and a text loses what any of its alignments with earlier texts deletes.

Most of these pairs would change nothing and are not made. Each later text first meets the earliest
text with the same key: a line with a word, or a line without one together with the nearest line
with a word on one side and the distance to it, for only blocks that hold both can delete it. Where
a key still stands, the text meets the next holder of the key, then the next two, four, ..., until
it is deleted or has met all earlier holders. The earlier side is always the text as it came in, not what is left.

Equal texts are one text for all this; all but the first document of it align with the first as a
whole and lose all their lines. Order is that of doc_id, nulls last, then of place in the input.
Only line hashes are joined; texts are read once to hash them and once to cut them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmark.llm.common import list_array, mixed, packed, small_batches
from siftmark.operators.ranking import row_number_within
from siftmark.session import written


def _chain(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """The longest chain, rising on both sides, of lines that occur once in each range.

    Where there are none, the k-th occurrence of a line on one side goes with the k-th on the other.
    """
    times_a, times_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    once = any(n == 1 and times_b[x] == 1 for x, n in times_a.items())
    seen_a, seen_b = Counter(), Counter()
    at_b: dict[tuple, int] = {}
    for j in range(b0, b1):
        x = b[j]
        if x in times_a and (not once or times_a[x] == times_b[x] == 1):
            at_b[x, seen_b[x]] = j
            seen_b[x] += 1
    piles: list[int] = []
    top: list[int] = []
    back: list[int] = []
    pairs: list[tuple[int, int]] = []
    for i in range(a0, a1):
        j = at_b.get((a[i], seen_a[a[i]]))
        seen_a[a[i]] += 1
        if j is None:
            continue
        pile = bisect_left(piles, j)
        back.append(top[pile - 1] if pile else -1)
        pairs.append((i, j))
        if pile == len(piles):
            piles.append(j)
            top.append(len(pairs) - 1)
        else:
            piles[pile], top[pile] = j, len(pairs) - 1
    chain, k = [], top[-1] if top else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def patience_blocks(a: list, b: list) -> list[tuple[int, int, int]]:
    """Common blocks (place in a, place in b, length) of two lists of hashable lines."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        chain = _chain(a, b, a0, a1, b0, b1)
        last_a, last_b = a0, b0
        for i, j in chain:
            matched.append((i, j))
            todo.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
        if chain:
            todo.append((last_a, a1, last_b, b1))
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(matched):
        if blocks and (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]) == (i, j):
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys_of(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, place in the text) of lists of line hashes, which are odd for lines with a word.

    The key of a line with a word is its hash. Other lines have an even key for the nearest line
    with a word on each side, made of that line's hash and the distance.
    """
    flat = lines.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = lines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(counts) - counts
    row, at = np.repeat(np.arange(len(counts)), counts), np.arange(len(flat))
    word = flat & 1 == 1
    before = np.maximum.accumulate(np.where(word, at, -1))
    after = np.minimum.accumulate(np.where(word, at, len(flat))[::-1])[::-1]
    back = np.flatnonzero(~word & (before >= starts[row]))
    ahead = np.flatnonzero(~word & (after < (starts + counts)[row]))
    own = np.flatnonzero(word)
    near = np.concatenate([before[back], after[ahead]])
    apart = np.concatenate([back, ahead]) - near
    even = mixed(flat[near].view(np.uint64) ^ mixed(apart.astype(np.uint64))) & ~np.uint64(1)
    places = np.concatenate([own, back, ahead])
    return row[places], np.concatenate([flat[own], even.view(np.int64)]), (places - starts[row[places]])


def _with_keys(hashed: DataFrame) -> DataFrame:
    """The rows with ``keys``, the distinct keys of their lines."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key, _ = _keys_of(batch.column("lines"))
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
            keys = list_array(pa.array(key[new]), np.bincount(row[new], minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "keys"])

    return hashed.mapInArrow(add, T.StructType([*hashed.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))]))


def _aligned(pairs: DataFrame) -> DataFrame:
    """For each pair the places of the later text's lines that the alignment deletes, and the key
    and place of those it leaves of the keys in ``shared``."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, left = [], []
            row, key, place = _keys_of(batch.column("after"))
            order = np.argsort(row, kind="stable")
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
            spots = np.split(order, ends[:-1])
            for k, (a, b, shared) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("before", "after", "shared")), strict=True)
            ):
                out = {
                    p for _, j, n in patience_blocks(a, b) if any(x & 1 for x in b[j : j + n])
                    for p in range(j, j + n)
                }
                gone.append(sorted(out))
                held = set(shared)
                left.append([
                    {"key": x, "k": p} for x, p in zip(key[spots[k]].tolist(), place[spots[k]].tolist(), strict=True)
                    if x in held and p not in out
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column("later"), pa.array(gone, pa.list_(pa.int32())),
                 pa.array(left, pa.list_(pa.struct([("key", pa.int64()), ("k", pa.int32())])))],
                names=["later", "gone", "left"],
            )

    return pairs.select("later", "before", "after", "shared").mapInArrow(
        align, "later bigint, gone array<int>, left array<struct<key:bigint,k:int>>"
    )


def deletions(hashed: DataFrame) -> DataFrame:
    """(place, whole, gone): documents that lose all lines, or the places of the lines they lose.

    ``hashed`` has place (unique), doc_id, text_hash, lines (hashes, odd for lines with a word) and
    keys; it is read several times.
    """
    first = Window.partitionBy("text_hash").orderBy(F.asc_nulls_last("doc_id"), "place")
    leaders = (
        hashed.select("text_hash", "doc_id", "place").withColumn("rank", F.row_number().over(first))
        .where("rank = 1").select(F.col("place").alias("leader"))
    )
    texts = written(hashed.join(leaders, F.col("place") == F.col("leader"), "left"))
    copies = texts.where("leader is null and size(keys) > 0").select(
        "place", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("gone")
    )
    distinct = texts.where("leader is not null")
    held = distinct.select("place", F.col("doc_id").isNull().alias("no_id"), "doc_id", F.explode("keys").alias("key"))
    before = distinct.select(F.col("place").alias("b_place"), F.col("lines").alias("before"))
    after = distinct.select(F.col("place").alias("a_place"), F.col("lines").alias("after"))

    def align(pairs: DataFrame) -> DataFrame:
        """Written: what the pairs (later, earlier, key) delete and leave."""
        pairs = pairs.groupBy("later", "earlier").agg(F.collect_list("key").alias("shared"))
        return written(_aligned(
            pairs.join(before, F.col("earlier") == F.col("b_place")).join(after, F.col("later") == F.col("a_place"))
        ))

    def places(aligned: DataFrame) -> DataFrame:
        return aligned.select("later", F.explode("gone").alias("k"))

    # Written, so that the join below has a common line's rows in an exchange that can be split.
    common = written(
        held.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("no_id", "doc_id", "place")).alias("first"))
        .where("n > 1")
        .select(F.col("key").alias("of"), F.col("first.place").alias("earlier"))
    )
    found = align(
        held.join(common, F.col("key") == F.col("of")).where("place <> earlier")
        .select(F.col("place").alias("later"), "earlier", "key")
    )
    gone = places(found)
    left = found.select("later", F.explode("left").alias("x")).select("later", "x.key", "x.k")
    stands = written(left.join(gone, ["later", "k"], "left_anti"))
    if not stands.isEmpty():
        # Holders of the keys that stand, numbered from 1; a text's own number tells how many are before it.
        of = stands.select(F.col("key").alias("of")).distinct()
        holders = written(
            row_number_within(
                held.join(of, F.col("key") == F.col("of"), "left_semi"), ["key"], ["no_id", "doc_id", "place"], "number"
            ).select("key", "number", F.col("place").alias("earlier"))
        )
        own = holders.select("key", F.col("number").alias("own"), F.col("earlier").alias("later"))
        stands = stands.join(own, ["later", "key"])
        at, end = 2, 3
        while not (stands := written(stands.where(F.col("own") > at))).isEmpty():
            number = F.explode(F.sequence(F.lit(at), F.least(F.col("own") - 1, F.lit(end - 1)))).alias("number")
            # Written, so that the few pairs are known to be few.
            few = written(
                stands.select("later", "key", "own").distinct().select("later", "key", number)
                .join(holders, ["key", "number"]).select("later", "earlier", "key")
            )
            more = places(align(few))
            gone = gone.union(more)
            stands = stands.join(more, ["later", "k"], "left_anti")
            at, end = end, end + 2 * (end - at)
    gone = gone.groupBy(F.col("later").alias("place")).agg(F.collect_set("k").alias("gone"))
    return copies.union(gone.select("place", F.lit(False).alias("whole"), "gone"))


def cut_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows with n_lines, removed (sorted places of deleted lines) and kept_text.

    A null or empty text has no lines (n_lines 0) and stays as it is. ``docs`` must not have
    columns with these names or ``place``; ``packed`` rows don't. Repeated rows are copies: all
    but the first lose their lines. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = written(docs.withColumn("place", F.monotonically_increasing_id()))
    lines = _lines(F.col(text))
    odd, even = F.lit(1).cast("bigint"), F.lit(-2).cast("bigint")

    def hashed_line(x: Column) -> Column:
        return F.when(x.rlike(r"[^ \t-\r]"), F.xxhash64(x).bitwiseOR(odd)).otherwise(F.xxhash64(x).bitwiseAND(even))

    hashed = written(_with_keys(
        rows.where(F.length(text) > 0).select(
            "place", F.col(key).alias("doc_id"),
            F.struct(
                F.xxhash64(text).alias("hash"), F.length(text).alias("length"),
                F.crc32(F.col(text).cast("binary")).alias("crc"),
            ).alias("text_hash"),
            F.transform(lines, hashed_line).alias("lines"),
        )
    ))
    found = deletions(hashed).withColumnRenamed("place", "of")
    n = F.when(F.length(text) > 0, F.size(lines)).otherwise(0)
    everything = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cut = rows.join(found, F.col("place") == F.col("of"), "left").withColumns({
        "n_lines": n.cast("bigint"),
        "removed": F.when(F.col("whole"), everything)
        .otherwise(F.array_sort(F.coalesce("gone", F.array().cast("array<int>")))),
    })
    left = F.transform(
        F.array(_lines(F.col(text))),
        lambda x: F.array_join(
            F.transform(F.array_except(everything, F.col("removed")), lambda i: F.get(x, i)), "\n"
        ),
    )[0]
    return cut.withColumn("kept_text", F.when(F.size("removed") == 0, F.col(text)).otherwise(left)).drop(
        "place", "of", "whole", "gone"
    )


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of what is left (a null text as empty)."""
    cut = cut_lines(docs.select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"),
        F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents without deleted lines; those that lose every line with a word are left out.

    ``n_chars``, where there is such a column, counts the new text's characters.
    """
    cut = cut_lines(packed(docs, "doc_id", "text"))
    gone = (F.size("removed") > 0) & ~F.col("kept_text").rlike(r"[^ \t-\r]")
    row = F.col("row").withField("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.size("removed") > 0, F.length("kept_text").cast(kind)).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", changed)
    return cut.where(~gone).select(row.alias("row")).select("row.*")
