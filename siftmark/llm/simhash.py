"""Near-duplicates by SimHash: pigeonhole blocks, a join on them, Hamming distances, components.

A fingerprint has 64 bits in ``blocks`` blocks. Two that differ in at most ``distance`` bits agree
in ``blocks - distance`` blocks at least, so each fingerprint is keyed by every choice of that many
blocks, and only fingerprints with a common key are compared. The number of blocks follows from
the number of fingerprints, so that a key has more values than there are fingerprints: the pairs
found by chance stay in proportion to the input. It does not change the result.

Equal fingerprints are one node, however many documents have them. Fingerprints under one key are
compared in tiles of a bounded size, and a tile returns a spanning forest of its links, not the
links: a group of near copies yields as many rows as it has members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmark.llm.common import LOWER, packed, pieces, small_batches, texts_of
from siftmark.session import written

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEED = 42
TILE = 2048
BATCH = 8 << 20


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if more than half of the shingles' XXH64 have it; no words: zero."""
    import xxhash

    words = text.translate(LOWER).split()  # at space and \t to \r, as bytes.split does
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    width = min(shingle, len(words))
    last = (ends[width - 1 :] - 1).tolist()
    first = [0, *ends[: len(words) - width].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[s:e], SEED) for s, e in zip(first, last, strict=True)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The rows without the text, with its fingerprint as a (signed) long; null text counts as empty."""
    small_batches(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, text, BATCH):
            for x in table.combine_chunks().to_batches():
                made = pa.array([fingerprint(t) for t in texts_of(x.column(text))], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[x.column(f.name) for f in fields], made], names=[*[f.name for f in fields], name]
                )

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.LongType())]))


def masks(count: int, distance: int = DISTANCE) -> list[int]:
    """Bit masks of all choices of blocks, for a corpus of ``count`` fingerprints."""
    need = math.log2(max(count, 2)) + 2
    blocks = next(b for b in range(distance + 1, BITS + 1) if BITS * (b - distance) / b >= need)
    edges = [BITS * b // blocks for b in range(blocks + 1)]
    block = [(1 << edges[b + 1]) - (1 << edges[b]) for b in range(blocks)]
    return [sum(choice) for choice in combinations(block, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least node that the links a-b reach."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def forest(values: np.ndarray, sizes: np.ndarray, distance: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Places (node, root) that connect, in each list of ``sizes``, all values within ``distance``."""
    end = np.repeat(np.cumsum(sizes), sizes)
    label = np.arange(len(values))
    active, step = label.copy(), 1
    held_a: list[np.ndarray] = []
    held_b: list[np.ndarray] = []
    held = 0

    def fold() -> None:
        nonlocal label, held
        if held_a:
            label = components(len(values), label[np.concatenate(held_a)], label[np.concatenate(held_b)])[label]
            held_a.clear()
            held_b.clear()
            held = 0

    while len(active := active[active + step < end[active]]):
        near = active[np.bitwise_count((values[active] ^ values[active + step]).view(np.uint64)) <= distance]
        held_a.append(near)
        held_b.append(near + step)
        held += len(near)
        if held > most:
            fold()
        step += 1
    fold()
    node = np.flatnonzero(label != np.arange(len(values)))
    return node, label[node]


def near_links(nodes: DataFrame, count: int, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within ``distance`` bits."""
    choices = F.array(*[F.lit(_signed(m)) for m in masks(count, distance)])
    keyed = nodes.select(
        F.col("fingerprint").alias("f"),
        F.posexplode(F.transform(choices, lambda m: m.bitwiseAND(F.col("fingerprint")))).alias("choice", "part"),
    )
    shared = keyed.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("f"), F.col("tiles")).cast("int")
    lists = (
        keyed.join(shared, ["choice", "part"])
        .withColumn("tiles", tiles)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .groupBy("choice", "part", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
        .agg(F.collect_list("f").alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            values = members.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(members.offsets.to_numpy()).astype(np.int64)
            node, root = forest(values, sizes, distance)
            pairs = np.unique(np.stack([values[node], values[root]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return lists.mapInArrow(link, "a bigint, b bigint").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link and isn't its root, the least node it reaches.

    Alternates two steps on the links: each node hands its larger neighbours to its least
    neighbour, then its smaller ones. Stars around the least nodes remain; rounds grow with the
    logarithm of the longest chain. No step gathers the neighbours of a node.
    """
    state, seen = written(links.where("a <> b")), None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen or mark[0] == 0:
            return state.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        seen = mark
        both = state.select("a", "b").union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(lower.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        state = written(small)


def groups(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fingerprint, root, component_id) for every distinct fingerprint of ``marked``.

    ``marked`` has (doc_id, fingerprint) and is read several times. ``root`` is the least
    fingerprint of the component, ``component_id`` the least doc_id, null if all are null.
    """
    nodes = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = connected(near_links(nodes, nodes.count(), distance))
    rooted = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    ids = rooted.groupBy(F.col("root").alias("of")).agg(F.min("first_id").alias("component_id"))
    return rooted.join(ids, F.col("root") == F.col("of")).select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Documents without words have the fingerprint zero and link like others. Repeated rows, ties
    and null ids are allowed; other columns are left out; an empty table gives an empty one.
    """
    marked = written(fingerprints(docs.select("doc_id", "text")))
    found = groups(marked, distance).select(F.col("fingerprint").alias("f"), "component_id")
    return marked.join(found, F.col("fingerprint") == F.col("f")).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each group, that of the least doc_id, with all its columns."""
    rows = written(
        fingerprints(packed(docs, "doc_id", "text")).withColumn("place", F.monotonically_increasing_id())
    )
    found = groups(rows.select("doc_id", "fingerprint"), distance).select(F.col("fingerprint").alias("f"), "root")
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.asc_nulls_last("doc_id"), "place"))
    first = (
        rows.select("doc_id", "fingerprint", "place").join(found, F.col("fingerprint") == F.col("f"))
        .withColumn("rank", rank).where("rank = 1").select("place")
    )
    return rows.join(first, "place", "left_semi").select("row.*")
