"""Periodic runs of words, found by recompression.

A run of smallest period q is a stretch of words that are equal q words apart and that no
neighbour extends. A run of at least four periods holds a stretch of 3q places that equal the
place q later, so one of the places 0, 3q, 6q, ... lies in it: for each period those grid places
are candidates, n/3 (1 + 1/2 + 1/3 + ...) in all. How far a candidate extends to both sides is
asked of the run-length grammar of the words (``grammar``), which is built once for a batch of
documents and answers all candidates of the batch together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm import grammar
from siftmark.llm.common import list_array, pieces, ranges, small_batches, texts_of

PERIODS = 4  # a run has so many periods at least
SHORTEST = 6  # and so many words
BATCH = 1 << 20
#: Grids of texts up to so many words are kept.
KEPT_GRID, GRID_STEP = 4096, 64


@lru_cache(KEPT_GRID // GRID_STEP)
def _kept_grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    period = np.arange(1, n // PERIODS + 1)
    counts = -(-(n - period) // ((PERIODS - 1) * period))
    period = np.repeat(period, counts)
    return ranges(np.zeros(len(counts), np.int64), counts) * (PERIODS - 1) * period, period


def candidates(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid places whose word stands again one period later, and these periods."""
    n = len(words)
    if n <= KEPT_GRID:
        place, period = _kept_grid(-(-n // GRID_STEP) * GRID_STEP)
        inside = place + period < n
        place, period = place[inside], period[inside]
        hit = words[place] == words[place + period]
        return place[hit], period[hit]
    found = []
    for p in range(1, n // PERIODS + 1):
        step = (PERIODS - 1) * p
        hit = np.flatnonzero(words[: n - p : step] == words[p::step])
        if len(hit):
            found.append((hit * step, np.full(len(hit), p)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def find_runs(texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of some texts of word numbers, in this order."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    # Each text stands between two symbols that occur once.
    first = np.cumsum(sizes + 1) - sizes
    symbols = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    symbols[np.append(first - 1, len(symbols) - 1)] = np.arange(len(texts) + 1)
    symbols[ranges(first, sizes)] = np.concatenate([*texts, np.empty(0, np.int64)]) + len(texts) + 1
    found = [candidates(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p, _ in found])
    place = np.concatenate([np.empty(0, np.int64), *[p for p, _ in found]]) + first[owner]
    period = np.concatenate([np.empty(0, np.int64), *[q for _, q in found]])
    levels = grammar.compress(symbols)
    after = grammar.extensions(levels, place, place + period)
    n = len(symbols)
    before = grammar.extensions(grammar.mirrored(levels), n - place, n - place - period)
    start, length = place - before - first[owner], before + after + period
    runs = (length >= SHORTEST) & (length >= PERIODS * period)
    # A multiple of the smallest period gives the same stretch; the least period comes first.
    order = np.lexsort((period[runs], length[runs], start[runs], owner[runs]))
    owner, start, length, period = (c[runs][order] for c in (owner, start, length, period))
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    owner, start, length, period = (c[new] for c in (owner, start, length, period))
    order = np.lexsort((period, start, owner))
    return tuple(c[order] for c in (owner, start, length, period))


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run holds after its first period."""
    if not len(start):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    return b" ".join([words[i] for i in kept])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs and collapsed_text of every row.

    ``runs`` are structs (start, length, period) in words, by start and period: all runs of at
    least four periods and six words. ``collapsed_text`` has the words that are left when every
    run is cut to its first period, joined by single blanks. A null or empty text has no words
    and no runs; repeated rows count each; other columns are left out, whatever their names; an
    empty table gives an empty one. Words are compared as they are, not by hashes. A task holds
    about 1 MB of text, or one text if that is longer.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text", BATCH):
            numbers: dict[bytes, int] = {}
            words = [t.split() for t in texts_of(table["text"].combine_chunks())]
            ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in t), np.int64, len(t)) for t in words]
            owner, start, length, period = find_runs(ids)
            counts = np.bincount(owner, minlength=len(words))
            bounds = np.concatenate([[0], np.cumsum(counts)])
            left = [
                _collapsed(t, start[a:b], length[a:b], period[a:b]).decode()
                for t, a, b in zip(words, bounds, bounds[1:], strict=False)
            ]
            made = pa.StructArray.from_arrays(
                [pa.array(c.astype(np.int64)) for c in (start, length, period)], ["start", "length", "period"]
            )
            yield pa.RecordBatch.from_arrays([
                table["doc_id"].combine_chunks(), pa.array([len(t) for t in words], pa.int64()),
                list_array(made, counts), pa.array(left, pa.string()),
            ], names=["doc_id", "n_words", "runs", "collapsed_text"])

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {id_type}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
        "collapsed_text string",
    )


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and hashes of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    longest = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period")))
    )
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return periodic_runs(docs).select("*", longest.alias("best")).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.minus")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.minus") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """The texts, one of ten (by the CRC-32 h of its doc_id) with a tail that repeats its first words.

    With g = h div 10, word i from a = g mod n on becomes word a + (i - a) mod p, where
    p = 1 + (n - a) div (3 + g mod 8). Null ids and texts without words stay as they are.
    """
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(code / 10).cast("bigint")

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(F.col("_g"), n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(F.col("_g"), F.lit(8)))).cast("bigint")

        def bound(x: Column) -> Column:
            return F.array_join(
                F.transform(x["words"], lambda w, i: F.when(
                    i >= x["a"], F.get(x["words"], (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int"))
                ).otherwise(w)), " ")

        return F.transform(F.array(F.struct(words.alias("words"), a.alias("a"), p.alias("p"))), bound)[0]

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)))[0]
    return docs.select("doc_id", "text", g.alias("_g"), (F.pmod(code, F.lit(10)) == 0).alias("_changed")).select(
        "doc_id", F.when(F.col("_changed"), F.coalesce(changed, F.col("text"))).otherwise(F.col("text")).alias("text")
    )
