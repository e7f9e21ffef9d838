"""Small helpers on text bytes, Arrow batches and hashes that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 16 << 20
#: Bytes that are worked on at a time; a longer text is a piece of its own.
PIECE = 1 << 20

#: The blank bytes between words: space and \\t to \\r.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Lower case for A-Z only, as a table for ``bytes.translate``.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, unless the session has a bound: rows can be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES * 4:
        spark.conf.set(name, str(BATCH_BYTES))


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns ``needed`` under these names, and all columns as the struct ``row``."""
    return docs.select(F.struct("*").alias("row"), *needed)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    have = _POWERS.get("base")
    if have is None or len(have) < n:
        n = max(n, 1 << 16)
        for name, x in (("base", _BASE), ("inverse", _INVERSE)):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["base"], _POWERS["inverse"]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Rabin-Karp prefix sums: ``span_hashes`` takes the hash of any span from them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span [start, end), the same wherever its values stand."""
    return mixed((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits, so that high and low bits are equally good."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _VALUES[data]


def word_spans(data: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = word_byte[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a byte array, a piece at a time."""
    starts, ends = word_spans(data, word_byte)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        origin = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, origin + PIECE, "right")))
        sums = prefix_sums(byte_values(data[origin : ends[upto - 1]]))
        out[at:upto] = span_hashes(sums, starts[at:upto] - origin, ends[at:upto] - origin)
        at = upto
    return starts, ends, out


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def joined(texts: list[bytes], between: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array with a separator after each, and the start of each."""
    sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    return np.frombuffer(between.join([*texts, b""]), np.uint8), starts


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """The rows again, in runs whose texts hold about ``most`` bytes, one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.diff(np.frombuffer(_offsets(batch.column(column)), np.int64))
        start = 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += int(n)
        if batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _offsets(column: pa.Array) -> bytes:
    """Running byte lengths of a text column, as 64-bit integers."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64).tobytes()


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    padded = np.zeros(len(marks) + 2, bool)
    padded[1:-1] = marks
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return edges[::2], edges[1::2]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each start, ``count`` values, one after the other."""
    total = int(counts.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if total else np.empty(0, np.int64)
    return np.arange(total, dtype=np.int64) + shift.astype(np.int64)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column: the first ``counts[0]`` values, then the next ``counts[1]``, ..."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)
