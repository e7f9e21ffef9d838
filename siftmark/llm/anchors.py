"""Content-defined anchors of windows, and small filters of bounded size to look them up in.

A window of a sequence is anchored at the gram with the least hash in it, the leftmost of equals.
The choice depends on the window's content alone, so equal windows have the same anchor gram in
the same place: a window can only repeat if its anchor gram does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import mixed

#: Low bits of a key that hold a place; the rest of the hash orders grams.
PLACE_BITS = np.uint64(28)
FILTER_BITS = 1 << 27
SLICES = 64


def _least_from(key: np.ndarray, width: int) -> np.ndarray:
    """The minimum of ``width`` values from each place on, by doubling."""
    done = 1
    while 2 * done <= width:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    rest = width - done
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def window_anchors(grams: np.ndarray, per_window: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its anchor gram) for the windows that ``valid`` marks.

    ``grams`` are the hashes of all grams of a sequence, and a window starting at i holds the
    grams from i to i + per_window - 1.
    """
    if len(grams) < per_window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(grams) >> int(PLACE_BITS):
        raise ValueError("a single text is too long")
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    window = np.flatnonzero(valid)
    return window, (_least_from(key, per_window)[window] & low).astype(np.int64)


def repeated(grams: DataFrame) -> DataFrame:
    """Values of the one long column that occur more than once."""
    name = grams.columns[0]
    return grams.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name)


def _bit(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(values.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
    return (h % np.uint64(bits)).astype(np.int64), (mixed(h) % np.uint64(bits)).astype(np.int64)


class Filter:
    """Two bits a value in ``bits`` bits, whatever the number of values: answers "maybe" or "no"."""

    def __init__(self, slices: dict[int, bytes], bits: int):
        self.bits = bits
        size = bits // 8 // SLICES
        self.data = b"".join(slices.get(i, bytes(size)) for i in range(SLICES))

    def maybe(self, values: np.ndarray) -> np.ndarray:
        data = np.frombuffer(self.data, np.uint8)
        one, two = _bit(values, self.bits)
        return ((data[one >> 3] >> (one & 7)) & (data[two >> 3] >> (two & 7)) & 1).astype(bool)


def build_filter(values: DataFrame, bits: int = FILTER_BITS) -> Filter:
    """A filter of the one long column, made by slices in tasks; ``bits`` bounds what is gathered.

    With many more values than bits it only grows less selective: more windows are looked at,
    and results stay the same.
    """
    name = values.columns[0]
    size = bits // SLICES

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_bit(batch.column(name).to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // size), pa.array(at % size)], names=["slice", "bit"])

    def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(size, bool)
        for batch in batches:
            marks[batch.column("bit").to_numpy()] = True
        packed = np.packbits(marks, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([packed])], names=["slice", "bytes"])

    filled = (
        values.mapInArrow(places, "slice bigint, bit bigint")
        .groupBy("slice").applyInArrow(fill, "slice bigint, bytes binary")
    )
    return Filter({r["slice"]: bytes(r["bytes"]) for r in filled.toLocalIterator()}, bits)
