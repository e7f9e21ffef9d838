"""Packing by power-of-two decomposition: no sequence holds tokens of two documents.

A document of ``n`` tokens becomes ``n // max_len`` pieces of ``max_len`` and one piece for each
bit that is set in the rest, the longest first. Every piece is a sequence of its own, so it needs
no padding, and batches are made of sequences of one length: the bucket of a piece is its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import list_array, pieces, small_batches
from siftmark.llm.tokens import encoder

MAX_LEN = 2048
END = 1
BATCH = 4 << 20


def piece_lengths(n: int, max_len: int) -> list[int]:
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length(), -1, -1) if rest >> b & 1]


def _cut(counts: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of all pieces, document by document, and the number for each document."""
    full, bits = counts // max_len, max_len.bit_length() - 1
    ladder = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    used = (counts[:, None] & ladder[None, :]) > 0
    number = full + used.sum(axis=1)
    lengths = np.full(int(number.sum()), max_len, np.int64)
    ends = np.cumsum(number)
    row, column = np.nonzero(used)
    place = ends[row] - used.sum(axis=1)[row] + (np.cumsum(used, axis=1) - 1)[row, column]
    lengths[place] = ladder[column]
    return lengths, number


def tokenize_pieces(
    docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end: int = END, added_tokens: bool = False
) -> DataFrame:
    """Each row's doc_id with its pieces.

    doc_tokens counts the ids of the text and the closing id ``end``. ``pieces`` is a list of
    structs: start, length and ids (little-endian unsigned 32-bit integers). A null or empty text
    has the closing id alone. Repeated rows are packed each. With ``added_tokens`` strings of the
    file's added tokens get their ids; else they are ordinary text.
    """
    if max_len & (max_len - 1) or max_len < 1:
        raise ValueError("max_len must be a power of two")
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    closing = np.array([end], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, added_tokens).encode
        for table in pieces(batches, "text", BATCH):
            ids = [encode(t or "") + closing for t in table["text"].to_pylist()]
            counts = np.fromiter((len(x) >> 2 for x in ids), np.int64, len(ids))
            lengths, number = _cut(counts, max_len)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            owner = np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), number)
            data = b"".join(ids)
            values = pa.Array.from_buffers(
                pa.binary(), len(lengths),
                [None, pa.py_buffer((edges * 4).astype(np.int32).tobytes()), pa.py_buffer(data)],
            )
            made = pa.StructArray.from_arrays(
                [pa.array(edges[:-1] - owner), pa.array(lengths), values], ["start", "length", "ids"]
            )
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), pa.array(counts), list_array(made, number)],
                names=["doc_id", "doc_tokens", "pieces"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        pack,
        f"doc_id {id_type}, doc_tokens bigint, "
        "pieces array<struct<start:bigint,length:bigint,ids:binary>>",
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end: int = END, added_tokens: bool = False
) -> DataFrame:
    """One row per piece: doc_id, doc_tokens, start, length (the bucket), ids, sequence_id, offset.

    ``sequence_id`` is unique within one result; as every piece is a whole sequence, ``offset`` is
    0. An empty table gives an empty one. Columns other than doc_id and text are left out.
    """
    rows = tokenize_pieces(docs, tokenizer, max_len, end, added_tokens)
    return rows.select("doc_id", "doc_tokens", F.explode("pieces").alias("p")).select(
        "doc_id", "doc_tokens", "p.*",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences of equal length together, for loaders that batch within a bucket."""
    pieces.write.partitionBy("length").parquet(path)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in their place."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
