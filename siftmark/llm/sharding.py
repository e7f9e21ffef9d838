"""Sharding by rendezvous hashing over weighted shards, in DataFrame functions only.

Each (key, shard) pair gets a pseudo-random number in (0, 1), made of the first 52 bits of an
MD5; the shard with the least ``-ln(number) / weight`` takes the key. The choice depends on the
key and the shards alone, so a new shard only takes keys into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.operators.ranking import row_number_within

HEX_DIGITS = 13  # of the MD5: 52 bits, exact in a double


def scores(key: Column, weights: list[float]) -> Column:
    """One (score, shard) struct per shard; a null key counts as the text ``null``."""
    named = F.coalesce(key.cast("string"), F.lit("null"))

    def score(weight: Column, shard: Column) -> Column:
        digest = F.md5(F.concat_ws("/", named, shard.cast("string")).cast("binary"))
        number = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double")
        return F.struct(
            (-F.log((number + 0.5) / float(16**HEX_DIGITS)) / weight).alias("score"),
            shard.alias("shard"),
        )

    return F.transform(F.array(*[F.lit(float(w)) for w in weights]), score)


def assign(docs: DataFrame, key: str, weights: list[float], grown: float = 1.0) -> DataFrame:
    """``shard`` for every row, and ``grown_shard``, the one with a further shard.

    Weights must be positive. Equal keys go to one shard; ties of scores go to the lower shard.
    An empty table gives an empty table. Columns named ``shard`` or ``grown_shard`` are replaced.
    """
    if not weights or min([*weights, grown]) <= 0:
        raise ValueError("weights must be positive, and there must be one at least")
    both = F.transform(
        F.array(scores(F.col(key), [*weights, grown])),
        lambda s: F.struct(
            F.array_min(F.slice(s, 1, len(weights)))["shard"].alias("shard"),
            F.array_min(s)["shard"].alias("grown"),
        ),
    )[0]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "grown_shard")]
    return docs.select(*kept, both.alias("_both")).select(
        *kept, F.col("_both.shard").alias("shard"), F.col("_both.grown").alias("grown_shard")
    )


def shard_documents(docs: DataFrame, shards: int = 40, weights: list[float] | None = None) -> DataFrame:
    """Place every document in a shard by its ``doc_id``.

    Returns doc_id, size (UTF-8 bytes of the text, null as none, plus 16), text_crc32, law
    (``key``), shard, slot (0, 1, ... in each shard along doc_id) and grown_shard. Rows of equal
    doc_id share a shard and get slots in no particular order. Other columns of the input,
    whatever their names, are left out. Only these small columns are shuffled, not the texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = assign(rows, "doc_id", weights or [1.0] * shards)
    numbered = row_number_within(placed, ["shard"], ["doc_id"], "place")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("place") - 1).cast("bigint").alias("slot"), "grown_shard",
    )
