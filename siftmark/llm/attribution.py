"""Token counts of fields or sections, from whole documents that are encoded once.

Tokens have character spans: their byte lengths add up to byte offsets, and every byte belongs to
a character, so a token that holds part of a character spans that whole character. Spans are
joined with the sections of their document by interval overlap (both are sorted, so places are
found by bisection), and a token that overlaps several sections is allotted by a stated rule:

- ``first``: to the section of its first character that is in any;
- ``most``: to the section with most of its characters, the earlier of equals;
- ``split``: to all of them, in shares of the characters that overlap.

Tokens outside all sections count for none of them, but in ``doc_tokens``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.common import list_array, pieces, ranges, small_batches, texts_of
from siftmark.llm.tokens import encoder

RULES = ("first", "most", "split")
BATCH = 4 << 20


def overlaps(
    token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, section, characters in common) of sorted tokens and sorted disjoint sections."""
    low = np.searchsorted(end, token_start, "right")
    high = np.searchsorted(start, token_end, "left")
    count = np.maximum(high - low, 0)
    token = np.repeat(np.arange(len(token_start)), count)
    section = ranges(low, count)
    common = np.minimum(token_end[token], end[section]) - np.maximum(token_start[token], start[section])
    some = common > 0
    return token[some], section[some], common[some]


def allot(
    token: np.ndarray, section: np.ndarray, common: np.ndarray, rule: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, section, share) after the rule; pairs come sorted by token, then section."""
    first = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.empty(0, bool)
    if rule == "first":
        return token[first], section[first], np.ones(int(first.sum()))
    if rule == "most":
        order = np.lexsort((section, -common, token))
        return token[order][first], section[order][first], np.ones(int(first.sum()))
    total = np.add.reduceat(common, np.flatnonzero(first)) if len(token) else common
    return token, section, common / np.repeat(total, np.diff([*np.flatnonzero(first), len(token)]))


def _line_sections(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of lines with their break, of texts that end at ``edges``, and lines per text."""
    ends = np.unique(np.concatenate([np.flatnonzero(data == 0x0A) + 1, edges[1:][np.diff(edges) > 0]]))
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    number = np.searchsorted(ends, edges[1:], "right") - np.searchsorted(ends, edges[:-1], "right")
    return starts, ends, number


def section_tokens(
    docs: DataFrame, tokenizer: str, rule: str = "most", sections: str | None = None, added_tokens: bool = False,
) -> DataFrame:
    """One row per document and section: doc_id, section (0, 1, ...), start, end, n_tokens,
    n_crossing and doc_tokens.

    ``sections`` names a list column of structs with ``start`` and ``end`` in characters, sorted,
    disjoint and inside the text, or it raises; a null list or text has none. Without it sections
    are lines, each with its line break. ``n_tokens`` is a whole number unless the rule is
    ``split``; ``n_crossing`` counts tokens allotted to the section (or shared) that overlap
    others. A document without sections has one row with a null section and no tokens in it.
    Repeated rows count each; an empty table gives none; other columns are left out. With
    ``added_tokens`` a string of one of the file's added tokens is one token, else ordinary text.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made_by = encoder(tokenizer, added_tokens)
        for table in pieces(batches, "text", BATCH):
            texts = texts_of(table["text"].combine_chunks())
            ids = [np.frombuffer(made_by.encode(t.decode()), "<u4") for t in texts]
            doc_tokens = np.fromiter((len(x) for x in ids), np.int64, len(ids))
            data = np.frombuffer(b"".join(texts), np.uint8)
            edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            # Characters begun up to each byte; the texts stand one after the other.
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            last = np.cumsum(made_by.lengths[np.concatenate(ids)])
            before = np.concatenate([[0], last[:-1]])[: len(last)]
            token_start, token_end = chars[before + 1] - 1, chars[last]
            base = chars[edges]
            if sections is None:
                start, end, number = _line_sections(data, edges)
                start, end = chars[start], chars[end]
            else:
                lists = table[sections].combine_chunks()
                number = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten()
                shift = np.repeat(base[:-1], number)
                start, end = (pc.struct_field(flat, f).to_numpy(zero_copy_only=False) + shift for f in ("start", "end"))
                inside = (start >= shift) & (end <= np.repeat(base[1:], number)) & (start <= end)
                if not inside.all() or (start[1:] < end[:-1]).any():
                    raise ValueError("sections must be sorted, disjoint and inside the text")
            token, section, common = overlaps(token_start, token_end, start, end)
            many = np.bincount(token, minlength=len(token_start)) > 1
            token, section, share = allot(token, section, common, rule)
            count = np.bincount(section, share, minlength=len(start))
            crossing = np.bincount(section, many[token], minlength=len(start)).astype(np.int64)
            shift = np.repeat(base[:-1], number)
            values = pa.array(count) if rule == "split" else pa.array(count.astype(np.int64))
            made = pa.StructArray.from_arrays(
                [pa.array(start - shift), pa.array(end - shift), values, pa.array(crossing)],
                ["start", "end", "n_tokens", "n_crossing"],
            )
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), pa.array(doc_tokens), list_array(made, number)],
                names=["doc_id", "doc_tokens", "sections"],
            )

    kind = "double" if rule == "split" else "bigint"
    columns = ["doc_id", "text", *([sections] if sections else [])]
    counted = docs.select(*columns).mapInArrow(
        run,
        f"doc_id {id_type}, doc_tokens bigint, "
        f"sections array<struct<start:bigint,end:bigint,n_tokens:{kind},n_crossing:bigint>>",
    )
    return counted.select("doc_id", "doc_tokens", F.posexplode_outer("sections").alias("section", "s")).select(
        "doc_id", F.col("section").cast("bigint").alias("section"), "s.start", "s.end",
        F.coalesce("s.n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("s.n_crossing", F.lit(0)).alias("n_crossing"), "doc_tokens",
    )
