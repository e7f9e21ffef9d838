"""WARC archives: written by Spark, read back, and indexed as globally ordered capture histories.

A record is text (header lines, an empty line, the UTF-8 payload) and ends with two line breaks,
so Spark's text writer with that separator writes valid WARC files to any store it knows. Of
equal payloads the first page is the response; the others are revisit records that refer to it.

The index is an external merge: every archive file gives a run of entries sorted by URL key and
timestamp; sampled ranges of (URL key, timestamp, place) deal the runs out, and each range merges
its parts of all runs with a loser tree. A URL with very many captures is split over ranges by
its timestamps, so no task holds more than its range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmark.llm.common import small_batches
from siftmark.session import shared_folder, written

BREAK = "\r\n"
END = BREAK * 2
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of a file and bytes of a record in it, which bound what a reader holds at a time. Files
#: of larger records have fewer: half as many for each doubling of the size.
PER_FILE, RECORD_BYTES = 1000, 16 << 10
#: Seconds of the capture time of page 0; pages have no time of their own.
EPOCH = 1_704_067_200


def sha1_base32(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a text."""
    digest = F.sha1(payload.cast("binary"))
    fives = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(
        F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def _header_value(value: Column) -> Column:
    """Line breaks and other control characters would end a header line: they are escaped."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(value.rlike(r"[\x00-\x1F\x7F]"), F.url_encode(value)).otherwise(value)


def _record_id(place: Column) -> Column:
    digest = F.md5(F.concat(F.lit("capture/"), place.cast("string")).cast("binary"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, place, payload_bytes, digest and ``first`` (page_id, place of the response).

    Null html is an empty payload. Payloads are equal when digest and length are. Among equal
    payloads of at least ``least_bytes`` the least page_id is first (nulls last, then place).
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = written(
        pages.select(
            "page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("place"),
            F.octet_length(payload).cast("bigint").alias("payload_bytes"), sha1_base32(payload).alias("digest"),
        )
    )
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "place")
    first = (
        rows.where(F.col("payload_bytes") >= least_bytes)
        .groupBy(F.col("digest").alias("d"), F.col("payload_bytes").alias("n"))
        .agg(F.min(order).alias("first"))
    )
    same = (F.col("digest") == F.col("d")) & (F.col("payload_bytes") == F.col("n"))
    return rows.join(first, same, "left").drop("d", "n")


def records(captures: DataFrame) -> DataFrame:
    """One text per record: a response with its payload, or a revisit without."""
    revisit = F.col("first").isNotNull() & (F.col("place") != F.col("first.place"))
    time = F.date_format(
        F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col("page_id").cast("bigint"), F.lit(0))),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )
    size = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("place"))),
        F.concat(F.lit("WARC-Date: "), time),
        F.concat(F.lit("WARC-Target-URI: "), _header_value(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first.place")))),
        F.when(revisit, F.concat(F.lit("Refers-To-Page: "), _header_value(F.col("first.page_id")))),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("Page-ID: "), _header_value(F.col("page_id")))),
        F.concat(F.lit("Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    ]
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return captures.select(F.concat(F.concat_ws(BREAK, *lines), F.lit(END), body).alias("value"))


def write_archives(captures: DataFrame, path: str, compress: bool = True) -> None:
    """Archive files of at most ``PER_FILE`` records and about ``PER_FILE * RECORD_BYTES`` bytes of
    payload, gzipped as a whole unless told otherwise.

    Records are written by size classes, of which there are as many as payload sizes have
    doublings; a record that is larger than a file should be is a file of its own.
    """
    size = F.greatest(F.col("payload_bytes"), F.lit(1)) / RECORD_BYTES
    sized = captures.withColumn("_class", F.greatest(F.lit(0), F.ceil(F.log2(size))).cast("int"))
    classes = [r["_class"] for r in sized.select("_class").distinct().collect()]
    for number in sorted(classes) or [0]:
        of_class = sized.where(F.col("_class") == number)
        writer = records(of_class).write.mode("append").option("lineSep", END)
        writer.option("maxRecordsPerFile", max(1, PER_FILE >> number)).option(
            "compression", "gzip" if compress else "none"
        ).text(path)


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record; lengths alone say where records end."""
    at = 0
    while at < len(data):
        if not data.startswith(VERSION.encode(), at):
            raise ValueError(f"no record at byte {at}")
        stop = data.index(END.encode(), at)
        headers = dict(line.split(": ", 1) for line in data[at:stop].decode().split(BREAK)[1:])
        begin = stop + len(END)
        end = begin + int(headers["Content-Length"])
        if data[end : end + len(END)] != END.encode():
            raise ValueError(f"record at byte {at} has not the length that it says")
        yield at, headers, data[begin:end]
        at = end + len(END)


def url_key(url: str) -> str:
    """A key that orders captures by host, from the top-level domain down, then path and query."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return quote(url.strip().lower(), safe="/:?&=,)%")
    host = re.sub(r"^www\d*\.", "", host)
    if port in (80, 443):
        port = None
    query = "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    path = re.sub(r"/+$", "", parts.path.lower()) or "/"
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + path + ("?" + query if query else "")


ENTRY = (
    "run string, url_key string, time string, offset bigint, page_id string, record_type string, "
    "payload_bytes bigint, payload_digest string, refers_to string, url string"
)
_TYPES = {"string": pa.string(), "bigint": pa.int64()}
ENTRY_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (x.split(" ") for x in ENTRY.split(", "))])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One entry per record, each file's entries sorted by (url_key, time, offset): a run.

    A response's length and digest are taken from its payload and must be those of its headers.
    """
    small_batches(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py()
                if name.endswith(".gz"):
                    data = gzip.decompress(data)
                entries = []
                for offset, h, block in parse(data):
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["Payload-Length"])
                    if h["WARC-Type"] == "response" and (
                        size != len(block) or digest != base64.b32encode(hashlib.sha1(block).digest()).decode()
                    ):
                        raise ValueError(f"payload of {h['WARC-Record-ID']} in {name} is not what its headers say")
                    url = h["WARC-Target-URI"]
                    entries.append((
                        name, url_key(url), h["WARC-Date"], offset, h.get("Page-ID"), h["WARC-Type"], size,
                        digest, h.get("Refers-To-Page"), url,
                    ))
                entries.sort(key=lambda e: e[1:4])
                columns = list(zip(*entries, strict=True)) or [()] * len(ENTRY_SCHEMA)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, ENTRY_SCHEMA, strict=True)], schema=ENTRY_SCHEMA
                )

    # One file a row, so that a batch holds few of them.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(~F.col("path").rlike(r"/[_.][^/]*$")).select("path", "content").mapInArrow(scan, ENTRY)


class LoserTree:
    """K-way merge: inner nodes keep the losers, so each step replays one leaf's path only."""

    def __init__(self, runs: list[list]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = max(1, 1 << (len(runs) - 1).bit_length()) if runs else 1
        self.losers = [-1] * self.size
        self.winner = self._build(1) if runs else -1

    def _key(self, leaf: int):
        if leaf < 0 or leaf >= len(self.runs) or self.at[leaf] >= len(self.runs[leaf]):
            return None
        return self.runs[leaf][self.at[leaf]]

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._key(a), self._key(b)
        return y is None or (x is not None and (x, a) <= (y, b))

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        left, right = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (left, right) if self._beats(left, right) else (right, left)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while (item := self._key(self.winner)) is not None:
            yield item
            self.at[self.winner] += 1
            node, best = (self.winner + self.size) // 2, self.winner
            while node:
                if self._beats(self.losers[node], best):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.winner = best


def merge_runs(entries: DataFrame, ranges: int | None = None) -> DataFrame:
    """All entries in the order of (url_key, time, run, offset), range by range.

    Adds ``part``, the range, and ``ordinal``, the place in it: (part, ordinal) is the global order.
    """
    cols = ["url_key", "time", "run", "offset"]
    dealt = entries.repartitionByRange(ranges, *cols) if ranges else entries.repartitionByRange(*cols)
    dealt = dealt.withColumn("part", F.spark_partition_id()).sortWithinPartitions("run", "url_key", "time", "offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        runs: dict[str, list] = {}
        keys = zip(*(table[c].to_pylist() for c in cols), range(table.num_rows), strict=True)
        for key in keys:
            runs.setdefault(key[2], []).append(key)
        order = pa.array([key[-1] for key in LoserTree(list(runs.values()))], pa.int64())
        merged = table.take(order).append_column("ordinal", pa.array(range(len(order)), pa.int64()))
        yield from merged.combine_chunks().to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(merge, f"{ENTRY}, part int, ordinal bigint")


def histories(index: DataFrame) -> DataFrame:
    """The merged index with ``capture``, the place (from 1) of a record among those of its URL key."""
    part = Window.partitionBy("url_key", "part").orderBy("ordinal")
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = index.groupBy("url_key", "part").agg(F.count("*").alias("n")).select(
        F.col("url_key").alias("k"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o")
    )
    same = (F.col("url_key") == F.col("k")) & (F.col("part") == F.col("p"))
    return index.withColumn("row", F.row_number().over(part)).join(offsets, same).withColumn(
        "capture", F.col("row") + F.col("o")
    ).drop("k", "p", "o", "row")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write a record per page, read the archives back, merge their index; one row per page.

    page_id, payload_bytes, payload_digest (of the full payload), record_type, refers_to (the
    response's page_id for a revisit, else null), url_key, time and capture. An empty table gives
    no records. Repeated pages are records each. Columns beside page_id, url and html are left out.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(with_revisits(pages, least_bytes), path)
    id_type = pages.schema["page_id"].dataType
    index = written(merge_runs(read_archives(spark, path)))
    return histories(index).select(
        F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"), "url_key", "time", "capture",
    )
