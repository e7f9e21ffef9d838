"""Archives: round trip, revisits, order of the merged index, and the merge itself."""

import base64
import hashlib
import heapq
import random

import pytest

from siftmark.llm import warc
from tests.llm.data import SF, ordered, rows

AWKWARD = [
    (1, "http://a.example/x", "same"), (2, "http://b.example/?b=2&a=1", "same"), (0, "https://www.a.example:443/X/", "WARC/1.1\r\n\r\n"),
    (5, None, None), (4, "", ""), (None, "http://[bad", "same"), (7, "http://a.example/\r\nWARC-Type: bogus", "é\r\n\r\n\x01"),
    (8, "http://a.example/x", "other"), (9, "http://a.example/x", "same"), (9, "http://a.example/x", "same"),
]


def expected(pages, least=0):
    first = {}
    for page, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        if len((html or "").encode()) >= least:
            first.setdefault(html or "", page)
    out, seen = [], set()
    for page, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        data = (html or "").encode()
        lead = len(data) < least or (html or "") not in seen
        seen.add(html or "")
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if lead else "revisit", None if lead else first[html or ""]))
    return out


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("least", [0, 5])
def test_awkward_pages(spark, least):
    pages = spark.createDataFrame(AWKWARD, "page_id long, url string, html string").selectExpr("*", "1 as place", "2 as digest")
    got = warc.archive_round_trip(pages, least)
    assert rows(got, *COLUMNS) == ordered(expected(AWKWARD, least))
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plain = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    got = warc.archive_round_trip(pages)
    assert rows(got, *COLUMNS) == ordered(expected(plain))


def test_files_are_warc(spark, tmp_path):
    pages = spark.createDataFrame(AWKWARD, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.with_revisits(pages), str(tmp_path / "w"), compress=False)
    records = [r for f in sorted((tmp_path / "w").glob("part-*")) for r in warc.parse(f.read_bytes())]
    assert len(records) == len(AWKWARD)
    assert len({h["WARC-Record-ID"] for _, h, _ in records}) == len(AWKWARD)
    for _, headers, block in records:
        assert headers["WARC-Type"] in ("response", "revisit") and int(headers["Content-Length"]) == len(block)
        assert ("WARC-Refers-To" in headers) == (headers["WARC-Type"] == "revisit")
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


def test_histories_are_in_order(spark, tmp_path):
    pages = spark.range(400).selectExpr("id as page_id", "concat('http://h', id % 7, '.example/', id % 3) as url", "'t' as html")
    pages = pages.union(spark.range(400, 700).selectExpr("id", "'http://hot.example/'", "'u'"))
    warc.write_archives(warc.with_revisits(pages.repartition(6)), str(tmp_path / "w"))
    index = warc.merge_runs(warc.read_archives(spark, str(tmp_path / "w")), 5)
    got = warc.histories(index).collect()
    keys = [(r["url_key"], r["time"]) for r in sorted(got, key=lambda r: (r["part"], r["ordinal"]))]
    assert keys == sorted(keys) and len(keys) == 700
    hot = sorted((r for r in got if r["url_key"] == "example,hot)/"), key=lambda r: r["capture"])
    assert [r["capture"] for r in hot] == list(range(1, 301)) and len({r["part"] for r in hot}) > 1
    assert [r["time"] for r in hot] == sorted(r["time"] for r in hot)


def test_loser_tree():
    rnd = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rnd.randint(0, 50) for _ in range(rnd.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == list(heapq.merge(*runs))


def test_url_keys():
    assert warc.url_key("http://www.A.example:80/P/?b=1&a=2") == "example,a)/p?a=2&b=1"
    assert warc.url_key("https://x.example:8443") == "example,x:8443)/"
    assert warc.url_key("") == ")/"


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PER_FILE", 8)
    monkeypatch.setattr(warc, "RECORD_BYTES", 100)
    sizes = [10] * 20 + [150] * 9 + [399, 400, 401] * 3 + [5000] * 2 + [0]
    pages = spark.createDataFrame([(i, f"http://h/{i}", chr(97 + i % 26) * n) for i, n in enumerate(sizes)],
                                  "page_id long, url string, html string").repartition(2)
    warc.write_archives(warc.with_revisits(pages, 10**9), str(tmp_path / "w"), compress=False)
    files = [[len(block) for _, _, block in warc.parse(f.read_bytes())] for f in (tmp_path / "w").glob("part-*")]
    assert sorted(n for f in files for n in f) == sorted(sizes)
    assert all(len(f) <= 8 and (sum(f) <= 800 or len(f) == 1) for f in files)
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == len(sizes)
    got = warc.archive_round_trip(pages)
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got.collect()) == list(enumerate(sizes))
