"""WARC archives: round trips, revisits and range reads."""

import gzip
import hashlib

from pyspark.sql import functions as F

from corvane.llm import warc
from corvane.llm.workspace import Workspace

PAGES = "page_id long, url string, html string, extra string, archive string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "clash") for r in rows], PAGES)


BIG, OTHER = "é" * 600, "b" * 1000
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/ 2\r\nX: y", BIG), (9, None, BIG), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "", ""), (7, "u", "a\r\n\r\nb" * 300),
    (10, "u", OTHER), (10, "u", OTHER), (11, "u", "b" * 999), (12, "u", "b" * 999), (None, "u", OTHER), (-8, "u", "x" * 200_000),
]


def expected(rows):
    facts = [(p, (h or "").encode()) for p, _, h in rows]
    owner = {}
    for p, b in facts:
        if len(b) >= 1000 and p is not None:
            owner[b] = max(owner.get(b, p), p)
    out = []
    for p, b in facts:
        o = owner.get(b)
        revisit = len(b) >= 1000 and o is not None and (p is None or p < o)
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", o if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.round_trip(pages(spark, ROWS)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(ROWS)


def test_hot_payload(spark):
    rows = [(i, f"http://h/{i}", BIG if i % 3 == 0 else f"{i}" * 700) for i in range(300)]
    got = warc.round_trip(pages(spark, rows)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_archives_and_selected_reads(spark):
    ws = Workspace(spark, "warc-test")
    index = ws.save(warc.write_archives(pages(spark, ROWS), ws.path("archives")), "index")
    parts = {r["archive"]: open(r["archive"].removeprefix("file://"), "rb").read() for r in index.collect()}
    assert all(gzip.decompress(data).startswith(b"WARC/1.1\r\n") for data in parts.values())
    chosen = index.filter("payload_bytes > 100 and record_type = 'response'")
    got = {r["page_id"]: r for r in warc.read_records(chosen).collect()}
    assert bytes(got[-8]["payload"]) == b"x" * 200_000 and bytes(got[7]["payload"]) == b"a\r\n\r\nb" * 300
    assert warc.read_records(index.limit(0)).count() == 0
    one = index.filter("page_id = 2").select("*", F.lit(1).alias("more"))
    assert warc.read_records(one).first()["url"] == "http://a/%202%0D%0AX:%20y"


def test_empty(spark):
    assert warc.round_trip(pages(spark, ROWS).limit(0)).count() == 0


def test_ranges():
    assert warc.coalesce_ranges([(0, 10), (10, 5), (40, 5), (1000, 5)], most=100, gap=30) == [(0, 45, 3), (1000, 1005, 1)]
    assert warc.coalesce_ranges([(0, 80), (80, 80)], most=100, gap=30) == [(0, 80, 1), (80, 160, 1)]
    assert warc.coalesce_ranges([(0, 500), (0, 500)], most=600) == [(0, 500, 2)] and warc.coalesce_ranges([]) == []
