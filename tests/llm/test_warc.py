import base64
import hashlib

import pytest
from .helpers import CLASHES

from lineloom.llm.warc import WarcError, chunked, dechunk, page_records, read_records, read_warc, reassemble, warc_round_trip, write_warc

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    least = {}
    for i, p in payloads:
        if i is not None:
            least[p] = min(least.get(p, i), i)
    out = []
    for i, p in payloads:
        first = least.get(p)
        revisit = first is not None and first != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


LONG = "<p>" + "long ünïcode text \r\n\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3000
ROWS = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>one</p>"),
    (3, None, None),
    (4, "http://a/4", ""),
    (5, "http://a/\r\nX-Bad: 1", LONG),
    (6, "http://a/6", LONG),
    (7, "", "WARC/1.0\r\n"),
    (8, "http://a/8", "\r\n\r\n\r\n\r\n"),
    (9, "http://a/9", "same"),
    (9, "http://a/9", "same"),
    (None, "http://a/n", "same"),
    (None, "http://a/m", "alone"),
    (-12, "http://a/neg", "same"),
    (10, "http://a/10", "x" * 40_000),
]


def test_round_trip(spark):
    assert got(warc_round_trip(spark.createDataFrame(ROWS, SCHEMA).repartition(4))) == expected(ROWS)


def test_more_columns_and_empty_tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS[:4], SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("first", *CLASHES)))
    assert got(warc_round_trip(df)) == expected(ROWS[:4])
    assert got(warc_round_trip(spark.createDataFrame([], SCHEMA))) == []


def test_pages_of_the_tables(spark, sf_dir):
    from lineloom.llm.queries import queries

    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert got(queries()["op1_warc"](spark, sf_dir)) == expected(rows)


def test_payloads_come_back_whole(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    write_warc(spark.createDataFrame(ROWS, SCHEMA), path, segment_bytes=1000, chunk_bytes=300)
    back = read_warc(spark, path).filter("type = 'response'").collect()
    whole = {e[0] for e in expected(ROWS) if e[3] == "response"}
    want = sorted((h or "").encode() for i, _, h in ROWS if i in whole and (i is not None or h == "alone"))
    assert sorted(bytes(r.payload) for r in back) == want
    assert max(r.n_segments for r in back) > 200


@pytest.mark.parametrize("size", [1, 7, 100])
def test_chunks(size):
    for body in (b"", b"a", b"\r\n0\r\n\r\n", bytes(range(256)) * 3):
        assert dechunk(chunked(body, size)) == body
    assert dechunk(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"


@pytest.mark.parametrize("framed", [b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\nabc\r\n", b"3\r\nabcX0\r\n\r\n"])
def test_broken_chunks(framed):
    with pytest.raises(WarcError):
        dechunk(framed)


def test_segments():
    assert reassemble([2, 1, 3], [None, None, 6], [b"cd", b"ab", b"ef"]) == [b"abcdef"]
    assert reassemble([2, 1, 1, 2], [4, None, None, 4], [b"cd", b"ab", b"ab", b"cd"]) == [b"abcd"] * 2
    for numbers, totals, blocks in (([1, 3], [None, 4], [b"ab", b"cd"]), ([1, 2], [None, 5], [b"ab", b"cd"]), ([2, 3], [None, 4], [b"ab", b"cd"]), ([1, 2], [None, None], [b"ab", b"cd"])):
        with pytest.raises(WarcError):
            reassemble(numbers, totals, blocks)


def test_records_say_what_they_hold():
    r = list(page_records(3, 7, "http://x", "y" * 90, None, None, segment_bytes=100, chunk_bytes=40))
    assert b"WARC-Segment-Number: 1" in r[0] and b"WARC-Type: continuation" in r[-1] and b"WARC-Segment-Total-Length" in r[-1]
    assert all(b"WARC-Segment-Origin-ID: <urn:lineloom:page:7:" in x for x in r[1:])


def test_identifiers_are_unique(spark, tmp_path):
    """Repeated long pages, with and without an id: each record has an identifier of its own, and segments meet by page row alone."""
    long = "é" * 40_000
    rows = [(5, "u", long)] * 3 + [(None, "u", long + "x")] * 3 + [(6, "u", long), (6, "u", "short"), (6, "u", "short")]
    path = f"file://{tmp_path}/warc"
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), path)
    ids = [r.record_id for r in read_records(spark, path).collect()]
    assert len(ids) == len(set(ids)) > len(rows)
    back = read_warc(spark, path)
    assert back.count() == len(rows) and back.filter("type = 'revisit'").count() == 1
    assert back.filter("type = 'revisit'").first().refers_to in {r.record_id for r in back.filter("type = 'response'").collect()}
    assert sorted(len(r.payload) for r in back.filter("n_segments > 1").collect()) == [80_000] * 3 + [80_001] * 3
