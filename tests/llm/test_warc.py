import base64
import hashlib
import os

import pytest

from plumbline.llm import warc
from plumbline.llm.session import shared_path

BIG = "é<p>\r\n\r\nWARC/1.1\r\n" * 30000
ROWS = [
    (5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (1, "http://c/ \n x", None), (2, "u", ""), (7, "u", BIG), (8, "v", BIG),
    (None, "http://n/", "same"), (None, None, "alone"), (3, "http://b/", "same"), (11, "u", "0\r\n\r\n"), (12, "x" * 3000, "WARC/1.1\r\n\r\n"),
]


def brute(rows, least):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= least:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        other = first.get(b) if i is not None and first.get(b) != i else None
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if other is not None else "response", other))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,segment", [(0, 1 << 16), (5, 100), (1 << 30, 1 << 20)])
def test_round_trip(spark, least, segment):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, digest string, payload int").repartition(3)
    path = shared_path(spark, "w")
    warc.write_archives(df, path, least, segment)
    got = warc.read_archives(spark, path).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(ROWS, least)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"}
    assert texts[7] == BIG and texts[1] == ""


def test_empty_table(spark):
    path = shared_path(spark, "w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_chunks():
    for data in (b"", b"x", b"\r\n" * 9000, os.urandom(20000)):
        assert warc.dechunked(warc.chunked(data)) == data
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for torn in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"zz\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(torn)


@pytest.mark.parametrize("damage", ["lost", "twice", "total"])
def test_broken_segments_are_errors(spark, damage):
    records = warc.records(1, "u", b"x" * 1000, None, "r", 200)
    assert len(records) > 3
    if damage == "lost":
        del records[2]
    elif damage == "twice":
        records.append(records[2])
    else:
        records[-1] = records[-1].replace(b"Total-Length: 1", b"Total-Length: 2")
    path = shared_path(spark, "w")
    spark.createDataFrame([(r.decode(),) for r in records], "value string").coalesce(2).write.option("lineSep", warc.SEPARATOR).text(path)
    with pytest.raises(Exception, match="segments|bytes, not"):
        warc.read_archives(spark, path).collect()


def test_torn_archive():
    record = warc.records(1, "u", b"abc", None, "r")[0] + b"\r\n\r\n"
    assert len(list(warc.parse(record * 2))) == 2
    for torn in (record[:-1], record[:-5], record + b"x", b"\n" + record):
        with pytest.raises(ValueError):
            list(warc.parse(torn))
