"""Archives: written, read, put together."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tideline.llm import warc
from tideline.llm.common import fresh_path

ROWS = [
    (1, "http://a/", "<p>x</p>", "old"), (2, "http://b/\r\nX: 1", "<p>x</p>", "old"), (3, None, None, "old"), (4, "http://d/", "", "old"),
    (5, "http://e/%0A", "é\r\n\r\nWARC/1.1\r\n" * 9000, "old"), (6, "u", "0\r\n\r\n", "old"), (7, "u", "z" * 49_000, "old"),
    (8, "u", "z" * 49_000, "old"), (9, "u", "k" * 200_000, "old"), (9, "u", "k" * 200_000, "old"), (None, "u", "alone", "old"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string")
    got = sorted(map(str, warc.round_trip(df).select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    want = []
    for key, _, html, _ in ROWS:
        last = max((k for k, _, h, _ in ROWS if (h or "") == (html or "") and k is not None), default=None)
        again = key != last
        want.append((None if key is None else str(key), len((html or "").encode()), digest(html), "revisit" if again else "response", str(last) if again else None))
    fields = ("key", "payload_bytes", "payload_digest", "record_type", "refers_to")
    shown = ["Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(fields, w, strict=True)) + ")" for w in want]
    assert got == sorted(shown)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_payloads_and_fields_survive(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string")
    path = fresh_path(spark, "warc-test")
    warc.write(df, path)
    records = warc.read_records(spark, path)
    assert records.where("record_type = 'continuation'").count() > 5
    rows = {r.key: r for r in warc.payloads(warc.reassemble(records)).collect() if r.record_type == "response"}
    for key, url, html, _ in ROWS:
        if str(key) in rows:
            assert bytes(rows[str(key)].payload).decode() == (html or "") and rows[str(key)].uri == url


def test_missing_segment_is_an_error(spark):
    df = spark.createDataFrame([(1, "u", "k" * 200_000)], "page_id long, url string, html string")
    path = fresh_path(spark, "warc-test")
    warc.write(df, path)
    records = warc.read_records(spark, path)
    with pytest.raises(Exception, match="do not add up"):
        warc.reassemble(records.where(F.coalesce("segment", F.lit(0)) != 2)).select("block").collect()


def test_broken_framing_is_an_error():
    assert warc.unchunked(b"3\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
