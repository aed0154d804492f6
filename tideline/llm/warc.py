"""WARC archives: segmented, chunk-framed records written by Spark, read back and put together.

Writing.  Payloads are compared by length and SHA-1; of equal ones the record with the largest key
is the response and the others are revisits that store no payload.  A response is an HTTP message
in chunked transfer framing; a long one is cut into an origin record and continuation records.
Records are written by Spark's text writer, whose line separator is the end of a record, so files
are committed by Spark and survive lost executors.

Reading.  Every file is parsed by the lengths its records state.  Continuation records are grouped
by the identifier of their origin, ordered by segment number, checked for gaps and against the
stated total length, and then the transfer framing is decoded.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import fresh_path, stored

#: Payload bytes of a transfer chunk, and block bytes of a record before it is segmented.
CHUNK, SEGMENT = 8 << 10, 48 << 10
#: Records per file: with ``SEGMENT`` it bounds what a reading task holds.
RECORDS = 1000
END = "\r\n\r\n"
#: RFC 4648; fixed values.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = (
    "record_id string, record_type string, uri string, key string, date string, digest string, segment int,"
    " origin string, total long, block binary"
)


def base32_sha1(value: Column) -> Column:
    """Base-32 SHA-1 of bytes: eight times five hex digits give four base-32 digits."""
    digits = F.sha1(value)
    parts = [
        F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def classify(pages: DataFrame, key: str, payload: str, carry: list[str]) -> DataFrame:
    """Rows with ``__payload`` bytes, ``digest``, ``bytes``, ``record_type`` and ``refers_to``.

    Null payloads are empty ones.  Null keys come before all others; of rows with equal payload
    that share the largest key each is a response.
    """
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = pages.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{key}`").cast("string").alias("__key"), F.col(f"`{key}`").alias("__order"), body.alias("__payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("__payload"))).withColumn("bytes", F.octet_length("__payload").cast("long"))
    last = rows.groupBy("digest", "bytes").agg(F.max("__order").alias("__last"))
    last = last.select(F.col("digest").alias("__d"), F.col("bytes").alias("__b"), "__last")
    joined = rows.join(stored(last, "responses"), (F.col("digest") == F.col("__d")) & (F.col("bytes") == F.col("__b")))
    revisit = ~F.col("__order").eqNullSafe(F.col("__last"))
    return joined.select(
        *[F.col(f"`{c}`") for c in carry], "__key", "__payload", "digest", "bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("__last").cast("string")).alias("refers_to"),
    )


def _chunked(body: bytes) -> bytes:
    parts = [body[i : i + CHUNK] for i in range(0, len(body), CHUNK)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """Payload of chunked transfer framing; raises where the framing does not add up."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken transfer chunk")
        out.append(framed[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    named = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"WARC/1.1\r\n{named}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _field(value) -> str | None:
    """Text of a header field: line ends and percent signs are percent-encoded."""
    if value is None or value != value:
        return None
    return re.sub(r"[%\r\n]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _records(row_id: str, uri, key, date, payload: bytes, digest: str, size: int, kind: str, refers_to) -> Iterator[bytes]:
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{row_id}>"), ("WARC-Date", date), ("WARC-Target-URI", _field(uri)),
        ("X-Key", _field(key)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if kind == "revisit":
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Key", _field(refers_to)),
        ]
        yield _record(head, b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked(payload)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    if len(parts) == 1:
        yield _record(head, block)
        return
    yield _record([*head, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        own = [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{row_id}-{k}>"), ("WARC-Date", date),
            ("WARC-Segment-Origin-ID", f"<{row_id}>"), ("WARC-Segment-Number", k),
            ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None),
        ]
        yield _record(own, part)


def write(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html",
          date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per row below ``path``; null payloads are empty, null uris leave out the field."""
    # A name per row, not per key: repeated rows must not mix their segments.  It is fixed once
    # written, since Spark commits one attempt of each file.
    rows = classify(pages, key, payload, [uri]).withColumn(
        "__id", F.concat(F.lit("urn:row:"), F.monotonically_increasing_id().cast("string"))
    )

    def to_records(batches):
        for batch in batches:
            for small in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                columns = [small.column(c).to_pylist() for c in ("__id", uri, "__key", "__payload", "digest", "bytes", "record_type", "refers_to")]
                made = [
                    record
                    for name, u, k, body, digest, size, kind, refers in zip(*columns, strict=True)
                    for record in _records(name, u, k, date, body, digest, size, kind, refers)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    (
        rows.mapInArrow(to_records, "value binary")
        .select(F.col("value").cast("string"))  # bytes as they are; the writer does not look inside
        .write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", RECORDS).text(path)
    )


def parse(content: bytes) -> Iterator[dict]:
    """Records of one archive by the lengths they state."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start = end + 4
        at = start + int(fields["content-length"])
        yield fields, content[start:at]
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record before byte {at} is longer or shorter than it states")
        at += 4


def _plain(value: str | None) -> str | None:
    return None if value is None else re.sub(r"%(25|0D|0A)", lambda m: chr(int(m[1], 16)), value)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``, blocks as written."""
    names = ["record_id", "record_type", "uri", "key", "date", "digest", "segment", "origin", "total", "refers", "block"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for fields, block in parse(batch.column("content")[k].as_py()):
                    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                    rows.append((
                        fields["warc-record-id"], fields["warc-type"], _plain(fields.get("warc-target-uri")), _plain(fields.get("x-key")),
                        fields.get("warc-date"), fields.get("warc-payload-digest", "").removeprefix("sha1:"), number and int(number),
                        fields.get("warc-segment-origin-id"), total and int(total), _plain(fields.get("x-refers-to-key")), block,
                    ))
                    held += len(block)
                    if held > 4 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    schema = RECORD.replace(", block binary", ", refers string, block binary")
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"segment": pa.int32(), "total": pa.int64(), "block": pa.binary()}
    columns = [pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def reassemble(records: DataFrame) -> DataFrame:
    """Responses and revisits with whole blocks; raises when a segment is missing or lengths differ.

    Only segmented records are shuffled, each origin's segments to one row, as large as its payload.
    """
    whole = records.where(F.col("segment").isNull())
    parts = records.where(F.col("segment").isNotNull()).withColumn("__of", F.coalesce("origin", "record_id"))
    head = ["record_id", "record_type", "uri", "key", "date", "digest", "refers"]
    first = [F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in head]
    joined = parts.groupBy("__of").agg(
        *first, F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s")
    )
    block = F.aggregate("s", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["block"]))
    gaps = F.transform("s", lambda x: x["segment"]) != F.sequence(F.lit(1), F.size("s"))
    joined = joined.withColumn("block", block)
    broken = gaps | ~F.octet_length("block").cast("long").eqNullSafe(F.col("total"))
    checked = F.when(broken, F.raise_error(F.concat(F.lit("segments of "), F.col("__of"), F.lit(" do not add up")))).otherwise(F.col("block"))
    return whole.select(*head, "block").unionByName(joined.select(*head, checked.alias("block")))


def payloads(records: DataFrame) -> DataFrame:
    """Add ``payload``: the decoded body of each response, null for revisits."""

    @F.pandas_udf("binary")
    def body(blocks: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for block, kind in zip(blocks, kinds, strict=True):
            head, _, rest = block.partition(b"\r\n\r\n")
            framed = b"transfer-encoding: chunked" in head.lower()
            out.append(None if kind == "revisit" else unchunked(rest) if framed else rest)
        return pd.Series(out, dtype=object)

    return records.withColumn("payload", body("block", "record_type"))


def resolve(records: DataFrame) -> DataFrame:
    """``key, payload_bytes, payload_digest, record_type, refers_to`` of every record.

    The digest of a response is worked out from its decoded payload and must be the stated one; a
    revisit takes length and digest from the response it refers to.
    """
    found = payloads(reassemble(records))
    digest = base32_sha1(F.col("payload"))
    good = F.when(F.col("record_type") == "revisit", F.col("digest")).when(digest == F.col("digest"), digest)
    found = stored(
        found.select(
            "key", "record_type", "refers", F.octet_length("payload").cast("long").alias("bytes"),
            F.coalesce(good, F.raise_error(F.concat(F.lit("digest of "), F.coalesce("key", F.lit("?"))))).alias("digest"),
        ),
        "records",
    )
    responses = found.where(F.col("record_type") == "response")
    known = responses.groupBy(F.col("digest").alias("__d"), F.col("key").alias("__k")).agg(F.max("bytes").alias("__bytes"))
    same = (F.col("digest") == F.col("__d")) & F.col("refers").eqNullSafe(F.col("__k"))
    revisits = found.where(F.col("record_type") == "revisit").join(known, same, "left")
    columns = ["key", F.col("digest").alias("payload_digest"), "record_type", F.col("refers").alias("refers_to")]
    return responses.select(*columns, F.col("bytes").alias("payload_bytes")).unionByName(
        revisits.select(*columns, F.col("__bytes").alias("payload_bytes"))
    )


def round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Write the rows as archives in the shared folder, read them back and resolve them."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, **names)
    return resolve(read_records(pages.sparkSession, path))
