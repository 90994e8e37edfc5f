"""WARC archives with revisit records.

Pages with equal payloads are stored once: the page with the largest id is a response record,
the others become revisit records that refer to it.  Only headers (id, length, digest) are
shuffled by digest; the payloads meet the decision by page.  Record text is made and written
by Spark's own text writer, so archives go to any file system and a lost task is written
again; reading cuts files at the Content-Length of each record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Smaller payloads are always stored: a revisit record would save nothing.
LEAST_BYTES = 1000
#: Records in one archive file.
RECORDS = 5000

CRLF = "\r\n"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}{CRLF}"

HEADER = pa.schema(
    [("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("digest", pa.string())]
    + [("refers_to_id", pa.string()), ("url", pa.string()), ("payload", pa.binary())]
)
HEADER_DDL = "page_id bigint, record_id string, record_type string, digest string, refers_to_id string, url string, payload binary"


def revisits(headers: DataFrame) -> DataFrame:
    """(page_id, digest, original): headers that repeat the payload of the page ``original``.

    Headers are (page_id, n, digest).  A page without an id never revisits, nor do several
    rows of the id that the others refer to.
    """
    large = headers.filter(F.col("n") >= LEAST_BYTES)
    shared = large.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("pages")).filter("pages > 1")
    again = large.join(shared, "digest").filter(F.col("page_id") < F.col("original"))
    return again.select("page_id", "digest", "original").distinct()


def _record_id(page: Column, digest: Column) -> Column:
    h = F.sha2(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("")), digest), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record for every row of ``pages`` below ``folder``, as gzip files of WARC/1.1 records.

    NULL html is an empty payload; a NULL url gives a record without a target.  All other
    columns are ignored.  ``date`` is the WARC-Date of the fresh headers.
    """
    plain = pages.select(
        F.col(key).cast("bigint").alias("page_id"),
        F.regexp_replace(F.col(url).cast("string"), "[\\r\\n]", "").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
    )
    n, digest = F.octet_length("html").cast("bigint"), F.sha1(F.col("html").cast("binary"))
    headers = plain.select("page_id", n.alias("n"), digest.alias("digest"))
    known = revisits(headers)
    both = plain.withColumns({"n": n, "digest": digest}).join(known, ["page_id", "digest"], "left")
    again = F.col("original").isNotNull()
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        F.when(again, F.lit(f"WARC-Type: revisit{CRLF}WARC-Profile: {PROFILE}{CRLF}")).otherwise(F.lit(f"WARC-Type: response{CRLF}")),
        _field("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page_id"), F.col("digest")), F.lit(">"))),
        F.when(again, _field("WARC-Refers-To", F.concat(F.lit("<"), _record_id(F.col("original"), F.col("digest")), F.lit(">")))).otherwise(""),
        F.coalesce(_field("WARC-Target-URI", F.col("url")), F.lit("")),
        F.coalesce(_field("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _field("Content-Length", (F.when(again, 0).otherwise(F.col("n")) + len(HTTP)).cast("string")),
        F.lit(CRLF + HTTP),
        F.when(again, "").otherwise(F.col("html")),
    )
    out = both.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip")
    out.option("maxRecordsPerFile", RECORDS).text(folder)


def parse(raw: bytes) -> Iterator[dict]:
    """Records of one archive: header fields by lower-case name, and ``block``."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode("utf-8").split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        size = int(fields["content-length"])
        block = raw[end + 4 : end + 4 + size]
        at = end + 4 + size
        if len(block) != size or raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"truncated WARC record that ends at byte {at}")
        at += 4
        yield fields | {"block": block}


def _unpack(raw: bytes) -> bytes:
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:  # one or many members
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw) + member.flush())
        raw = member.unused_data
    return b"".join(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), HEADER)], schema=HEADER)

    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for r in parse(_unpack(content.as_buffer().to_pybytes())):
                payload = r["block"].partition(b"\r\n\r\n")[2] if r["warc-type"] == "response" else None
                page = r.get("x-page-id")
                rows.append(
                    (
                        int(page) if page is not None else None,
                        r["warc-record-id"].strip("<>"),
                        r["warc-type"],
                        r["warc-payload-digest"].removeprefix("sha1:"),
                        r["warc-refers-to"].strip("<>") if "warc-refers-to" in r else None,
                        r.get("warc-target-uri"),
                        payload,
                    )
                )
                size += len(payload or b"")
                if size > 8 << 20:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record below ``folder``: header fields and the payload, NULL for a revisit."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(_read, HEADER_DDL)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record.

    Lengths and digests are taken from the payloads that the archive holds; a revisit gets
    those of the response it refers to, found by digest and record id.  A revisit whose
    response is missing keeps its row with NULL length and ``refers_to``.
    """
    headers = stored(
        records.select(
            "page_id",
            "record_id",
            "record_type",
            "digest",
            "refers_to_id",
            F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            F.sha1("payload").alias("payload_digest"),
        ),
        "warc-headers",
    )
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses = headers.filter("record_type <> 'revisit'")
    originals = responses.groupBy(F.col("payload_digest").alias("digest"), F.col("record_id").alias("refers_to_id")).agg(
        F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes")
    )
    again = headers.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(originals, ["digest", "refers_to_id"], "left")
    again = again.withColumnRenamed("digest", "payload_digest").select(*shown, "refers_to")
    return responses.select(*shown, F.lit(None).cast("bigint").alias("refers_to")).unionByName(again)
