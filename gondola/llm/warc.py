"""WARC archives with an index: write, then read selected records by coalesced byte ranges.

Every record is a gzip member of its own, so that (file, offset, length) is enough
to read it.  Writing returns the index; the index, not a directory listing, says
what exists.  Reading sorts the selected index rows by file and offset and joins
neighbouring ranges into one read.

A payload that occurs more than once is stored once, by the smallest page id
(``response``); the other records (``revisit``) name that record and the digest.
Payloads shorter than `least_bytes` are always stored.

Defined results: a null payload is empty; a null url leaves out WARC-Target-URI,
and control characters in a url are percent-encoded in the header (the index keeps
the url as it is).  Rows with the response's page id and payload are all responses;
rows with a null page id are revisits where another row has the payload and an id,
else responses.  An empty table gives no rows and no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm import shared
from gondola.llm.files import Appender, ranged_reads, read_tasks

INDEX = "page_id bigint, url string, payload_digest string, record_type string, file string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, payload_digest string, refers_to bigint, payload binary"


@dataclass(frozen=True)
class WarcParams:
    least_bytes: int = 0  #: smaller payloads are not deduplicated
    file_bytes: int = 64 << 20  #: an archive ends after so many bytes
    gap: int = 64 << 10  #: ranges so close are read at once
    read_bytes: int = 4 << 20  #: most bytes of one read
    task_bytes: int = 16 << 20  #: archive bytes that one reading task takes
    level: int = 5
    date: str = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:gondola:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    return None if urn is None or urn.endswith(":null>") else int(urn[1:-1].rpartition(":")[2])


def record(page_id, url, payload: bytes, own: str, refers_to, params: WarcParams, revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {params.date}", f"WARC-Payload-Digest: sha1:{own}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, params: WarcParams = WarcParams(),
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row of pages below folder; returns the index, stored."""
    shared.bounded_batches(pages.sparkSession)
    body = F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("body"))
    sha = F.sha1("body")
    # written first: its size is then known, and a small one is broadcast, so that payloads stay where they are
    copies = shared.stored(
        rows.where(F.octet_length("body") >= params.least_bytes).groupBy(sha.alias("sha")).agg(
            F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "warc-copies")
    dealt = rows.withColumn("sha", sha).join(copies, "sha", "left").select(
        "page_id", "url", "body", "sha",
        F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)).alias("revisit"), "first")

    def write(batches):
        out = Appender(folder, ".warc.gz", params.file_bytes)
        for batch in batches:
            found = []
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "body", "sha", "revisit", "first"))):
                page_id, url, payload, sha_hex, revisit, first = row
                own = base64.b32encode(bytes.fromhex(sha_hex)).decode()
                gz = zlib.compressobj(params.level, zlib.DEFLATED, 31)
                data = gz.compress(record(page_id, url, payload, own, first, params, revisit)) + gz.flush()
                file, at = out.add(data)
                found.append((page_id, url, own, "revisit" if revisit else "response", file, at, len(data)))
            columns = list(zip(*found)) or [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            names = ["page_id", "url", "payload_digest", "record_type", "file", "offset", "length"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        out.close()

    return shared.stored(dealt.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """The records that the rows of index name, read back from the archives (RECORD)."""
    shared.bounded_batches(index.sparkSession)
    picked = read_tasks(index.select("file", "offset", "length"), params.task_bytes)

    def read(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch[c].to_pylist() for c in ("file", "offset", "length")))

        found, size = [], 0

        def out():
            columns = list(zip(*found))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload"])

        for _, data in ranged_reads(rows(), params.gap, params.read_bytes):
            head, payload = parse(zlib.decompress(data, 31))
            kind = head["WARC-Type"]
            own = head["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and digest(payload) != own:
                raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
            found.append((_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, own,
                          _page(head.get("WARC-Refers-To")), payload if kind == "response" else None))
            size += len(payload)
            if size > shared.BATCH_BYTES or len(found) >= shared.BATCH_ROWS:
                yield out()
                found, size = [], 0
        if found:
            yield out()

    return picked.mapInArrow(read, RECORD)


def page_report(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes and payload_digest of the full payload, record_type, refers_to."""
    slim = shared.stored(records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"), "warc-records")
    full = slim.where("record_type = 'response'")
    # one row a digest: what a revisit stands for is found by the digest it names
    sizes = full.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = slim.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, "payload_digest", "left")
    return full.unionByName(again.select(full.columns))
