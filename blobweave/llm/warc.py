"""WARC archives with revisit records: writing, reading back, resolving.

Writing takes two passes.  The first shuffles headers only: payload digest, page
id and length.  Of the pages with equal payloads the one with the smallest id
becomes the response and the others revisit it.  The second writes one record a
page, with fresh headers; a revisit carries no payload.  Spark's text writer puts
the records into files, as they end with the blank lines that it takes as line
separator, so any store that Spark writes to will do.

A row of the text that is written is a file: as many records as ``file_bytes`` allows,
or one larger record.  Spark's writer compresses a file as one gzip member.

Reading takes whole files, which that bounds, and cuts records by their
Content-Length, so a payload may hold anything; records are passed on bit by bit.  Revisits are then joined
to their responses by digest; popular payloads do not meet in one task.

Defined results: null html is an empty payload; a null url is written as
about:blank and white space in urls is percent-encoded; pages with a null id come
after all others and are read back as null; rows that repeat both id and payload
are the same page and get the same record type.  Payloads below ``least_bytes``
are all responses.  Archives hold no row for an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, look_up, slices_of, staged

LEAST_BYTES = 0
#: Bytes of records in a file, before compression; and of payloads that a reader holds.
FILE_BYTES, HELD_BYTES = 64_000_000, 8_000_000
END = "\r\n\r\n"
#: Fixed values of the WARC 1.1 standard.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to_digest string, payload string"


def base32_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, digest: str, page_id: int | None) -> str:
    h = hashlib.sha256(f"{kind} {digest} {page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, origin: tuple[int | None, str | None] | None, date: str) -> bytes:
    """A record without its closing blank lines; ``origin``: id and url of the page that it revisits."""
    digest = base32_digest(payload)
    target = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "about:blank").encode()).decode()
    kind = "response" if origin is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}".encode()
    block = http + payload if origin is None else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, digest, page_id)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_digest(block)}")]
    if origin is not None:
        first = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (origin[1] or "about:blank").encode()).decode()
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", digest, origin[0])), ("WARC-Refers-To-Target-URI", first), ("WARC-Refers-To-Date", date)]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = {}
        for line in data[at:end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        start = end + 4
        stop = start + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has no end")
        yield headers, data[start:stop]
        at = stop + 4


def write_warc(pages: DataFrame, path: str, *, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, date: str | None = None, compression: str = "gzip") -> None:
    """Write ``pages`` (page_id, url, html) as deduplicated archives to the folder ``path``."""
    stamp = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("_digest"), F.octet_length(html).alias("_bytes"))
    headers = staged(keyed.select("page_id", "url", "_digest", "_bytes"), "warc-headers")
    # the smallest (no id, id, url) of each payload; nulls last
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url")))
    origins = headers.where(F.col("_bytes") >= least_bytes).groupBy("_digest").agg(first.alias("_first"), F.count("*").alias("_n"))
    origins = staged(origins.where("_n > 1"), "warc-origins")
    found = look_up(keyed, origins, "_digest", "_n")
    own = F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    is_first = F.col("_first").isNull() | own | (F.col("_bytes") < least_bytes)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.string())], ["value"])

        for batch in slices_of(batches, HELD_BYTES, "html"):
            rows = zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "first", "origin_id", "origin_url")), strict=True)
            for i, url, text, first, o, u in rows:
                record = make_record(i, url, text.encode(), None if first else (o, u), stamp)
                if held and size + len(record) > file_bytes:
                    yield file()
                    held, size = [], 0
                held.append(record.decode())
                size += len(record)
        if held:
            yield file()

    rows = found.select("page_id", "url", "html", is_first.alias("first"), F.col("_first.page_id").alias("origin_id"), F.col("_first.url").alias("origin_url"))
    out = rows.mapInArrow(make, "value string").write.option("lineSep", END).option("maxRecordsPerFile", 1)
    out.option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of all archives in ``path``, columns as in RECORD; without ``payloads``, payload is null.

    The digest and length of a response are computed from its payload and held
    against its header.  A revisit has the digest that it names and no length.
    """
    import gzip

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to_digest", pa.string()), ("payload", pa.string())])
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for content in batch["content"]:
                data = content.as_py()
                rows, size = [], 0
                for h, block in parse_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
                    body = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if body is not None and base32_digest(body) != digest:
                        raise ValueError(f"{h['warc-record-id']}: the payload is not what its digest says")
                    page = int(h["page-id"]) if "page-id" in h else None
                    rows.append((page, h["warc-target-uri"], kind, digest, None if body is None else len(body), digest if kind == "revisit" else None, body.decode() if payloads and body is not None else None))
                    size += len(block)
                    if size > HELD_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, RECORD)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every record with ``payload_bytes`` filled in and ``refers_to``, the page id of the response that a revisit means."""
    slim = staged(records.select("page_id", "record_type", "payload_digest", "payload_bytes"), "warc-records")
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "payload_bytes"))
    responses = slim.where("record_type = 'response'").groupBy("payload_digest").agg(least.alias("_r"))
    asked = slim.where("record_type = 'revisit'").groupBy("payload_digest").agg(F.count("*").alias("_n"))
    table = staged(asked.join(responses, "payload_digest"), "warc-responses")
    revisits = look_up(slim.where("record_type = 'revisit'"), table, "payload_digest", "_n")
    whole = revisits.select("page_id", F.col("_r.payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("_r.page_id").alias("refers_to"))
    own = slim.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(whole)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolve_revisits(read_warc(spark, path, payloads=False))
