"""Write web captures as WARC archives and assemble transactions from archives.

A capture is three records: the request, the response (or a revisit, if an earlier
page has the same payload) and metadata. Response and metadata name the request in
``WARC-Concurrent-To``. Archives are written by Spark's own text writer: a record is one
value, and the writer's separator is the two line ends that close a WARC record. So
files are committed like any other output, on any file system, and a task that runs
again replaces its file.

Reading goes record by record through ``Content-Length``; one record at a time is held.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm.common import kept

END = "\r\n\r\n"
LINE = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in one archive, before compression: an archive is read as one row. A longer record has its own.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20

RECORD_SCHEMA = pa.schema(
    [
        ("file", pa.string()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("concurrent_to", pa.string()),
        ("refers_to", pa.string()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("content_type", pa.string()),
        ("http_head", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("stated_digest", pa.string()),
        ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)
RECORD_DDL = (
    "file string, record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "date string, content_type string, http_head string, payload_bytes bigint, payload_digest string, "
    "stated_digest string, payload binary, error string"
)


# --- writing --------------------------------------------------------------------------------


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits are twenty bits, four characters."""
    digits = F.sha1(data.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def urn(*parts: Column) -> Column:
    """A record id fixed by the parts."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    piece = lambda at, n: F.substring(h, at, n)
    return F.concat(
        F.lit("<urn:uuid:"), F.concat_ws("-", piece(1, 8), piece(9, 4), piece(13, 4), piece(17, 4), piece(21, 12)), F.lit(">")
    )


def header_value(value: Column) -> Column:
    """Control characters and spaces of a header's value percent-encoded."""
    out = value
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the line ends that close it; headers of null value are left out."""
    lines = [F.lit("WARC/1.1")] + [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(LINE, *lines, length), F.lit(END), block)


def with_originals(pages: DataFrame, page_id: str, html: str, least_bytes: int) -> DataFrame:
    """Columns ``w_payload``, ``w_digest`` and ``w_original``: the smallest id that has the same payload.

    Only payloads that occur more than once are joined; their table is written first, so its
    size is known when the join is planned, and a hot payload is a skewed join that Spark splits.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    digested = pages.withColumn("w_payload", payload).withColumn("w_digest", base32_sha1(F.col("w_payload")))
    repeated = kept(
        digested.filter(F.octet_length("w_payload") >= least_bytes)
        .groupBy(F.col("w_digest").alias("w_key"))
        .agg(F.min(page_id).alias("w_original"), F.count("*").alias("w_rows"))
        .filter("w_rows > 1")
        .select("w_key", "w_original"),
        "warc-repeated",
    )
    return digested.join(repeated, digested.w_digest == repeated.w_key, "left").drop("w_key")


def write_captures(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    least_bytes: int = 0,
) -> None:
    """Write a capture per page to gzip archives in the new folder ``path``.

    - Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the
      smallest id is the response, the others revisit it. Smaller ones are all responses.
    - Null html is an empty payload; a null url leaves out the target; a page with a null id
      is a response. Rows that repeat the response's id and payload are responses too.
    - Other columns are left out. An empty table gives a folder without archives.
    - Archives hold about ``ARCHIVE_BYTES`` before compression; a very long page is in an archive of its own.
    """
    rows = with_originals(pages.select(page_id, url, html), page_id, html, least_bytes)
    original = F.when(F.col(page_id) > F.col("w_original"), F.col("w_original"))
    rows = rows.select(
        F.col(page_id).alias("id"),
        header_value(F.col(url)).alias("uri"),
        "w_payload",
        "w_digest",
        original.alias("original"),
        F.monotonically_increasing_id().alias("row"),
    )
    request_id = urn(F.lit("request"), F.col("id"), F.col("uri"), F.col("row"))
    own_id = urn(F.lit("response"), F.col("id"), F.col("w_digest"))
    revisits = F.col("original").isNotNull()
    length = F.octet_length("w_payload").cast("string")
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), length, F.lit(END)
    )
    digest = F.concat(F.lit("sha1:"), F.col("w_digest"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("uri"))]
    request = record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", request_id), *common, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(F.col("uri"), F.lit("/")), F.lit(f" HTTP/1.1{END}")),
    )
    response = record(
        [
            ("WARC-Type", F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", F.when(revisits, urn(F.lit("revisit"), F.col("id"), F.col("row"))).otherwise(own_id)),
            ("WARC-Concurrent-To", request_id),
            *common,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(revisits, F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", F.when(revisits, urn(F.lit("response"), F.col("original"), F.col("w_digest")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisits, head).otherwise(F.concat(head, F.col("w_payload"))),
    )
    metadata = record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", urn(F.lit("metadata"), F.col("id"), F.col("row"))),
            ("WARC-Concurrent-To", request_id),
            *common,
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(LINE)),
    )
    archives = rows.select(F.explode(F.array(request, response, metadata)).alias("value")).mapInArrow(joined_records, "value string")
    archives.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def joined_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of one archive after another, each as one text."""
    held, size = [], 0

    def archive() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)], pa.binary()).cast(pa.string())], names=["value"])

    for batch in batches:
        for value in batch.column(0).cast(pa.binary()).to_pylist():
            if held and size + len(value) > ARCHIVE_BYTES:
                yield archive()
                held, size = [], 0
            held.append(value)
            size += len(value) + len(END)
    if held:
        yield archive()


# --- reading --------------------------------------------------------------------------------


def unpacked(data: bytes) -> Iterator[bytes]:
    """The archive's bytes in chunks; one gzip member for the file or one per record."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[k : k + CHUNK] for k in range(0, len(data), CHUNK))
        return
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            out = member.decompress(data, CHUNK)
            data = member.unconsumed_tail
            if out:
                yield out
            elif not member.eof and not data:
                return  # cut off
        data = member.unused_data


class Bytes:
    """Reads up to a mark or a length from chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.held += chunk
        return True

    def until(self, mark: bytes) -> bytes | None:
        at, seen = self.held.find(mark), 0
        while at < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
            at = self.held.find(mark, seen)
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes | None:
        while len(self.held) < n:
            if not self.more():
                return None
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def archive_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers by lower-case name, block, error) of every record; an error ends the archive."""
    source = Bytes(unpacked(data))
    while True:
        while not source.held and source.more():
            pass
        if not source.held:
            return
        head = source.until(b"\r\n\r\n")
        if head is None or not head.lstrip(b"\r\n").startswith(b"WARC/"):
            yield {}, b"", "no record where one should begin"
            return
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")[1:]
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        length = headers.get("content-length", "")
        block = source.take(int(length)) if length.isdigit() else None
        if block is None or source.take(4) != b"\r\n\r\n":
            yield headers, b"", "the record's length is not right"
            return
        yield headers, block, None


def as_row(file: str, headers: dict[str, str], block: bytes, error: str | None, keep: bool) -> dict:
    kind = headers.get("content-type", "")
    head, payload = None, block
    if kind.startswith("application/http"):
        first, mark, rest = block.partition(b"\r\n\r\n")
        head, payload = first.decode("utf-8", "replace"), rest if mark else b""
    return {
        "file": file,
        "record_id": headers.get("warc-record-id"),
        "record_type": headers.get("warc-type"),
        "concurrent_to": headers.get("warc-concurrent-to"),
        "refers_to": headers.get("warc-refers-to"),
        "target_uri": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"),
        "content_type": kind,
        "http_head": head,
        "payload_bytes": len(payload),
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "stated_digest": headers.get("warc-payload-digest"),
        "payload": payload if keep or headers.get("warc-type") == "metadata" else None,
        "error": error,
    }


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row per record of the archives in a folder.

    ``payload_digest`` is computed from the payload that was read, ``stated_digest`` is the
    record's own. ``payload=False`` leaves the bytes out (metadata keeps its fields).
    What can't be read gives a row with ``error``; the rest of that archive is left out.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for headers, block, error in archive_records(content.as_py()):
                    rows.append(as_row(file, headers, block, error, payload))
                    size += len(block) if payload else 200
                    if size > 8 * CHUNK or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(parse, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``response``, ``request``, ``metadata``, ``original``.

    Records belong to one capture if they name the same record in ``WARC-Concurrent-To`` or
    are that record. Every response and revisit is a capture; request or metadata that is
    missing is null, and the smallest record id stands for several of one kind.
    ``original`` is the response that a revisit refers to, without its payload but with the
    ``fields`` of its metadata.
    """
    records = kept(records.filter("error IS NULL"), "warc-records")
    of = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    whole = F.struct(*[c for c in records.columns if c not in ("file", "error")])

    def one(kind: str) -> DataFrame:
        rows = of.filter(F.col("record_type") == kind)
        return rows.groupBy("capture_id").agg(F.min_by(whole, "record_id").alias(kind))

    captures = of.filter(F.col("record_type").isin("response", "revisit")).select("capture_id", whole.alias("response"))
    captures = captures.join(one("request"), "capture_id", "left").join(one("metadata"), "capture_id", "left")
    small = [F.col(f"response.{c}").alias(c) for c in ("record_id", "target_uri", "payload_bytes", "payload_digest", "date")]
    originals = (
        captures.filter("response.record_type = 'response'")
        .select(F.struct(*small, F.col("metadata.payload").alias("fields")).alias("original"))
        .groupBy(F.col("original.record_id").alias("original_id"))
        .agg(F.min("original").alias("original"))
    )
    # Captures that refer to nothing stay out of the join: their null would be one hot key.
    refers = captures.filter("response.refers_to IS NOT NULL")
    revisits = refers.join(originals, F.col("response.refers_to") == F.col("original_id"), "left").drop("original_id")
    others = captures.filter("response.refers_to IS NULL")
    return others.unionByName(revisits, allowMissingColumns=True)


def page_ids(captures: DataFrame) -> DataFrame:
    """Captures with ``page_id`` and ``original_page_id`` from the fields of their metadata."""

    def number(fields: Column) -> Column:
        digits = F.regexp_extract(fields.cast("string"), r"page-id: (-?\d+)", 1)
        return F.when(digits != "", digits.cast("long"))

    return captures.withColumns(
        {"page_id": number(F.col("metadata.payload")), "original_page_id": number(F.col("original.fields"))}
    )
