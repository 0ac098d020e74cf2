"""WARC archives as a chunked record table.

An archive is a table of (record, chunk, data, digest): a record's bytes in chunks of bounded
size, each with the SHA-256 of the payload up to its end.  Neither writer nor reader holds the
bytes of a whole record (only its compressed form), and each chunk's digest is checked as it is
read, so damage is found in the chunk where it lies.  Concatenating ``data`` by record and
chunk gives a WARC 1.1 file (``export``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK = 1 << 16
CHUNKS = "record long, chunk int, data binary, payload_digest string"
DATE = "2000-01-01T00:00:00Z"  # the pages have no capture date


def _pressed(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """page_id, url and body: the payload in compressed frames, before it is dealt out."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            bodies = []
            for html in batch.column(2):
                view = memoryview(html.as_buffer() if html.is_valid else b"")
                bodies.append(b"".join(tool.compress(view[a : a + 64 * size]) for a in range(0, len(view), 64 * size)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], names=["page_id", "url", "body"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(press, "page_id long, url string, body binary")


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, body (compressed payload, null for revisits), digest, size, refers_to: of pages
    with equal payloads of ``least`` bytes or more, that with the smallest page_id is written and
    the others (refers_to) revisit it.

    Null html is an empty payload.  Repeated rows of the smallest page_id are all written; rows
    without page_id are written, and are referred to only where no copy has an id.  Columns of
    other names are ignored; an empty table gives an empty archive."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    copies = keyed.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 AND _first IS NOT NULL").select("digest", "_first")
    later = keyed.join(copies, "digest").where(~F.col("page_id").eqNullSafe(F.col("_first"))).select("page_id", "digest", "_first").distinct()
    later = common.cut(later, "revisits")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            digests, sizes = [], []
            for body in batch.column(2):
                sha, n = hashlib.sha256(), 0
                for part in payload(tool, body.as_buffer(), CHUNK):
                    sha.update(part)
                    n += len(part)
                digests.append(sha.hexdigest())
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "body", "digest", "size"])

    bodies = _pressed(pages).mapInArrow(measure, "page_id long, url string, body binary, digest string, size long")
    joined = bodies.join(later, bodies["page_id"].eqNullSafe(later["page_id"]) & (bodies["digest"] == later["digest"]), "left")
    return joined.select(bodies["page_id"], "url", F.when(F.col("_first").isNull(), F.col("body")).alias("body"), bodies["digest"], "size", F.col("_first").alias("refers_to"))


def payload(tool: zstandard.ZstdDecompressor, body: bytes, size: int) -> Iterator[bytes]:
    """The payload in pieces of ``size`` bytes, the last one shorter."""
    with tool.stream_reader(body, read_across_frames=True) as reader:
        held = b""
        while part := reader.read(size - len(held)):
            held += part
            if len(held) == size:
                yield held
                held = b""
        if held:
            yield held


def head(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """The head of a record: WARC fields and, for both types, the HTTP head."""
    name = lambda n: "<urn:page:%s>" % ("" if n is None else n)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    length = len(http) + (size if refers_to is None else 0)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to)), ("WARC-Payload-Length", str(size))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(length))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + http).encode("utf-8", "surrogatepass")


def write(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of ``records`` (as from ``plan_records``), each chunk handed on as it is made."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.string()))], names=["record", "chunk", "data", "payload_digest"])
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, digest, n, refers, record = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4, 5, 6))
                running, k = hashlib.sha256(), 0
                rows.append((record, 0, head(page, url, digest, n, refers), running.hexdigest()))
                for part in payload(tool, batch.column(2)[i].as_buffer(), size) if refers is None else ():
                    running.update(part)
                    k += 1
                    rows.append((record, k, part, running.hexdigest()))
                    held += len(part)
                    if held > 1 << 22:
                        yield pack(rows)
                        rows, held = [], 0
                rows.append((record, k + 1, b"\r\n\r\n", running.hexdigest()))
                if len(rows) > 1000:
                    yield pack(rows)
                    rows, held = [], 0
        if rows:
            yield pack(rows)

    return records.select("page_id", "url", "body", "digest", "size", "refers_to", F.monotonically_increasing_id().alias("record")).mapInArrow(chunks, CHUNKS)


class Reader:
    """Takes the bytes of one record piece by piece; ``fields`` are its WARC fields, ``size`` and
    ``digest`` those of the payload seen."""

    def __init__(self) -> None:
        self.pending, self.fields, self.body, self.size, self.left = b"", None, None, 0, 0
        self.sha = hashlib.sha256()

    def feed(self, data: bytes) -> bytes:
        """Take ``data``; returns what lies behind the record's end."""
        if self.body is None:
            self.pending += data
            while self.body is None:
                block, found, rest = self.pending.partition(b"\r\n\r\n")
                if not found:
                    return b""
                lines = block.decode("utf-8", "surrogatepass").split("\r\n")
                if self.fields is None:
                    if not lines[0].startswith("WARC/"):
                        raise ValueError("not a WARC record")
                    self.fields = dict(line.split(": ", 1) for line in lines[1:])
                    self.pending = rest
                else:
                    self.left = int(self.fields["Content-Length"]) - len(block) - 4
                    self.body, self.pending, data = True, b"", rest
        own, rest = data[: self.left], data[self.left :]
        self.sha.update(own)
        self.size += len(own)
        self.left -= len(own)
        return rest

    def row(self) -> tuple:
        """(page_id, payload_bytes, payload_digest, record_type, refers_to) once the record ended."""
        fields = self.fields or {}
        kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if self.left or kind == "response" and said != self.sha.hexdigest():
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
        number = lambda s: int(s) if (s := s.removeprefix("<urn:page:").removesuffix(">")) else None
        page = number(fields["WARC-Record-ID"])
        if kind == "revisit":
            return page, int(fields["WARC-Payload-Length"]), said, kind, number(fields["WARC-Refers-To"])
        return page, self.size, self.sha.hexdigest(), kind, None


def read(chunks: DataFrame) -> DataFrame:
    """The records of a chunk table, payloads digested chunk by chunk and checked against the
    digests that the chunks and the record carry."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=names)
        now, reader, rows, tool = None, Reader(), [], zstandard.ZstdDecompressor()
        for batch in batches:
            for i, record in enumerate(batch.column(0).to_pylist()):
                if record != now:
                    if now is not None:
                        rows.append(reader.row())
                    now, reader = record, Reader()
                reader.feed(tool.decompress(batch.column(2)[i].as_buffer()))
                if reader.sha.hexdigest() != batch.column(3)[i].as_py():
                    raise ValueError(f"damaged chunk {batch.column(1)[i].as_py()} of {(reader.fields or {}).get('WARC-Record-ID')}")
            if len(rows) > 1000:
                yield pack(rows)
                rows = []
        if now is not None:
            rows.append(reader.row())
        yield pack(rows)

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = pa.array([tool.compress(d.as_buffer()) for d in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data, batch.column(3)], names=["record", "chunk", "data", "payload_digest"])

    dealt = chunks.select("record", "chunk", "data", "payload_digest").mapInArrow(press, CHUNKS).repartition("record").sortWithinPartitions("record", "chunk")
    return dealt.select("record", "chunk", "data", "payload_digest").mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(chunks: DataFrame, out: BinaryIO) -> None:
    """Write a chunk table as one WARC file, a chunk at a time."""
    for row in chunks.orderBy("record", "chunk").select("data").toLocalIterator():
        out.write(row["data"])


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """The records of all pages, written and read back; see ``plan_records`` for odd rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read(common.cut(write(plan_records(pages)), "warc"))


SQL = """
WITH keyed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
led AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS lead FROM keyed)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN lead IS NULL OR lead = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN lead <> page_id THEN lead END AS refers_to
FROM led
"""
