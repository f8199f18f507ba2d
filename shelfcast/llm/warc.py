"""WARC archives: whole-file gzip streams rewritten as one member per record, with an offset index.

Archives are written by Spark's text writer (a record is a row, the two line ends after it the line
separator), which gives one gzip stream a file. The normaliser inflates each stream once, piece by
piece, and rewrites every record as a gzip member of its own; a sidecar table holds each record's
archive, offset and length. The rewritten archives also go through the text writer, byte for byte:
the line separator is the zero byte that ends the members of all records below 16 MiB (larger ones
are followed by one byte of zero padding). So every file has Spark's commit protocol, and any file
system that Spark writes to will do.

Payloads equal in digest and at least `least_bytes` long are stored once: the record with the
smallest page_id is a response, the others are revisits that refer to it.

Rows: a null payload counts as empty; a null URL leaves the field out; control characters in a URL
are dropped. Among equal payloads a null page_id is a revisit, or a response if no page_id is known;
rows that share the smallest page_id are responses all. Extra columns are ignored. An empty table
gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import batch, saved
from shelfcast.session import scratch_folder

LEAST_BYTES = 100
#: A task holds one archive: 4,000 pages of 100 kB are 400 MB at most, before compression.
RECORDS_PER_ARCHIVE = 4000
GZIP = 31  # zlib's window bits for a gzip header and trailer
INFLATE_STEP = 1 << 20
LEVEL = 6
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def with_references(pages: DataFrame, key: str, payload: str, url: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(key, url, payload, n_bytes, digest, refers_to) with refers_to set on revisits."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    # first pages and revisits are found on narrow rows; only the revisits' keys meet the payloads
    narrow = rows.filter(F.col("n_bytes") >= least_bytes).select("key", "digest")
    shared = narrow.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = shared.filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    again = narrow.join(shared, "digest").filter(~F.col("key").eqNullSafe(F.col("first"))).distinct()
    again = saved(again.toDF("same", "own", "refers_to"), "revisits")  # written, so that its size is known
    met = (F.col("digest") == F.col("same")) & F.col("key").eqNullSafe(F.col("own"))
    return rows.join(again, met, "left").drop("same", "own")


def records(rows: DataFrame, date: str = EPOCH) -> DataFrame:
    """One column, the record's text without the two line ends that follow it."""
    page = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), "payload"))
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            _field("WARC-Record-ID", page(F.col("key"))),
            _field("WARC-Date", F.lit(date)),
            _field("WARC-Target-URI", F.regexp_replace("url", r"\p{Cntrl}", "")),
            _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
            _field("WARC-Payload-Length", F.col("n_bytes").cast("string")),
            _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            _field("WARC-Refers-To", F.when(revisit, page(F.col("refers_to")))),
            _field("Content-Type", F.when(~revisit, F.lit("application/http; msgtype=response"))),
            _field("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("value")
    )


def write_streams(rows: DataFrame, path: str, per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Archives of one gzip stream and at most `per_archive` records each."""
    writer = rows.write.option("compression", "gzip").option("maxRecordsPerFile", per_archive)
    writer.option("lineSep", "\r\n\r\n").text(path)


class Stream:
    """Reads lines and blocks of a gzip file (of one member or several) without inflating it whole."""

    def __init__(self, data: bytes):
        self.rest, self.held, self.at = data, bytearray(), 0
        self.inflate = zlib.decompressobj(GZIP)

    def _more(self) -> bool:
        while self.rest:
            out = self.inflate.decompress(self.rest, INFLATE_STEP)
            self.rest = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.rest = self.inflate.unused_data.lstrip(b"\x00")
                self.inflate = zlib.decompressobj(GZIP)
            if out:
                del self.held[: self.at]
                self.at = 0
                self.held += out
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end."""
        look = self.at
        while (found := self.held.find(mark, look)) < 0:
            seen = len(self.held) - self.at
            if not self._more():
                return None
            look = self.at + max(0, seen - len(mark))
        out = bytes(self.held[self.at : found + len(mark)])
        self.at = found + len(mark)
        return out

    def take(self, size: int) -> bytes:
        while len(self.held) - self.at < size:
            if not self._more():
                raise ValueError("archive ends within a record")
        out = bytes(self.held[self.at : self.at + size])
        self.at += size
        return out


def parse_fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, header, block) of each record of a gzip archive."""
    stream = Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = parse_fields(head)
        block = stream.take(int(fields["Content-Length"]))
        stream.take(4)  # the two line ends after a record
        yield fields, head, block


def members(data: bytes, step: int = 1 << 13) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member; zero bytes between members are padding."""
    view, at = memoryview(data), 0
    while at < len(data):
        inflate, end, out = zlib.decompressobj(GZIP), at, []
        while not inflate.eof:
            if end >= len(data):
                raise ValueError("archive ends within a member")
            out.append(inflate.decompress(view[end : end + step]))
            end = min(end + step, len(data))
        end -= len(inflate.unused_data)
        yield at, end - at, b"".join(out)
        at = end
        while at < len(data) and not data[at]:
            at += 1


def parse_record(content: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record that stands alone."""
    end = content.index(b"\r\n\r\n") + 4
    fields = parse_fields(content[:end])
    return fields, content[end : end + int(fields["Content-Length"])]


def write_members(
    spark: SparkSession, streams: str, archives: str, level: int = LEVEL, per_archive: int = RECORDS_PER_ARCHIVE
) -> None:
    """Inflate each stream of a folder once and write its records as members."""
    files = spark.read.format("binaryFile").load(streams).select("content")
    schema = pa.schema([("stored", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                out, size = [], 0
                for _, head, block in read_records(data):
                    packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                    member = packer.compress(head + block + b"\r\n\r\n") + packer.flush()
                    out.append(member[:-1] if member[-1] == 0 else member)  # the writer adds a zero
                    size += len(member)
                    if size > 4 * INFLATE_STEP:
                        yield batch(schema, out)
                        out, size = [], 0
                if out:
                    yield batch(schema, out)

    rows = files.mapInArrow(run, "stored binary").select(F.col("stored").cast("string").alias("value"))
    rows.write.option("lineSep", "\x00").option("maxRecordsPerFile", per_archive).text(archives)


INDEX = pa.schema(
    [
        ("archive", pa.string()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
    ]
)
INDEX_DDL = "archive string, record_id string, record_type string, offset long, length long"


def _files(spark: SparkSession, archives: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(archives).select(name.alias("archive"), "content")


def write_index(spark: SparkSession, archives: str, index: str) -> None:
    """The sidecar: where each record's member lies in the finished archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = []
                for offset, length, content in members(data):
                    fields, _ = parse_record(content)
                    out.append((name, fields["WARC-Record-ID"], fields["WARC-Type"], offset, length))
                if out:
                    yield batch(INDEX, *zip(*out))

    _files(spark, archives).mapInArrow(run, INDEX_DDL).write.parquet(index)


def payload_row(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record."""
    number = lambda x: None if x in (None, "null") else int(x)
    page = lambda x: number(re.fullmatch(r"<urn:x-page:(.*)>", x)[1]) if x else None
    kind = fields["WARC-Type"]
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    else:
        size, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    return page(fields["WARC-Record-ID"]), size, digest, kind, page(fields.get("WARC-Refers-To"))


PAGES = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)
PAGES_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, archives: str) -> DataFrame:
    """PAGES of every record, in one pass over the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(1).to_pylist():
                out = [payload_row(*parse_record(content)) for _, _, content in members(data)]
                if out:
                    yield batch(PAGES, *zip(*out))

    return _files(spark, archives).mapInArrow(run, PAGES_DDL)


def read_by_index(spark: SparkSession, archives: str, index: DataFrame) -> DataFrame:
    """PAGES of the records in `index` (any rows of the sidecar), each inflated by itself."""
    spans = index.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("spans"))
    met = _files(spark, archives).join(spans, "archive").select("content", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = (zlib.decompress(data[p["offset"] : p["offset"] + p["length"]], GZIP) for p in places)
                yield batch(PAGES, *zip(*[payload_row(*parse_record(x)) for x in found]))

    return met.mapInArrow(run, PAGES_DDL)


def archive_pages(
    pages: DataFrame,
    key: str = "page_id",
    payload: str = "html",
    url: str = "url",
    least_bytes: int = LEAST_BYTES,
    per_archive: int = RECORDS_PER_ARCHIVE,
) -> tuple[str, str]:
    """Write, normalise and index all pages; returns the folders of archives and index."""
    spark = pages.sparkSession
    path = scratch_folder(spark)
    streams, archives, index = (f"{path}/{x}" for x in ("streams", "archives", "index"))
    write_streams(records(with_references(pages, key, payload, url, least_bytes)), streams, per_archive)
    write_members(spark, streams, archives, per_archive=per_archive)
    write_index(spark, archives, index)
    return archives, index
