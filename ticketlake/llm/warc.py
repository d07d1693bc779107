"""WARC archives as seekable Zstandard bundles: written by tasks, read back, and read by record."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import cut_lineage, fresh_path, small_batches, stored_rows

# Fixed values of the formats: WARC 1.1, and the seek table of seekable Zstandard (a skippable frame).
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 256 << 10  # of records, before compression
BUNDLE_BYTES = 8 << 20  # of frames
_DATE = "1970-01-01T00:00:00Z"  # of capture; the pages have none
_INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"


def record_id(page_id: int | None, row: int) -> str:
    """Names a row: its page, and its place for pages that come more than once."""
    return f"urn:page:{'' if page_id is None else page_id}:{row}"


def _page_of(record: str) -> int | None:
    page = record.split(":")[2]
    return int(page) if page else None


def _header_value(text: str) -> str:
    """No header value holds a line break or another control character."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def write_record(page_id: int | None, row: int, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit that only has the payload's length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if refers_to is None else http
    own = record_id(page_id, row)
    headers = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{own}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_header_value(url) if url else own}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        headers[1:1] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return VERSION + b"\r\n" + "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].split(b"\r\n")
        if version != VERSION:
            raise ValueError(f"not a WARC record: {version[:20]!r}")
        headers = dict(x.decode().split(": ", 1) for x in lines)
        start, size = end + 4, int(headers["Content-Length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record {headers['WARC-Record-ID']} does not end where it should")
        yield headers, data[start : start + size]
        at = start + size + 4


class Bundle:
    """Frames of one file, and where each record is; ``close`` adds the seek table."""

    def __init__(self, level: int = 3):
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.bytes = 0
        self.open: list[bytes] = []
        self.open_bytes = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset within the frame once it is decompressed, and length."""
        place = len(self.frames), self.open_bytes, len(record)
        self.open.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self._end_frame()
        return place

    def _end_frame(self) -> None:
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_bytes))
            self.bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def close(self) -> bytes:
        self._end_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        table = struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer
        return b"".join(self.frames) + table


def seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed and decompressed size of each frame, from a bundle or its end."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end")
    out, start = [], 0
    for at in range(len(tail) - 9 - 8 * n, len(tail) - 9, 8):
        packed, size = struct.unpack("<II", tail[at : at + 8])
        out.append((start, packed, size))
        start += packed
    return out


def roles(pages: DataFrame, row: str, min_bytes: int = 0, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """Of each row: ``row``, ``page_id``, ``size`` and ``sha1`` (hex) of its payload, and whom it ``revisits`` (a row).

    Of equal payloads of ``min_bytes`` or more, the row with the largest id is the response, and of repeated
    rows the last; a null id is less than any other.
    """
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(row).alias("row"),
        F.col(id_col).cast("long").alias("page_id"),
        F.octet_length(payload).cast("long").alias("size"),
        F.sha1(payload).alias("sha1"),
    )
    rows = cut_lineage(rows, "warc-digests")
    best = rows.groupBy("sha1", "size").agg(F.max(F.struct("page_id", "row")).alias("best"))
    other = (F.col("size") >= min_bytes) & (F.col("best.row") != F.col("row"))
    return rows.join(best, ["sha1", "size"]).select(
        "row", "page_id", "size", "sha1", F.when(other, F.col("best")).alias("revisits")
    )


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html"
) -> DataFrame:
    """Writes a record for each row to ``part-*.warc.zst`` below ``path`` and returns the index of all records.

    A null payload is an empty one; a null ``url`` is replaced by the record's id. Each partition writes its
    own bundles of bounded size, in order of its rows, so a task that runs again replaces its files by equal
    ones; a file takes its final name when it is whole. ``path`` is a folder that all executors reach through
    ``pyarrow.fs`` (a shared mount, ``s3://``, ``hdfs://``). The three columns are written once with their rows'
    numbers, which are part of the records' ids.
    """
    numbered, row = stored_rows(pages.select(id_col, url_col, text_col))
    known = roles(numbered, row, min_bytes, id_col, text_col).withColumnRenamed("row", row)
    texts = numbered.select(row, F.col(url_col).alias("url"), F.coalesce(F.col(text_col), F.lit("")).alias("html"))
    records = (
        texts.join(known, row)
        .select(
            *(F.col(row).alias("row"), "page_id", "url", "size", "sha1"),
            F.when(F.col("revisits").isNull(), F.col("html").cast("binary")).alias("payload"),
            F.col("revisits.page_id").alias("to_page"),
            F.col("revisits.row").alias("to_row"),
        )
        .sortWithinPartitions("row")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder)
        context = TaskContext.get()
        bundle, number, index = Bundle(), 0, []

        def end() -> pa.RecordBatch:
            name = f"{folder}/part-{context.partitionId():05d}-{number:05d}.warc.zst"
            own = f"{name}.{context.taskAttemptId()}.tmp"
            with store.open_output_stream(own) as out:
                out.write(bundle.close())
            store.move(own, name)
            columns = list(zip(*index, strict=True))
            columns.insert(2, [name.rpartition("/")[2]] * len(index))
            return pa.record_batch([pa.array(c) for c in columns], schema=_index_schema())

        for batch in small_batches(batches, 5):
            for r, page, url, size, sha1, payload, to_page, to_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                to = None if to_row is None else record_id(to_page, to_row)
                place = bundle.add(write_record(page, r, url, payload, size, digest, to))
                index.append((record_id(page, r), page, *place))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield end()
                    bundle, number, index = Bundle(), number + 1, []
        if index:
            yield end()

    return cut_lineage(records.mapInArrow(run, _INDEX), "warc-index")


def _index_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _INDEX.split(", "))])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record below ``path``: ``record_id``, ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to`` (a record id) and ``payload`` (null in a revisit).

    Each response's payload is held against its digest; a bundle that does not read back whole fails the job.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    names = ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    text, long = pa.string(), pa.int64()
    kinds = [text, long, text, long, text, text, text, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer().to_pybytes()
                for start, packed, size in seek_table(data):
                    rows = []
                    for headers, block in read_records(zstd.decompress(data[start : start + packed], max_output_size=size)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind, own = headers["WARC-Type"], headers["WARC-Record-ID"][1:-1]
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        if kind == "response" and (
                            len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest
                        ):
                            raise ValueError(f"{own}: the payload is not the one that was written")
                        to = headers.get("WARC-Refers-To", "<>")[1:-1] or None
                        url = headers["WARC-Target-URI"]
                        rows.append((own, _page_of(own), url, size, digest, kind, to, payload if kind == "response" else None))
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = (
        "record_id string, page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to string, payload binary"
    )
    return files.mapInArrow(run, schema)


def fetch(index: DataFrame, path: str) -> DataFrame:
    """The records that rows of the index name, each read from its frame alone: ``record_id`` and ``record``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            found = []
            for bundle, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                with store.open_input_file(f"{folder}/{bundle}") as file:
                    size = file.size()
                    n = struct.unpack("<I", file.read_at(9, size - 9)[:4])[0]
                    start, packed, plain = seek_table(file.read_at(9 + 8 * n, size - 9 - 8 * n))[frame]
                    data = zstd.decompress(file.read_at(packed, start), max_output_size=plain)
                found.append(data[offset : offset + length])
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], ["record_id", "record"])

    wanted = index.select("record_id", "bundle", "frame", "offset", "length")
    return wanted.mapInArrow(run, "record_id string, record binary")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to a new folder below the shared one and reads the archives back.

    One row for each row of ``pages``: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and
    ``refers_to`` (the response's page). An empty table writes no files and gives no rows.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    if not write_archives(pages, path).limit(1).count():
        return spark.createDataFrame(
            [], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
        )
    to = F.nullif(F.split_part("refers_to", F.lit(":"), F.lit(3)), F.lit("")).cast("long")
    return read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", to.alias("refers_to")
    )
