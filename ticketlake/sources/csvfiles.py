"""Tickets as CSV files, read by byte ranges though fields may hold line breaks."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake.schema import DATE_FORMAT, TICKET

_FORMAT = {"header": True, "quote": '"', "escape": '"', "timestampNTZFormat": DATE_FORMAT}
_ROWS_PER_FILE = 500_000
_CHUNK = 1 << 20
_RECORDS_BYTES = 8 << 20
_COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"
_RANGE = "path string, size long, first long, last long"


def _chunks(path: str, first: int, last: int) -> Iterator[bytes]:
    """Bytes ``first`` to ``last`` of a file, a chunk at a time."""
    store, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    with store.open_input_file(name) as file:
        file.seek(first)
        while first < last and (data := file.read(min(_CHUNK, last - first))):
            yield data
            first += len(data)


def _count_quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        quotes = [sum(c.count(b'"') for c in _chunks(r["path"], r["first"], r["last"])) for r in batch.to_pylist()]
        yield pa.record_batch([*batch.columns, pa.array(quotes, pa.int64())], [*batch.schema.names, "quotes"])


def _range_records(path: str, size: int, first: int, last: int, quoted: bool) -> Iterator[bytes]:
    """Records that begin behind a line end of the range, or at the file's start, each to its own end.

    A line end between an odd and an even quote belongs to a field. The last record is read on beyond the range.
    """
    at, inside = first, int(quoted)
    open_ = [b""] if first == 0 else None  # what there is of the record that began last
    for data in _chunks(path, first, size):
        codes = np.frombuffer(data, np.uint8)
        odd = np.cumsum(codes == ord('"'), dtype=np.uint8) + np.uint8(inside) & 1
        start = 0
        for end in np.flatnonzero((codes == ord("\n")) & (odd == 0)).tolist():
            if open_ is not None:
                yield b"".join([*open_, data[start:end]])
            if at + end >= last:
                return
            open_, start = [], end + 1
        if open_ is not None:
            open_.append(data[start:])
        elif at + len(data) >= last:
            return  # the whole range lies in a record that began before it
        at, inside = at + len(data), int(odd[-1])
    if open_ is not None:
        yield b"".join(open_)


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of every record but the header, in batches of bounded bytes; empty lines are no records."""
    for batch in batches:
        for r in batch.to_pylist():
            held, held_bytes = [], 0
            records = _range_records(**r)
            if r["first"] == 0:
                next(records, None)  # the header
            for record in records:
                record = record.removesuffix(b"\r")
                if record:
                    held.append(record.decode("utf-8", "replace"))
                    held_bytes += len(record)
                if held_bytes >= _RECORDS_BYTES:
                    yield pa.record_batch([pa.array(held, pa.string())], ["record"])
                    held, held_bytes = [], 0
            yield pa.record_batch([pa.array(held, pa.string())], ["record"])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = 64 << 20) -> DataFrame:
    """Rows of all CSV files at ``path``, which begin with a header line; a file is cut into ranges of ``range_bytes``.

    Fields may hold commas, quotes (doubled) and line breaks, so a line end tells nothing without the quotes
    before it. One pass counts the quotes of each range, their running sum says which ranges begin inside a
    field, and the second pass cuts records at the line ends outside of fields. A record belongs to the range
    it begins behind, and is the only thing that has to fit into memory.

    Records end with \\n or \\r\\n, line breaks inside a field stay as written; a quote stands only around or,
    doubled, inside of a quoted field. Text is UTF-8, a malformed value becomes null, and files without records
    give no rows. The tasks read with ``pyarrow.fs`` (a shared mount, ``s3://``, ``hdfs://``). Compressed files
    have no ranges; Spark's own reader takes each of them in one task.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    # as pyarrow.fs names the same places
    files = listed.withColumn("path", F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:///"), "^s3[an]:", "s3:"))
    compressed = F.col("path").rlike(_COMPRESSED)
    last = F.least(F.col("first") + range_bytes, F.col("size")).alias("last")
    ranges = (
        files.filter(~compressed & (F.col("size") > 0))
        .withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))))
        .select("path", "size", "first", last)
    )
    count, total = ranges.agg(F.count("*"), F.sum(F.col("last") - F.col("first"))).first()
    tasks = max(-(-(total or 0) // range_bytes), min(count, spark.sparkContext.defaultParallelism), 1)  # small files share one
    before = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.repartition(tasks)
        .mapInArrow(_count_quotes, f"{_RANGE}, quotes long")
        .withColumn("quoted", F.coalesce(F.sum("quotes").over(before) % 2 == 1, F.lit(False)))
        .drop("quotes")
    )
    records = starts.repartition(tasks).mapInArrow(_cut_records, "record string")
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in _FORMAT.items() if k != "header"}
    parsed = records.select(F.from_csv("record", F.lit(schema.simpleString()), {**options, "multiLine": "true"}).alias("row"))
    rows = parsed.select("row.*")
    packed = [r["path"] for r in listed.filter(compressed).select("path").toLocalIterator()]
    if packed:
        rows = rows.unionByName(spark.read.schema(schema).options(multiLine=True, **_FORMAT).csv(packed))
    return rows


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TICKET)


def write_tickets(df: DataFrame, path: str) -> None:
    """Files of bounded rows; blanks at the ends of text stay."""
    df.select(*TICKET.fieldNames()).write.mode("overwrite").options(
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        maxRecordsPerFile=_ROWS_PER_FILE,
        **_FORMAT,
    ).csv(path)
