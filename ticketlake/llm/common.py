"""What the operators of this folder share."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.session import cut_lineage, fresh_path  # noqa: F401
from ticketlake.sources.tables import table  # noqa: F401

#: ASCII capitals only; ``lower`` would also change other alphabets.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def parts_for(spark: SparkSession, rows: int, rows_per_part: int) -> int:
    """Partitions for ``rows`` rows of bounded size: in proportion to them, and one a core slot at least."""
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, math.ceil(rows / rows_per_part))


def text_of(column: str) -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """Adds a number for each row, so that repeated rows can be told apart.

    Another read may number the rows otherwise, as file splits follow the cores that are there at the time: what
    is joined on the number has to come from one read (see ``stored_rows``).
    """
    name = free_name(docs, "_row")
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def stored_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """``with_row`` written once, so that all reads of it have the same numbers."""
    numbered, name = with_row(docs)
    path = fresh_path(docs.sparkSession, "numbered-rows")
    numbered.write.option("compression", "zstd").parquet(path)  # whole texts
    return docs.sparkSession.read.schema(numbered.schema).parquet(path), name


def small_batches(batches: Iterable[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of one text column; a longer text comes alone.

    Working copies of a batch (words, ids, bits) take many times its bytes.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def fold(modulus: int, id_col: str = "doc_id") -> Column:
    """CRC-32 of the id as text, by a modulus; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
