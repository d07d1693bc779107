"""Exact deduplication by a sharded cuckoo-filter index of text digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import cut_lineage, stored_rows, text_of, with_row
from ticketlake.llm.index import ADD, ReversibleIndex, changes, fold, keys_of, shards_for

DIGEST_BYTES = 32


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``doc_id``, ``row`` and ``key``: SHA-256 of the text with A-Z in lower case, as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [hashlib.sha256(t.as_buffer().to_pybytes().lower()).digest() for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], ["doc_id", "row", "key"])

    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    columns = [F.col(id_col).cast("long"), row, text_of(text_col).cast("binary")]
    return docs.select(*columns).mapInArrow(run, "doc_id long, row long, key binary")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``row``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest
    ``doc_id`` stays; of repeated rows with that ``doc_id``, the last one. A null ``doc_id`` is less than any
    other, and a group with no other has a null ``keep_id``. Empty tables give no rows. ``row`` is ``row_col``, or
    else a number given here; other columns are not read.

    Digests are combined within tasks, so a text that a third of all rows share costs a few rows for each
    task; each shard of the index takes its digests through its filter. The way back to the rows is one join of
    narrow columns, whose skewed side adaptive execution splits.
    """
    numbered, row = (docs, row_col) if row_col else with_row(docs)
    keys = cut_lineage(digests(numbered, id_col, text_col, row), "dedup-digests")
    shards = shards_for(docs.sparkSession, keys.count())
    groups = keys_of(fold(changes(keys, ADD, "doc_id", "row"), DIGEST_BYTES, shards)).select(
        "key", F.col("best_id").alias("keep_id"), F.col("best_row"), F.col("n").alias("group_size")
    )
    return keys.join(groups, "key").select(
        "doc_id",
        "row",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("best_row")).alias("kept"),
        F.lower(F.hex("key")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    numbered, row = stored_rows(docs)
    kept = exact_dedup(numbered, id_col, text_col, row).filter("kept").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ReversibleIndex:
    """Which document holds which text, for a collection that grows and shrinks."""
    return ReversibleIndex.build(digests(docs, id_col, text_col), DIGEST_BYTES)


def keepers(index: ReversibleIndex) -> DataFrame:
    """``key``, ``keep_id`` (the largest id of the documents that hold the text now) and ``n`` of live digests."""
    largest = index.members.groupBy("key").agg(F.max("doc_id").alias("keep_id"))
    return index.live().join(largest, "key")
