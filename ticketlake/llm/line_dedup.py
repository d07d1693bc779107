"""Reversible line deduplication by a sharded cuckoo-filter index of line keys with exact reference counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import cut_lineage, stored_rows, text_of
from ticketlake.llm.index import ReversibleIndex

KEY_BYTES = 16
#: Space, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """A line without blanks at its ends and with A-Z in lower case."""
    return line.strip(BLANKS).lower()


def _hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=KEY_BYTES).digest()


def line_keys(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, min_chars: int = 1
) -> DataFrame:
    """``doc_id``, ``row`` and ``key`` (a 128-bit hash) of each document's different lines of ``min_chars`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, keys = [], []
            for at, text in enumerate(batch.column(2)):
                found = {line_key(x) for x in text.as_buffer().to_pybytes().split(b"\n")}
                found = [_hash(k) for k in found if len(k) >= min_chars and len(k.decode()) >= min_chars]
                keys += found
                places += [at] * len(found)
            at = pa.array(places, pa.int64())
            yield pa.record_batch(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary())],
                ["doc_id", "row", "key"],
            )

    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    columns = [F.col(id_col).cast("long"), row, text_of(text_col).cast("binary")]
    return docs.select(*columns).mapInArrow(run, "doc_id long, row long, key binary")


def build_index(docs: DataFrame, min_chars: int = 1) -> ReversibleIndex:
    """Which document holds which lines, and each line's count of documents. See ``drop_lines``."""
    return ReversibleIndex.build(line_keys(docs, min_chars=min_chars), KEY_BYTES)


def line_dedup(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``row``, ``text`` of the lines that stay, ``n_lines``, ``n_dropped``.

    Lines whose key (see ``line_key``) has at least ``min_chars`` code points and stands in at least ``min_docs``
    rows of ``docs`` are dropped everywhere. A null text is one empty line; a text that loses all its lines is
    empty; repeated rows count as documents of their own, whatever their ids. Empty tables give no rows.
    Ids and texts are written once with their rows' numbers; other columns are not read.
    """
    numbered, row = stored_rows(docs.select(id_col, text_col))
    members = cut_lineage(line_keys(numbered, id_col, text_col, row, min_chars), "line-members")
    index = ReversibleIndex.build(members, KEY_BYTES)
    return drop_lines(numbered, members, index, min_docs, id_col, text_col, row)


def drop_lines(
    docs: DataFrame,
    members: DataFrame,
    index: ReversibleIndex,
    min_docs: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """``docs`` without the lines that the index counts in ``min_docs`` documents or more.

    ``members`` are the line keys of ``docs``, by ``row`` if ``row_col`` is given and else by ``doc_id``. Only
    keys travel to the counts, and each document's text meets its own list of dropped keys once.
    """
    place = "row" if row_col else "doc_id"
    frequent = index.live().filter(F.col("n") >= min_docs).select("key")
    dropped = members.join(frequent, "key").groupBy(place).agg(F.collect_set("key").alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, keys in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                lines = text.as_buffer().to_pybytes().split(b"\n")
                gone = set(keys or ())
                stay = [x for x in lines if _hash(line_key(x)) not in gone] if gone else lines
                texts.append(b"\n".join(stay).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts), pa.array(n_lines), pa.array(n_dropped)],
                ["doc_id", "row", "text", "n_lines", "n_dropped"],
            )

    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.col(row_col) if row_col else F.lit(None).cast("long")).alias("row"),
        text_of(text_col).cast("binary").alias("text"),
    )
    return (
        texts.join(dropped, place, "left")
        .select("doc_id", "row", "text", "keys")
        .mapInArrow(run, "doc_id long, row long, text string, n_lines long, n_dropped long")
    )
