"""Cleaning a ticket table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.functions.text import clean_text
from ticketlake.schema import MIN_DESCRIPTION, TEXT_FIELDS
from ticketlake.session import cut_lineage


def clean_columns(df: DataFrame, columns: list[str] = TEXT_FIELDS) -> DataFrame:
    return df.withColumns({c: clean_text(c) for c in columns})


def longer_than(df: DataFrame, column: str = "description", n: int = MIN_DESCRIPTION) -> DataFrame:
    return df.filter(F.length(column) > n)


def _digest(column: str):
    return F.sha2(F.col(column), 256)


def drop_duplicate_text(df: DataFrame, column: str = "description", order: str = "doc_id") -> DataFrame:
    """One row per text: the one with the smallest ``order``, which must be unique.

    Only digests and order keys are grouped, with a map-side minimum, so many copies of one
    text cost one row per task; whole rows move once, on the unique key. ``df`` is read twice.
    """
    first = df.groupBy(_digest(column).alias("digest")).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def clean_tickets(df: DataFrame) -> DataFrame:
    """Normalise text, drop analysis columns and short descriptions, then duplicates; the cleaned rows are written once."""
    cleaned = df.transform(clean_columns).drop("desc_length", "resolution_length").transform(longer_than)
    return cut_lineage(cleaned, "cleaned").transform(drop_duplicate_text)


def drop_counts(df: DataFrame) -> DataFrame:
    """How many rows each cleaning step drops."""
    text = df.select(clean_text("description").alias("description"))
    keep = F.length("description") > MIN_DESCRIPTION
    return text.agg(
        F.count("*").alias("n_before"),
        F.count_if(~keep).alias("n_short"),
        F.count_if(keep).alias("n_long"),
        F.count_distinct(F.when(keep, _digest("description"))).alias("n_final"),
    ).select(
        "n_before", "n_short", (F.col("n_long") - F.col("n_final")).alias("n_duplicate"), "n_final"
    )
