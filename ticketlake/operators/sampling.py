"""Seeded samples and splits that any engine with md5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.session import cut_lineage

_BUCKET_DIGITS = 4  # 65,536 buckets of the md5 space


def seeded_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def sample_rows(df: DataFrame, n: int, seed: int, key: str = "ticket_id") -> DataFrame:
    """Exactly ``n`` rows (all when there are fewer): the smallest seeded hashes."""
    return df.withColumn("h", seeded_hash(key, seed)).orderBy("h", key).limit(n).drop("h")


def split(
    df: DataFrame,
    fraction: float = 0.2,
    seed: int = 42,
    key: str = "ticket_id",
    by: str | None = None,
) -> DataFrame:
    """Mark exactly ``ceil(fraction * n)`` rows as test, of all rows or of each class ``by``.

    Rows are ranked by seeded hash without sorting a whole class in one task: counts per hash
    bucket find the bucket where the cut falls, and only that bucket's rows are ranked.
    ``df`` is read three times, twice for its keys only: pass a table, not a costly plan.
    """
    hashed = df.withColumn("h", seeded_hash(key, seed))
    keys = hashed.select(*([by] if by else []), "h", key).withColumn("bucket", F.left("h", F.lit(_BUCKET_DIGITS)))
    last = cut_lineage(_last_test_rows(keys, fraction, key, [by] if by else []), "cuts")
    if by is None:
        # one row, so a scalar instead of a join
        cut = last.select(F.struct("last_h", "last_key")).scalar()
        is_test = F.struct(F.col("h").alias("last_h"), F.col(key).alias("last_key")) <= cut
        return hashed.withColumn("is_test", F.coalesce(is_test, F.lit(False))).drop("h")
    is_test = F.struct("h", key) <= F.struct("last_h", "last_key")
    return (
        hashed.join(last, by, "left")
        .withColumn("is_test", F.coalesce(is_test, F.lit(False)))
        .drop("h", "last_h", "last_key")
    )


def _last_test_rows(keys: DataFrame, fraction: float, key: str, by: list[str]) -> DataFrame:
    """Hash and key of the last test row of each class, or of all rows."""
    counts = keys.groupBy(*by, "bucket").agg(F.count("*").alias("n"))
    # at most 65,536 rows per class from here to the cut bucket
    running = Window.partitionBy(*by).orderBy("bucket")
    counts = counts.withColumn("before", F.sum("n").over(running) - F.col("n"))
    counts = counts.withColumn("target", F.ceil(F.sum("n").over(Window.partitionBy(*by)) * F.lit(fraction)))
    cuts = (
        counts.filter((F.col("before") < F.col("target")) & (F.col("target") <= F.col("before") + F.col("n")))
        .withColumn("take", F.col("target") - F.col("before"))
        .select(*by, "bucket", "take")
    )
    ranked = Window.partitionBy(*by, "bucket").orderBy("h", key)
    return (
        keys.join(cuts, [*by, "bucket"])
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") == F.col("take"))
        .select(*by, F.col("h").alias("last_h"), F.col(key).alias("last_key"))
    )


def split_by_threshold(df: DataFrame, fraction: float = 0.2, seed: int = 42, key: str = "ticket_id") -> DataFrame:
    """About ``fraction`` of the rows as test, decided row by row with no shuffle."""
    limit = F.lit(f"{int(fraction * 16**8) - 1:08x}")
    return df.withColumn("is_test", F.left(seeded_hash(key, seed), F.lit(8)) <= limit)
