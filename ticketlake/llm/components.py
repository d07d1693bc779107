"""Connected components of a graph in a table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a`` and ``b``: every node that has a link and is not the least of its component, and that least node.

    ``edges`` has long columns ``a`` and ``b``; direction, repeats and loops do not matter. A few rounds are
    enough (their number grows with the logarithm of the largest component), each written to the shared folder.
    The minima combine before the shuffle, and joins on a hot node are split by adaptive execution.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = cut_lineage(now, "components"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38)"))).first()
        if state == before:
            return now
        before = state
        now = cut_lineage(_small_star(_large_star(now)), "components")
