"""The ticket table as a view over the supplied tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.schema import RESOLVED_STATUSES
from ticketlake.sources.tables import table

_FROM_LINEITEM = {
    "resolved_date",
    "product_service",
    "satisfaction_rating",
    "time_to_resolution_hours",
}


def tickets(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Tickets with the asked columns (all when none are named).

    The two optional joins are left joins on unique keys, so leaving them out when none of
    their columns is asked for changes no row.
    """
    # dealt by the key that the join needs anyway; a file of one row group would be one task to the end
    docs = table(spark, sf_dir, "documents").repartition("doc_id")
    customer = table(spark, sf_dir, "customer")
    passages = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    n_passages = passages.agg(F.count("*")).scalar()

    # what a ticket has of its order is joined without the texts, and the texts then move once
    ids = table(spark, sf_dir, "documents").select("doc_id")
    orders = table(spark, sf_dir, "orders").join(ids, F.col("o_orderkey") == F.col("doc_id"), "left_semi")
    facts = orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
    if not columns or _FROM_LINEITEM & set(columns):
        lines = table(spark, sf_dir, "lineitem")
        # first line of each order
        first_line = (
            lines.groupBy("l_orderkey")
            .agg(F.min(F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_quantity")).alias("line"))
            .select("l_orderkey", "line.l_shipdate", "line.l_partkey", "line.l_quantity")
        )
        parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
        facts = facts.join(first_line, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(
            parts, F.col("p_partkey") == F.col("l_partkey"), "left"
        )
    else:
        for name, kind in (("l_shipdate", "timestamp_ntz"), ("l_quantity", "double"), ("p_name", "string")):
            facts = facts.withColumn(name, F.lit(None).cast(kind))
    df = docs.join(facts, F.col("doc_id") == F.col("o_orderkey"))
    df = df.withColumn("slot", F.col("doc_id") % n_passages).join(passages, F.col("item_id") == F.col("slot"))

    done = F.col("o_orderstatus") == "F"
    partial = F.col("o_orderstatus") == "P"
    hours = F.abs(F.datediff("l_shipdate", "o_orderdate")) % 168 + F.lit(0.5).cast("double")
    df = df.withColumn("h", hours).select(
        F.concat(F.lit("TKT-"), (F.col("doc_id") + 10001).cast("string")).alias("ticket_id"),
        "doc_id",
        F.col("o_orderdate").alias("created_date"),
        F.when(done, F.expr("timestampadd(MINUTE, cast(h * 60 AS int), o_orderdate)")).alias("resolved_date"),
        F.col("lang").alias("category"),
        F.concat_ws("/", "lang", "source").alias("sub_category"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Critical")
        .when(F.col("o_orderpriority") == "2-HIGH", "High")
        .when(F.col("o_orderpriority") == "5-LOW", "Low")
        .otherwise("Medium")
        .alias("priority"),
        F.when(done & (F.col("doc_id") % 5 == 0), "Resolved")
        .when(done, "Closed")
        .when(partial & (F.col("doc_id") % 3 == 0), "Pending")
        .when(partial, "In Progress")
        .otherwise("Open")
        .alias("status"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("subject"),
        F.col("text").alias("description"),
        F.when(done, F.col("passage")).alias("resolution"),
        F.col("p_name").alias("product_service"),
        F.col("c_mktsegment").alias("department"),
        F.when(done, (F.col("l_quantity").cast("bigint") % 5 + 1).cast("double")).alias("satisfaction_rating"),
        F.when(done, F.col("h")).alias("time_to_resolution_hours"),
    )
    return df.select(*columns) if columns else df


def load_corpus(df: DataFrame) -> DataFrame:
    """Closed and Resolved tickets."""
    return df.filter(F.col("status").isin(*RESOLVED_STATUSES))
