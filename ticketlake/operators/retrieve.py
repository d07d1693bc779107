"""Similar-ticket retrieval: over-fetch, drop repeated resolutions, keep the closest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.functions.text import or_empty, strip
from ticketlake.operators.vector import first_of_each, knn_exact, where_equal
from ticketlake.schema import HIT_FIELDS
from ticketlake.sources.cellstore import CellStore

OVERFETCH = 3


def search(queries: DataFrame, corpus: DataFrame, top_k: int = 5, where: dict | None = None) -> DataFrame:
    """The nearest tickets of each query, with their fields.

    ``queries(query_id, vector)``; ``corpus`` has the ticket fields and ``vector``.
    """
    corpus = where_equal(corpus, where)
    hits = knn_exact(queries, corpus.withColumnRenamed("ticket_id", "neighbour_id"), top_k)
    return attach_fields(hits.withColumnRenamed("neighbour_id", "ticket_id"), corpus)


def attach_fields(hits: DataFrame, corpus: DataFrame, fields: list[str] = HIT_FIELDS) -> DataFrame:
    """Ticket fields of each hit. Adaptive execution splits the rows of a ticket that is close to very many queries."""
    fields = list(dict.fromkeys(["ticket_id", *fields]))
    texts = {"resolution", "subject", "sub_category"} & set(fields)
    lookup = corpus.select(*[or_empty(f).alias(f) if f in texts else f for f in fields])
    return hits.join(lookup, "ticket_id")


def distinct_hits(hits: DataFrame, top_k: int, key: str = "resolution_key") -> DataFrame:
    """Per query, the closest hit of each key, then the first ``top_k``, ranked again."""
    return first_of_each(hits, key, top_k).drop(key)


def resolution_key() -> Column:
    return F.sha2(strip(or_empty("resolution")), 256)


def search_rows(corpus: DataFrame, where: dict | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """What ``retrieve_ids`` searches; resolutions are compared by digest, so their text does not travel."""
    return where_equal(corpus, where).select(
        F.col("ticket_id").alias("neighbour_id"),
        "vector",
        resolution_key().alias("resolution_key"),
        *carry,
    )


def retrieve_ids(
    queries: DataFrame,
    corpus: DataFrame | CellStore,
    top_k: int = 20,
    where: dict | None = None,
    carry: tuple[str, ...] = (),
    n_probe: int | None = None,
) -> DataFrame:
    """``retrieve`` without the ticket fields: ``query_id, ticket_id, distance, *carry, rank``.

    A corpus that is asked again and again is given as a store of its ``search_rows``, as a ``VectorIndex`` has it;
    with ``n_probe`` only so many of its cells are asked.
    """
    carry = ("resolution_key", *carry)
    distinct = ("resolution_key", top_k)
    if isinstance(corpus, CellStore):
        hits = corpus.search(queries, OVERFETCH * top_k, carry, where, n_probe, distinct=distinct)
    else:
        hits = knn_exact(queries, search_rows(corpus, where, carry[1:]), OVERFETCH * top_k, carry=carry, distinct=distinct)
    return hits.withColumnRenamed("neighbour_id", "ticket_id").drop("resolution_key")


def retrieve(
    queries: DataFrame,
    corpus: DataFrame,
    top_k: int = 20,
    where: dict | None = None,
    index: CellStore | None = None,
    n_probe: int | None = None,
) -> DataFrame:
    """Up to ``top_k`` hits per query with distinct resolutions; fewer is a valid answer.

    ``index`` is the store of the corpus' ``search_rows``, where there is one; else the corpus is cut for this call.
    """
    hits = retrieve_ids(queries, corpus if index is None else index, top_k, where, n_probe=n_probe)
    return attach_fields(hits, corpus)


def flag_relevant(hits: DataFrame, truth: DataFrame, label: str = "topic") -> DataFrame:
    """1 where a hit carries the query's own label, else 0; ``truth(query_id, true_label)``."""
    return hits.join(truth, "query_id").withColumn(
        "relevance", F.coalesce((F.col(label) == F.col("true_label")).cast("int"), F.lit(0))
    )
