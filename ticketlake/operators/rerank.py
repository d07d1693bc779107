"""Reranking of candidates by the relevance of a text column to the query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlake.functions.text import tokens
from ticketlake.operators.sweep import DOCUMENTS_READ, Candidates, Documents, sizes, sweep, with_candidates
from ticketlake.session import cut_lineage, drop_written, folders, shuffles_dropped

K1 = 1.2
B = 0.75
TERMS_AT_ONCE = 1 << 18  # terms of pairs that wait in a task

# scorer(pairs(query_id, ticket_id), queries, corpus, document_key) -> query_id, ticket_id, rerank_score
PairScorer = Callable[[DataFrame, DataFrame, DataFrame, str], DataFrame]


def document_terms(docs: DataFrame, text: str) -> DataFrame:
    """``ticket_id, dl, term, tf`` of each text: its length in words and how often it has each of them.

    A text without words has one row, with a null term.
    """
    words = docs.select("ticket_id", tokens(text).alias("words")).select("ticket_id", F.size("words").alias("dl"), "words")
    each = words.select("ticket_id", "dl", F.explode_outer("words").alias("term"))
    return each.groupBy("ticket_id", "dl", "term").agg(F.count("term").alias("tf"))


def term_statistics(terms: DataFrame) -> DataFrame:
    """``term, df, dl`` of ``document_terms``: texts by term; the null term stands for all texts and their words."""
    by_term = terms.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"), F.lit(0).cast("long").alias("dl"))
    once = terms.groupBy("ticket_id").agg(F.max("dl").alias("dl"))
    all_ = once.agg(F.lit(None).cast("string").alias("term"), F.count("*").alias("df"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
    return by_term.unionByName(all_)


class _Bm25:
    """Queries of a task with their terms and candidates, for ``sweep``: the weights of the terms that a pair shares, summed."""

    def __init__(self, share: pa.Table):
        self.ids, self.pairs = share.column("query_id"), Candidates(share)
        self.cells = self.pairs.cells
        words = share.column("words").combine_chunks()
        coded = words.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
        self.words = coded.dictionary
        self.asked = np.unique(row * len(self.words) + coded.indices.to_numpy(zero_copy_only=False))
        self.score, self.shared = np.zeros(len(self.pairs.row)), np.zeros(len(self.pairs.row), np.int64)
        self.waiting: list[tuple[np.ndarray, pa.ListArray]] = []
        self.n_waiting = 0

    def see(self, _cell: int, _queries: np.ndarray, rows: pa.RecordBatch) -> None:
        document, pair = self.pairs.met(rows.column("ticket_id"))
        if len(document):
            self.waiting.append((pair, rows.column("terms").take(pa.array(document))))
            self.n_waiting += len(self.waiting[-1][1].flatten())
        if self.n_waiting > TERMS_AT_ONCE:
            self.add()

    def add(self) -> None:
        for pair, terms in self.waiting:
            flat = terms.flatten()
            coded = flat.field("term").dictionary_encode()
            known = pc.index_in(coded.dictionary, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)
            word = known[coded.indices.to_numpy(zero_copy_only=False)]
            pair = np.repeat(pair, terms.value_lengths().to_numpy(zero_copy_only=False))
            key = self.pairs.row[pair] * len(self.words) + word
            at = np.minimum(np.searchsorted(self.asked, key), max(len(self.asked) - 1, 0))
            both = (word >= 0) & (self.asked[at] == key) if len(self.asked) else np.zeros(len(key), bool)
            weight = flat.field("weight").to_numpy(zero_copy_only=False)
            self.score += np.bincount(pair[both], weights=weight[both], minlength=len(self.score))
            self.shared += np.bincount(pair[both], minlength=len(self.score))
        self.waiting, self.n_waiting = [], 0

    def found(self) -> pa.Table:
        """A row for each pair that shares a term; a pair that is there more than once has its score as often."""
        self.add()
        row, ticket, score = (x[self.shared > 0] for x in (self.pairs.row, self.pairs.ticket, self.score))
        _, first, pair = np.unique(row * max(len(self.pairs.tickets), 1) + ticket, return_index=True, return_inverse=True)
        ids = [self.ids.take(pa.array(row[first])), self.pairs.tickets.take(pa.array(ticket[first]))]
        return pa.table([*ids, pa.array(np.bincount(pair, weights=score, minlength=len(first)))], ["query_id", "ticket_id", "rerank_score"])


def _scores(pairs: DataFrame, queries: DataFrame, terms: DataFrame, statistics: DataFrame) -> DataFrame:
    """Written. Pairs meet the terms of their documents in tasks that hold the queries: no row for a pair and a term."""
    totals = statistics.filter("term IS NULL").agg(F.struct(F.sum("df").alias("n"), (F.sum("dl") / F.sum("df")).alias("mean"))).scalar()
    frequency = statistics.filter("term IS NOT NULL").select("term", "df")
    idf = F.log1p((totals["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturation = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / totals["mean"]))
    weighted = terms.filter("term IS NOT NULL AND ticket_id IS NOT NULL").join(frequency, "term")
    weighted = weighted.groupBy("ticket_id").agg(F.collect_list(F.struct("term", (idf * saturation).alias("weight"))).alias("terms"))
    n, once = sizes(queries)
    asked = with_candidates(pairs, queries.select("query_id", F.array_distinct(tokens("query")).alias("words")), n)
    documents = Documents(weighted)
    ids = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("query_id", "ticket_id"))
    scores = sweep(asked, documents, _Bm25, f"{ids}, rerank_score double", read_rows=DOCUMENTS_READ)
    if not once:  # an id's queries count together
        scores = scores.groupBy("query_id", "ticket_id").agg(F.sum("rerank_score").alias("rerank_score"))
    scores = cut_lineage(scores.withColumn("rerank_score", F.round("rerank_score", 6)), "scores")
    drop_written(asked)
    documents.drop()
    return scores


def bm25(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, document_key: str = "resolution") -> DataFrame:
    """BM25 of each pair that shares a term; statistics come from the whole corpus column.

    ``queries(query_id, query)``. Where a join meets a hot key (a common term), adaptive execution splits its rows. The
    corpus is tokenised once and written.
    """
    terms = cut_lineage(document_terms(corpus, document_key), "bm25-terms")
    return _scores(pairs, queries, terms, term_statistics(terms))


def rerank(
    candidates: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    top_k: int = 5,
    document_key: str = "resolution",
    scorer: PairScorer = bm25,
) -> DataFrame:
    """The ``top_k`` candidates by score; equal scores keep their retrieval order.

    ``candidates(query_id, ticket_id, rank, ...)``; a pair the scorer leaves out scores 0.
    """
    candidates = cut_lineage(candidates, "candidates")
    scores = scorer(candidates.select("query_id", "ticket_id"), queries, corpus, document_key)
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "retrieval_rank")
    ranked = (
        candidates.withColumnRenamed("rank", "retrieval_rank")
        .join(scores, ["query_id", "ticket_id"], "left")
        .withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top_k)
    )
    return cut_lineage(ranked, "reranked")  # so that all candidates are not shuffled beside the texts of the best


class Postings:
    """The terms of a text column and their statistics, stored in segments from ``base`` up to ``last``.

    A later segment's texts replace those of the same ids. It also holds by how much it changes the statistics, so
    these are summed and never counted anew, and neither are the texts.
    """

    def __init__(self, spark: SparkSession, path: str, base: int, last: int):
        self.spark, self.path = spark, path
        found = [int(n.removeprefix("segment=")) for n in folders(spark, f"{path}/changes") if n.startswith("segment=")]
        self.segments = sorted(n for n in found if base <= n <= last)

    def _read(self, kind: str) -> DataFrame:
        places = [f"{self.path}/{kind}/segment={n}" for n in self.segments]
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*places)

    def add(self, docs: DataFrame, text: str, segment: int) -> None:
        """Write ``docs`` (each ``ticket_id`` once) as a segment; one of that number that is there is replaced."""
        place = f"{self.path}/terms/segment={segment}"
        with shuffles_dropped(self.spark):
            document_terms(docs, text).write.mode("overwrite").parquet(place)
        new = self.spark.read.parquet(place)
        changes = term_statistics(new)
        if self.segments:
            gone = term_statistics(self.terms().join(new.select("ticket_id").distinct(), "ticket_id", "left_semi"))
            changes = changes.unionByName(gone.select("term", (-F.col("df")).alias("df"), (-F.col("dl")).alias("dl")))
        changes = changes.groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).filter("df <> 0 OR dl <> 0")
        with shuffles_dropped(self.spark):
            changes.write.mode("overwrite").parquet(f"{self.path}/changes/segment={segment}")

    def terms(self) -> DataFrame:
        """``document_terms`` of the texts as they are now."""
        stored = self._read("terms")
        if len(self.segments) > 1:
            last = stored.groupBy("ticket_id").agg(F.max("segment").alias("segment"))
            stored = stored.join(last, ["ticket_id", "segment"])
        return stored.drop("segment")

    def statistics(self) -> DataFrame:
        """``term_statistics`` of the texts as they are now."""
        return self._read("changes").groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).filter("df > 0")

    def score(self, pairs: DataFrame, queries: DataFrame, corpus: DataFrame, document_key: str = "resolution") -> DataFrame:
        """``bm25`` from what is stored; neither the corpus nor its column is read. The terms of the candidates only are."""
        wanted = pairs.select("ticket_id").distinct()
        terms = self.terms().filter("term IS NOT NULL").join(wanted, "ticket_id", "left_semi")
        return _scores(pairs, queries, terms, self.statistics())
