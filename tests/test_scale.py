"""What must not grow with the tables: texts in a model call, moves of a text, tasks of a training pass."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.operators import classify, hooks, rerank
from ticketlake.operators.features import TfidfVocabulary
from ticketlake.session import cut_lineage
from ticketlake.sources.tickets import tickets


def test_hooks_get_bounded_runs(spark):
    """An Arrow batch holds thousands of rows; a call gets a part of them, and all rows come back once."""

    def few_only(*texts):
        assert max(len(t) for t in texts) <= 1000
        return texts[0]

    df = spark.range(0, 5000, 1, 1).select(F.col("id").cast("string").alias("k"), F.repeat(F.lit("x"), F.col("id").cast("int") % 7).alias("t"))
    vectors = hooks.encode(df, "k", "t", lambda: lambda texts: np.array([[len(t), 1] for t in few_only(texts)]))
    assert {(r["k"], *r["vector"]) for r in vectors.collect()} == {(str(i), i % 7, 1) for i in range(5000)}
    pairs = df.select(F.col("k").alias("query_id"), F.col("k").alias("ticket_id"))
    scorer = hooks.pair_scorer(lambda: lambda queries, documents: [len(q) for q in few_only(queries, documents)])
    corpus = df.select(F.col("k").alias("ticket_id"), "t")
    scores = scorer(pairs, df.select(F.col("k").alias("query_id"), F.col("t").alias("query")), corpus, "t")
    assert {(r["query_id"], r["rerank_score"]) for r in scores.collect()} == {(str(i), i % 7) for i in range(5000)}
    answers = hooks.text_generator(lambda: lambda prompts: [p + "!" for p in few_only(prompts)])
    asked = df.select(F.col("k").alias("query_id"), F.col("t").alias("prompt"))
    assert {(r["query_id"], r["response"]) for r in answers(asked).collect()} == {(str(i), "x" * (i % 7) + "!") for i in range(5000)}


def test_scores_deal_out_no_terms_with_the_pairs(spark):
    """Pairs meet the terms of their documents where the queries are held; repeated pairs and queries count as often."""
    corpus = spark.createDataFrame([("T1", "red blue red"), ("T2", "green red"), ("T3", ""), (None, "red")], "ticket_id string, text string")
    queries = spark.createDataFrame([("a", "red blue"), ("b", "green"), ("c", "none"), (None, "red")], "query_id string, query string")
    pairs = [("a", "T1"), ("a", "T2"), ("a", "T2"), ("b", "T1"), ("b", "T2"), ("c", "T1"), (None, "T1"), ("a", None), ("a", "T9")]
    pairs = spark.createDataFrame(pairs, "query_id string, ticket_id string")
    scores = rerank.bm25(pairs, queries, corpus, "text")
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    # four texts of 6 words in all, one of them without an id; red is in three of them, blue and green in one
    idf = {"red": np.log(1 + 1.5 / 3.5), "blue": np.log(1 + 3.5 / 1.5), "green": np.log(1 + 3.5 / 1.5)}
    weight = lambda term, tf, dl: idf[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 1.5))
    want = {
        ("a", "T1"): round(weight("red", 2, 3) + weight("blue", 1, 3), 6),
        ("a", "T2"): round(2 * weight("red", 1, 2), 6),
        ("b", "T2"): round(weight("green", 1, 2), 6),
    }
    found = {(r["query_id"], r["ticket_id"]): r["rerank_score"] for r in scores.collect()}
    assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 2e-6 for x in want)
    twice = rerank.bm25(pairs, queries.unionByName(queries), corpus, "text").collect()
    assert {(r["query_id"], r["ticket_id"]) for r in twice} == want.keys()
    assert all(abs(r["rerank_score"] - 2 * found[r["query_id"], r["ticket_id"]]) < 4e-6 for r in twice)


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    written = cut_lineage(spark.range(20_000).repartition(40, "id"), "shuffled")
    for _ in range(20):
        if files() <= before:
            break
        time.sleep(0.5)
    assert files() <= before and written.count() == 20_000


def test_texts_of_tickets_move_once(spark, sf_dir):
    """Without broadcasts the texts are dealt by document, and once more to meet the passages."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tickets(spark, sf_dir).drop("resolution")._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    moves = [part for part in plan.split("\n\n") if ") Exchange" in part and "n_chars" not in part and " text#" in part.replace("[text#", "[ text#")]
    assert 1 <= len(moves) <= 2, moves


@pytest.mark.parametrize("balanced", [False, True])
def test_training_tasks_are_bounded(spark, monkeypatch, balanced):
    """Each task sends sums as large as the model in every iteration, so tasks follow the cores, not the rows."""
    seen = []

    class Watched(classify.Pipeline):
        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())
            return super().fit(rows)

    monkeypatch.setattr(classify, "Pipeline", Watched)
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 800, 1, 100).select(
        F.when(F.col("id") % 3 == 0, "vpn router").otherwise("mail inbox").alias("description"),
        F.when(F.col("id") % 3 == 0, "net").otherwise("mail").alias("category"),
    )
    words = TfidfVocabulary.fit(rows, "description")
    features = words.vectors(rows, "description").repartition(100)
    model = classify.TicketClassifier.fit(rows, "category", max_iter=3, balanced=balanced, words=words, features=features, rows_per_task=1)
    assert model.labels == ["mail", "net"]
    assert 1 <= seen[0] <= 4 * cores
