import math

import pytest

from ticketlake.operators import assemble, metrics
from ticketlake.operators import rerank as rr


@pytest.fixture(scope="module")
def flags(spark):
    lists = {"none": [0, 0], "third": [0, 0, 1], "all": [1, 1, 1], "mixed": [0, 1, 0, 1]}
    rows = [(q, rank, rel) for q, rels in lists.items() for rank, rel in enumerate(rels, 1)]
    hits = spark.createDataFrame(rows, "query_id string, rank int, relevance int")
    queries = spark.createDataFrame([(q,) for q in [*lists, "no hits"]], "query_id string")
    return hits, queries


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_reciprocal_rank(flags):
    rr_ = values(metrics.reciprocal_ranks(*flags), "query_id", "reciprocal_rank")
    assert rr_ == {"none": 0, "third": 0.333333, "all": 1, "mixed": 0.5, "no hits": 0}
    row = metrics.mean_reciprocal_rank(*flags).first()
    assert row["n_queries"] == 5 and row["mrr"] == round((1 / 3 + 1 + 0.5) / 5, 6)


def test_hit_rate_is_monotone(flags):
    rates = values(metrics.hit_rates(*flags), "k", "hit_rate")
    assert rates == {1: 0.2, 3: 0.6, 5: 0.6, 10: 0.6}


def test_ndcg_uses_the_retrieved_list(flags):
    scores = values(metrics.ndcg(*flags, k=10), "query_id", "ndcg")
    mixed = (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3))
    assert scores == {"none": 0, "third": 0.5, "all": 1, "mixed": round(mixed, 6), "no hits": 0}
    cut = values(metrics.ndcg(*flags, k=2), "query_id", "ndcg")
    assert cut["third"] == 0 and cut["mixed"] == round(1 / math.log2(3), 6)


def test_summary_agrees_with_the_parts(flags):
    summary = values(metrics.retrieval_summary(*flags), "metric", "value")
    assert summary["MRR@10"] == metrics.mean_reciprocal_rank(*flags).first()["mrr"]
    per_query = values(metrics.ndcg(*flags, k=5), "query_id", "ndcg")
    assert abs(summary["NDCG@5"] - sum(per_query.values()) / 5) < 1e-5
    assert summary["Hit@5"] == 0.6


def test_report_with_classes_on_one_side_only(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("never predicted", "a"), ("b", "never true")]
    predictions = spark.createDataFrame(pairs, "truth string, prediction string")
    rows = {r["label"]: r for r in metrics.report(predictions).collect()}
    assert rows["never predicted"]["f1"] == 0 and rows["never predicted"]["support"] == 1
    assert rows["never true"]["recall"] == 0 and rows["never true"]["support"] == 0
    assert rows["accuracy"]["f1"] == 0.4
    assert metrics.accuracy(predictions).first()["accuracy"] == 0.4
    weighted = metrics.weighted_f1(predictions).first()["f1_weighted"]
    assert weighted == rows["weighted avg"]["f1"] == 0.4
    one = spark.createDataFrame([("a", "a")], "truth string, prediction string")
    assert {r["f1"] for r in metrics.report(one).collect()} == {1.0}


def test_mean_skips_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,)], "faithfulness double")
    assert metrics.mean_present(df, "faithfulness").first()["value"] == 1.5
    assert metrics.mean_present(df.filter("isnan(faithfulness)"), "faithfulness").first()["value"] is None


def test_rerank_keeps_order_of_equal_scores_and_unmatched_pairs(spark):
    corpus = spark.createDataFrame(
        [("T1", "nothing shared"), ("T2", ""), ("T3", "reset the vpn"), ("T4", "reset the vpn")],
        "ticket_id string, resolution string",
    )
    queries = spark.createDataFrame([("q", "VPN reset"), ("e", "x")], "query_id string, query string")
    candidates = spark.createDataFrame([("q", f"T{i}", i) for i in range(1, 5)], "query_id string, ticket_id string, rank int")
    out = rr.rerank(candidates, queries, corpus, 4).orderBy("rank").collect()
    assert [r["ticket_id"] for r in out] == ["T3", "T4", "T1", "T2"]
    assert out[2]["rerank_score"] == 0 and out[0]["rerank_score"] == out[1]["rerank_score"] > 0
    # df 2 of 4 documents, 3 words against a mean of 2
    expected = 2 * math.log(1 + 2.5 / 2.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / 2))
    assert out[0]["rerank_score"] == round(expected, 6)
    assert rr.rerank(candidates.filter("false"), queries, corpus, 4).count() == 0


def test_unknown_generator(spark):
    with pytest.raises(ValueError, match="unknown generator"):
        assemble.generator("no such model")


def test_query_without_sources_keeps_its_row(spark):
    queries = spark.createDataFrame([("q", "help {context}", [0.0])], "query_id string, query string, vector array<float>")
    corpus = spark.createDataFrame(
        [], "ticket_id string, vector array<float>, resolution string, subject string, category string, sub_category string, priority string"
    )
    row = assemble.resolve(queries, corpus).first()
    assert row["sources"] == [] and row["response"] == ""
    assert "Here are 0 similar" in row["prompt"] and "New ticket: help {context}\n" in row["prompt"]
