"""Retrieval and classification quality as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HIT_KS = (1, 3, 5, 10)


def _r6(c):
    return F.round(c, 6)


# Retrieval: ``hits(query_id, rank, relevance)`` and ``queries(query_id)``. A query without hits
# or without a relevant hit counts as 0 in every mean.


def reciprocal_ranks(hits: DataFrame, queries: DataFrame) -> DataFrame:
    first = hits.filter("relevance = 1").groupBy("query_id").agg(F.min("rank").alias("first"))
    return (
        queries.select("query_id")
        .join(first, "query_id", "left")
        .select("query_id", _r6(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"))
    )


def mean_reciprocal_rank(hits: DataFrame, queries: DataFrame) -> DataFrame:
    first = hits.filter("relevance = 1").groupBy("query_id").agg(F.min("rank").alias("first"))
    return (
        queries.select("query_id")
        .join(first, "query_id", "left")
        .agg(_r6(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0)))).alias("mrr"), F.count("*").alias("n_queries"))
    )


def hit_rates(hits: DataFrame, queries: DataFrame, ks: tuple[int, ...] = HIT_KS) -> DataFrame:
    """Share of queries with a relevant hit among the first k."""
    first = hits.filter("relevance = 1").groupBy("query_id").agg(F.min("rank").alias("first"))
    rates = (
        queries.select("query_id")
        .join(first, "query_id", "left")
        .agg(*[_r6(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double"))).alias(str(k)) for k in ks])
    )
    return rates.unpivot([], [f"`{k}`" for k in ks], "k", "hit_rate").withColumn("k", F.col("k").cast("int"))


def _gain(rank: str):
    return F.col("relevance") / F.log2(F.col(rank) + 1.0)


def _gains(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """DCG of the first k hits and of the same hits in their best order, per query."""
    best = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank")
    per_query = (
        hits.filter(F.col("rank") <= k)
        .select("query_id", "rank", "relevance")
        .withColumn("best_rank", F.row_number().over(best))
        .groupBy("query_id")
        .agg(F.sum(_gain("rank")).alias("dcg"), F.sum(_gain("best_rank")).alias("ideal"))
    )
    return queries.select("query_id").join(per_query, "query_id", "left")


def dcg(hits: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    return _gains(hits, queries, k).select("query_id", _r6(F.coalesce("dcg", F.lit(0.0))).alias("dcg"))


def ndcg(hits: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """DCG over the DCG of the retrieved list itself in its best order; 0 when that is 0."""
    ratio = F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0))
    return _gains(hits, queries, k).select("query_id", _r6(ratio).alias("ndcg"))


def retrieval_summary(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """MRR, NDCG and hit rates in one pass over the hits, as ``(metric, value)`` rows."""
    best = {k: Window.partitionBy("query_id", F.col("rank") <= k).orderBy(F.desc("relevance"), "rank") for k in (5, 10)}
    ranked = hits.select("query_id", "rank", "relevance").withColumns(
        {f"best_{k}": F.row_number().over(w) for k, w in best.items()}
    )
    aggregates = [F.min(F.when(F.col("relevance") == 1, F.col("rank"))).alias("first")]
    for k in best:
        inside = F.col("rank") <= k
        aggregates.append(F.sum(F.when(inside, _gain("rank"))).alias(f"dcg_{k}"))
        aggregates.append(F.sum(F.when(inside, _gain(f"best_{k}"))).alias(f"ideal_{k}"))
    per_query = queries.select("query_id").join(ranked.groupBy("query_id").agg(*aggregates), "query_id", "left")
    values = {"MRR@10": F.coalesce(1.0 / F.col("first"), F.lit(0.0))}
    for k in best:
        values[f"NDCG@{k}"] = F.coalesce(F.try_divide(f"dcg_{k}", f"ideal_{k}"), F.lit(0.0))
    for k in (1, 5, 10):
        values[f"Hit@{k}"] = F.coalesce(F.col("first") <= k, F.lit(False)).cast("double")
    means = per_query.agg(*[_r6(F.avg(v)).alias(name) for name, v in values.items()])
    return means.unpivot([], [f"`{name}`" for name in values], "metric", "value")


def mean_present(df: DataFrame, *columns: str) -> DataFrame:
    """Mean of each column over the values that are neither null nor NaN."""
    means = df.agg(
        *[_r6(F.avg(F.when(~F.isnan(c), F.col(c)))).alias(c) for c in columns],
    )
    return means.unpivot([], list(columns), "metric", "value")


# Classification: ``predictions(truth, prediction)``.


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("truth", "prediction").agg(F.count("*").alias("n"))


def accuracy(predictions: DataFrame) -> DataFrame:
    right = (F.col("truth") == F.col("prediction")).cast("double")
    return predictions.agg(_r6(F.avg(right)).alias("accuracy"), F.count("*").alias("n"))


def class_scores(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as truth or prediction; undefined is 0.

    Works on the confusion counts, so the rows are read once and reduced on the map side.
    """
    cells = confusion(predictions).select(
        F.explode(
            F.array(
                F.struct(
                    F.col("truth").alias("label"),
                    F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.col("n").alias("support"),
                ),
                F.struct(
                    F.col("prediction").alias("label"),
                    F.lit(0).cast("bigint").alias("tp"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("support"),
                ),
            )
        ).alias("c")
    )
    zero = F.lit(0.0)
    return (
        cells.groupBy("c.label")
        .agg(F.sum("c.tp").alias("tp"), F.sum("c.predicted").alias("predicted"), F.sum("c.support").alias("support"))
        .withColumn("precision", F.coalesce(F.try_divide("tp", "predicted"), zero))
        .withColumn("recall", F.coalesce(F.try_divide("tp", "support"), zero))
        .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("support")), zero))
    )


def weighted_f1(predictions: DataFrame) -> DataFrame:
    return class_scores(predictions).agg(
        _r6(F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted")
    )


def report(predictions: DataFrame) -> DataFrame:
    """Rows per class, then accuracy, macro average and weighted average."""
    scores = class_scores(predictions)
    names = ["precision", "recall", "f1"]
    classes = scores.select("label", *[_r6(F.col(c)).alias(c) for c in names], "support")
    total = F.sum("support").alias("support")
    right = _r6(F.sum("tp") / F.sum("support"))
    rows = [
        classes,
        scores.agg(*[right.alias(c) for c in names], total).select(F.lit("accuracy").alias("label"), *names, "support"),
        scores.agg(*[_r6(F.avg(c)).alias(c) for c in names], total).select(
            F.lit("macro avg").alias("label"), *names, "support"
        ),
        scores.agg(
            *[_r6(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], total
        ).select(F.lit("weighted avg").alias("label"), *names, "support"),
    ]
    return reduce(DataFrame.unionByName, rows)


def compare_models(predictions: DataFrame) -> DataFrame:
    """Accuracy and weighted F1 by model and target, with the lead over the weakest F1 of the target.

    ``predictions(model, target, truth, prediction)``.
    """
    keys = ["model", "target"]
    cells = predictions.groupBy(*keys, "truth", "prediction").agg(F.count("*").alias("n"))
    truth_side = cells.select(
        *keys,
        F.col("truth").alias("label"),
        F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"),
        F.lit(0).cast("bigint").alias("predicted"),
        F.col("n").alias("support"),
    )
    prediction_side = cells.select(
        *keys,
        F.col("prediction").alias("label"),
        F.lit(0).cast("bigint").alias("tp"),
        F.col("n").alias("predicted"),
        F.lit(0).cast("bigint").alias("support"),
    )
    by_class = (
        truth_side.unionByName(prediction_side)
        .groupBy(*keys, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("support")), F.lit(0.0))
    by_model = by_class.groupBy(*keys).agg(
        _r6(F.sum("tp") / F.sum("support")).alias("accuracy"),
        _r6(F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )
    weakest = F.min("f1_weighted").over(Window.partitionBy("target"))
    return by_model.withColumn("f1_lead", _r6(F.col("f1_weighted") - weakest))
