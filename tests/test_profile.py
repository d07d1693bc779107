import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticketlake.operators import clean, profile, sampling


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_min_length(spark):
    df = spark.createDataFrame([("",), ("x" * 10,), ("x" * 11,)], "description string")
    assert [len(r[0]) for r in rows(clean.longer_than(df))] == [11]


def test_dedup_keeps_the_first_in_order(spark):
    df = spark.createDataFrame([(5, "same text"), (2, "other"), (1, "same text")], "doc_id long, description string")
    assert sorted(rows(clean.drop_duplicate_text(df))) == [(1, "same text"), (2, "other")]


def test_clean_order_normalise_then_length_then_duplicates(spark):
    df = spark.createDataFrame(
        [(1, "s", "some  long text", None), (2, "s", " some long\ttext", "r"), (3, "s", "a          b", "r")],
        "doc_id long, subject string, description string, resolution string",
    ).withColumn("desc_length", F.lit(1))
    out = clean.clean_tickets(df)
    assert "desc_length" not in out.columns
    assert rows(out.select("doc_id", "description", "resolution")) == [(1, "some long text", "")]
    assert rows(clean.drop_counts(df)) == [(3, 1, 1, 1)]


def test_missing_counts_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (float("nan"), "x", "b")], "n double, s string, full string")
    assert rows(profile.missing_values(df)) == [("n", 1, 50.0), ("s", 1, 50.0)]


def test_histogram_of_one_value_and_maximum(spark):
    one = rows(profile.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 4))
    assert [r[2] for r in one] == [0, 0, 4, 0] and one[0][1] == 2.5
    edge = rows(profile.histogram(spark.createDataFrame([(0.0,), (5.0,), (4.9,)], "v double"), "v", 5))
    assert [r[2] for r in edge] == [1, 0, 0, 0, 2]


def test_month_without_tickets(spark):
    days = [datetime.datetime(2024, 1, 31), datetime.datetime(2024, 3, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d timestamp_ntz")
    assert rows(profile.monthly_counts(df, "d")) == [("2024-01-31", 1), ("2024-02-29", 0), ("2024-03-31", 1)]


def test_correlation_and_median_skip_nulls(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, None), ("g", 3.0, 6.0)], "g string, a double, b double")
    assert rows(profile.correlation(df, "a", "b")) == [(1.0, 2)]
    assert rows(profile.group_median(df, "g", "b")) == [("g", 4.0, 2)]
    assert rows(profile.correlation(df.limit(1), "a", "b"))[0][1] == 1


def test_describe_one_row(spark):
    out = profile.describe(spark.createDataFrame([(2.0,)], "v double"), "v").first()
    assert (out["count"], out["mean"], out["std"], out["p50"]) == (1, 2.0, None, 2.0)


def test_class_order_shows_missing_classes(spark):
    df = spark.createDataFrame([("b",), ("b",)], "k string")
    assert rows(profile.in_class_order(df, "k", ["a", "b"])) == [(1, "a", 0), (2, "b", 2)]


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1003).select(F.concat(F.lit("T"), "id").alias("ticket_id"), (F.col("id") % 3).alias("c"))
    first = sampling.split(df)
    assert first.filter("is_test").count() == 201
    again = sampling.split(df.repartition(5))
    assert first.exceptAll(again.select(*first.columns)).count() == 0
    by_class = sampling.split(df, by="c").filter("is_test").groupBy("c").count().collect()
    assert sorted((r["c"], r["count"]) for r in by_class) == [(0, 67), (1, 67), (2, 67)]
    share = sampling.split_by_threshold(df).filter("is_test").count() / 1003
    assert 0.15 < share < 0.25


def test_sample_is_bounded(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("ticket_id"))
    assert sampling.sample_rows(df, 10, 1).count() == 10
    assert sampling.sample_rows(df, 100, 1).count() == 50


def test_crosstab_of_odd_values(spark):
    df = spark.createDataFrame(
        [("a", "x.y"), ("a", "x.y"), ("b", "null"), (None, "z"), ("c", None), ("b", "`")], "r string, c string"
    )
    got = {(r["r"], r["c"]): r["n"] for r in profile.crosstab_long(df, "r", "c").collect()}
    assert got == {("a", "x.y"): 2, ("a", "null"): 0, ("a", "`"): 0, ("b", "x.y"): 0, ("b", "null"): 1, ("b", "`"): 1}


def test_describe_text_ties_and_nulls(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("b", None), ("a", "y")], "t string, u string")
    got = {r["column_name"]: tuple(r)[1:] for r in profile.describe_text(df, "t", "u").collect()}
    assert got == {"t": (4, 2, "a", 2), "u": (2, 2, "x", 1)}


def test_quantiles_of_skewed_groups(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.lognormal(0, 3, 999), "b": np.repeat([1.0, 5.0], [3, 4]), "c": np.array([7.0]), "d": rng.integers(0, 9, 500) * 1.0}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, v double")
    medians = {r["g"]: (r["median"], r["n"]) for r in profile.group_median(df, "g", "v").collect()}
    boxes = {r["g"]: r for r in profile.boxplot(df, "g", "v").collect()}
    for g, v in groups.items():
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        assert medians[g] == (pytest.approx(q2), len(v))
        assert (boxes[g]["q1"], boxes[g]["q3"]) == (pytest.approx(q1), pytest.approx(q3))


def test_no_outlier_gathers_the_values(spark):
    """One value of 1e300 among 300,000: the ranges that are put in order stay small, and the quartiles are exact."""
    rng = np.random.default_rng(4)
    values = np.r_[rng.normal(50, 5, 299_990), [1e300, -1e300, 0.0, -0.0, 5e-324, -5e-324, 1.0, -1.0, 2.0, 3.0]]
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "v": values}))
    per = profile.cut_lineage(profile._per_value(df, "g", "v"), "test-values")
    rows = per.select("g", "n", F.col("v").alias("_v"), profile._order_keys(F.col("v")).alias("_k"))
    keys = [r["_v"] for r in rows.orderBy("_k").select("_v").collect()]
    assert keys == sorted(keys)
    wanted, shift = profile._wanted_ranges(rows, "g", [0.25, 0.5, 0.75])
    largest = max(r["_values"] for r in wanted.collect())
    assert largest <= profile.ORDERED < 290_000 and shift < 52
    box = profile.boxplot(df, "g", "v").first()
    assert [box["q1"], box["median"], box["q3"]] == [pytest.approx(x, abs=1e-12) for x in np.quantile(values, [0.25, 0.5, 0.75])]


def test_quantiles_of_all_ranges(spark):
    """Values over the whole range of doubles, ties, and groups of one."""
    rng = np.random.default_rng(5)
    spread = rng.choice([-1, 1], 400) * 10.0 ** rng.uniform(-300, 300, 400)
    groups = {"spread": spread, "ties": np.repeat([-3.5, 0.0, 7.25], [5, 1, 5]), "one": np.array([-1e-310])}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, v double")
    for r in profile.boxplot(df, "g", "v").collect():
        assert [r["q1"], r["median"], r["q3"]] == [pytest.approx(x, rel=1e-12) for x in np.quantile(groups[r["g"]], [0.25, 0.5, 0.75])]


def test_dates_have_a_mean(spark):
    days = [datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2), datetime.datetime(2024, 1, 2, 1)]
    out = profile.describe_dates(spark.createDataFrame([(d,) for d in days], "d timestamp_ntz"), "d").first()
    assert (out["mean_date"], out["p50_date"]) == ("2024-01-01 16:20:00", "2024-01-02 00:00:00")


def test_crosstab_in_parts(spark, monkeypatch):
    monkeypatch.setattr(profile, "_PART_VALUES", 2)
    df = spark.createDataFrame([(str(i % 3), str(i % 7)) for i in range(9)], "r string, c string")
    got = {(r["r"], r["c"]): r["n"] for r in profile.crosstab_long(df, "r", "c").collect()}
    assert len(got) == 21 and sum(got.values()) == 9 and got["0", "6"] == 1
