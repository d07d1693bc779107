"""Profiling of a ticket table: counts, descriptions, distributions, checks.

Every grouped result is pre-aggregated on the map side. Exact quantiles run over
``(group, value, count)`` rows and order only the values near the wanted ranks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake.session import cut_lineage

_QUARTILES = [0.25, 0.5, 0.75]
_SHIFTS = (52, 40, 28, 16, 4, 0)  # what is left of a 64-bit key below the digits read so far
ORDERED = 65_536  # different values that one task puts in order
_PART_VALUES = 10_000  # column values of a cross-tabulation that meet the row values together


def _r6(c: Column) -> Column:
    return F.round(c, 6)


def _is_missing(df: DataFrame, name: str) -> Column:
    missing = F.col(name).isNull()
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(name)
    return missing


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with nulls: how many and what share, most first; one pass."""
    counts = df.agg(
        F.count("*").alias("n_rows"), *[F.count_if(_is_missing(df, c)).alias(c) for c in df.columns]
    )
    return (
        counts.unpivot("n_rows", df.columns, "column_name", "missing_count")
        .filter("missing_count > 0")
        .select(
            "column_name",
            "missing_count",
            F.round(100.0 * F.col("missing_count") / F.col("n_rows"), 2).alias("missing_pct"),
        )
        .orderBy(F.desc("missing_count"), "column_name")
    )


def value_counts(df: DataFrame, *columns: str, top: int | None = None) -> DataFrame:
    """Rows per value, most first, nulls left out; ties by value."""
    out = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n"))
    out = out.orderBy(F.desc("n"), *columns)
    return out.limit(top) if top else out


def majority_baseline(df: DataFrame, column: str) -> DataFrame:
    """The largest class and its share: the accuracy of always predicting it."""
    counts = df.dropna(subset=[column]).groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(
        F.max_by(column, F.struct("n", column)).alias("label"),
        _r6(F.max("n") / F.sum("n")).alias("accuracy"),
    )


def share(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """How many rows meet a condition, and as a percentage of all rows."""
    return df.agg(
        F.count_if(condition).alias(f"n_{name}"),
        F.count("*").alias("n_total"),
        _r6(100.0 * F.count_if(condition) / F.count("*")).alias(f"pct_{name}"),
    )


def in_class_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Counts for each class of a fixed order; a class without rows shows 0."""
    spark = df.sparkSession
    classes = spark.createDataFrame(list(enumerate(order, 1)), f"position int, {column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return (
        classes.join(counts, column, "left")
        .select("position", column, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
        .orderBy("position")
    )


def crosstab(df: DataFrame, rows: str, columns: str, order: list[str] | None = None) -> DataFrame:
    """Counts of one column against another, zero where they never meet.

    Without ``order`` Spark lists the column values itself and refuses too many of them.
    """
    return df.groupBy(rows).pivot(columns, order).agg(F.count(F.lit(1))).na.fill(0)


def crosstab_long(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """The same as one row per cell, for columns with any number of values; nulls are not counted.

    No value becomes a column name. The zero cells are the feature: every row value meets every column value.
    """
    present = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    counts = cut_lineage(present.groupBy(rows, columns).agg(F.count("*").alias("n")), "cells")
    # the column values come in parts of bounded size, and each row value meets every part
    parts = 1 + counts.select(F.count_distinct(columns)).first()[0] // _PART_VALUES
    heads = counts.select(columns).distinct().withColumn("_part", F.pmod(F.xxhash64(columns), F.lit(parts)).cast("int"))
    asked = counts.select(rows).distinct().withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cells = asked.join(heads, "_part").drop("_part")
    return cells.join(counts, [rows, columns], "left").select(rows, columns, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def _per_value(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.filter(~_is_missing(df, value)).groupBy(group, value).agg(F.count("*").alias("n"))


def _order_keys(values: Column) -> Column:
    """A long for each double, in the same order: the bits of the number, the others turned round below zero."""

    @F.arrow_udf("long")
    def keys(v: pa.Array) -> pa.Array:
        bits = v.to_numpy(zero_copy_only=False).view(np.int64)
        return pa.array(bits ^ ((bits >> 63) & np.int64(2**63 - 1)))

    return keys(values)


def _wanted_ranges(rows: DataFrame, group: str, shares: list[float]) -> tuple[DataFrame, int]:
    """For each wanted rank of each group, the keys among which it lies: those of one ``_prefix`` above ``shift`` bits.

    ``rows(group, n, _v, _k)``. A round reads twelve more bits of the keys, of those only that still may hold a wanted
    rank, and counts them; six rounds reach the last bit, whatever the values are. It ends when no range has more
    than ``ORDERED`` different values.
    """
    places = [(F.col("_total") - 1) * F.lit(s) for s in shares]
    ranks = F.array(*[F.struct(F.lit(i).alias("_i"), up(x).cast("long").alias("_r")) for i, x in enumerate(places) for up in (F.floor, F.ceil)])
    totals = rows.groupBy(group).agg(F.sum("n").alias("_total"))
    wanted = totals.select(group, "_total", F.inline(F.array_distinct(ranks)), F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_before"))
    above = None
    for shift in _SHIFTS:
        prefix = F.lit(0).cast("long") if above is None else F.shiftright("_k", above)
        left = rows.withColumn("_prefix", prefix)
        if above is not None:
            left = left.join(wanted.select(group, "_prefix").distinct(), [group, "_prefix"])
        counts = left.groupBy(group, "_prefix", F.shiftright("_k", shift).alias("_next")).agg(
            F.sum("n").alias("_in"), F.count("*").alias("_values")
        )
        inside = Window.partitionBy(group, "_prefix").orderBy("_next")  # 4,096 rows at most
        counts = counts.withColumn("_first", F.sum("_in").over(inside) - F.col("_in"))
        start = F.col("_before") + F.col("_first")
        hit = (start <= F.col("_r")) & (F.col("_r") < start + F.col("_in"))
        found = wanted.drop("_values").join(counts, [group, "_prefix"]).filter(hit)
        found = found.select(group, "_total", "_i", "_r", F.col("_next").alias("_prefix"), start.alias("_before"), "_values")
        wanted, above = cut_lineage(found, "ranges"), shift
        if (wanted.agg(F.max("_values")).first()[0] or 0) <= ORDERED:
            break
    return wanted, above


def _quantiles(per: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """``group, q``: exact, linearly interpolated quantiles of ``per(group, value, n)``, a written table.

    Only the values near the wanted ranks are put in order, ``ORDERED`` at most in one place, however they are spread.
    """
    v = F.col(value).cast("double")
    rows = cut_lineage(per.select(group, "n", v.alias("_v"), _order_keys(v).alias("_k")), "ordered-values")
    wanted, shift = _wanted_ranges(rows, group, shares)
    ranges = wanted.select(group, "_prefix", "_before").distinct()
    inside = Window.partitionBy(group, "_prefix").orderBy("_k")
    ordered = rows.withColumn("_prefix", F.shiftright("_k", shift)).join(ranges, [group, "_prefix"])
    ordered = ordered.withColumn("_from", F.col("_before") + F.sum("n").over(inside) - F.col("n")).drop("_before")
    found = ordered.join(wanted.drop("_before", "_values"), [group, "_prefix"]).filter(
        (F.col("_from") <= F.col("_r")) & (F.col("_r") < F.col("_from") + F.col("n"))
    )
    place = (F.col("_total") - 1) * F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("_i") + 1)
    low = F.min(F.struct("_r", "_v"))["_v"]
    high = F.max(F.struct("_r", "_v"))["_v"]
    part = F.max(place - F.floor(place))
    each = found.groupBy(group, "_i").agg((low + (high - low) * part).alias("q"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "q"))), lambda x: x["q"]).alias("q"))


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles, maximum of numeric columns."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "v"
    )
    per = cut_lineage(_per_value(long, "column_name", "v"), "value-counts")
    stats = per.groupBy("column_name").agg(
        F.sum("n").alias("count"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    ).join(_quantiles(per, "column_name", "v", _QUARTILES), "column_name")
    # second moment about the mean, from the same pre-aggregated rows
    deviation = (
        per.join(stats.select("column_name", "mean", "count"), "column_name")
        .groupBy("column_name")
        .agg(F.sum(F.col("n") * F.pow(F.col("v") - F.col("mean"), 2)).alias("ss"))
    )
    return stats.join(deviation, "column_name").select(
        "column_name",
        "count",
        _r6(F.col("mean")).alias("mean"),
        _r6(F.sqrt(F.try_divide("ss", F.col("count") - 1))).alias("std"),
        "min",
        F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"),
        "max",
    )


def describe_text(df: DataFrame, *columns: str, digests: DataFrame | None = None) -> DataFrame:
    """Count, distinct values, the most common value and its frequency; ties by value.

    Digests are counted, so long texts are not shuffled; only the texts of a column's most frequent digests
    are compared, and within a digest there is one text. ``digests`` are those of the columns, if they are there.
    """
    if digests is None:
        digests = df.select(*[F.sha2(c, 256).alias(c) for c in columns])
    long = digests.select(*columns).unpivot([], list(columns), "column_name", "d").filter(F.col("d").isNotNull())
    per = cut_lineage(long.groupBy("column_name", "d").agg(F.count("*").alias("n")), "digests")
    stats = per.groupBy("column_name").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"), F.max("n").alias("freq")
    )
    often = per.join(stats.select("column_name", F.col("freq").alias("n")), ["column_name", "n"]).select("column_name", "d")
    texts = df.select(*columns).unpivot([], list(columns), "column_name", "v").filter(F.col("v").isNotNull())
    texts = texts.withColumn("d", F.sha2("v", 256)).join(often, ["column_name", "d"])
    top = texts.groupBy("column_name").agg(F.min("v").alias("top"))
    return stats.join(top, "column_name").select("column_name", "count", "unique", "top", "freq")


def describe_dates(df: DataFrame, *columns: str) -> DataFrame:
    """Count, mean, minimum, exact quartiles and maximum of date columns, as text to the second."""
    seconds = [F.unix_seconds(F.col(c).cast("timestamp")).cast("double").alias(c) for c in columns]
    shown = lambda c: F.date_format(F.timestamp_seconds(F.floor(c)), "yyyy-MM-dd HH:mm:ss")
    numbers = describe(df.select(*seconds), *columns)
    parts = ("mean", "min", "p25", "p50", "p75", "max")
    return numbers.select("column_name", "count", *(shown(c).alias(f"{c}_date") for c in parts))


def describe_all(df: DataFrame) -> DataFrame:
    """All descriptions in one table, unfilled statistics null.

    Digests, numbers and dates are written once, and all passes but that for the most common texts read these.
    """
    of = lambda *kinds: [f.name for f in df.schema if isinstance(f.dataType, kinds)]
    text, number = of(T.StringType), of(T.NumericType)
    date = of(T.TimestampNTZType, T.TimestampType, T.DateType)
    narrow = cut_lineage(df.select(*[F.sha2(c, 256).alias(c) for c in text], *number, *date), "described")
    texts = describe_text(df, *text, digests=narrow)
    numbers, dates = describe(narrow, *number), describe_dates(narrow, *date)
    return texts.unionByName(numbers, allowMissingColumns=True).unionByName(dates, allowMissingColumns=True)


def table_info(df: DataFrame) -> DataFrame:
    """Position, name, type and non-null count of each column, with the row count."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(c) for c in df.columns])
    types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    names = F.array(*[F.lit(c) for c in df.columns])
    return counts.unpivot("n_rows", df.columns, "column_name", "non_null").select(
        F.array_position(names, F.col("column_name")).alias("position"),
        "column_name",
        types[F.col("column_name")].alias("dtype"),
        "non_null",
        "n_rows",
    )


def group_median(df: DataFrame, group: str, value: str) -> DataFrame:
    per = cut_lineage(_per_value(df, group, value), "value-counts")
    middle = _quantiles(per, group, value, [0.5]).select(group, F.col("q")[0].alias("median"))
    return middle.join(per.groupBy(group).agg(F.sum("n").alias("n")), group)


def group_mean(df: DataFrame, group: str, value: str) -> DataFrame:
    return (
        df.filter(~_is_missing(df, value))
        .groupBy(group)
        .agg(_r6(F.avg(value)).alias("mean"), F.count("*").alias("n"))
        .orderBy("mean", group)
    )


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation over the rows where both are present."""
    pairs = df.filter(~_is_missing(df, a) & ~_is_missing(df, b))
    return pairs.agg(_r6(F.corr(a, b)).alias("pearson_r"), F.count("*").alias("n"))


def monthly_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per month under the month's last day; months without rows show 0."""
    counts = df.dropna(subset=[column]).groupBy(F.last_day(column).alias("m")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    months = span.select(
        F.explode(F.expr("sequence(trunc(lo, 'MM'), trunc(hi, 'MM'), interval 1 month)")).alias("first")
    ).select(F.last_day("first").alias("m"))
    return (
        months.join(counts, "m", "left")
        .select(F.date_format("m", "yyyy-MM-dd").alias("month_end"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
        .orderBy("month_end")
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum falls in the last bin.

    One distinct value gets a range of width 1 around it.
    """
    per = df.filter(~_is_missing(df, column)).groupBy(F.col(column).cast("double").alias("v"))
    per = cut_lineage(per.agg(F.count("*").alias("n")), "value-counts")
    span = per.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo IS NOT NULL")
    pad = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    edges = span.select((F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi")).withColumn(
        "width", (F.col("hi") - F.col("lo")) / bins
    )
    lo = edges.select("lo").scalar()
    width = edges.select("width").scalar()
    filled = (
        per.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / width).cast("int")))
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
    )
    return (
        edges.select("lo", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .join(filled, "bin", "left")
        .select(
            "bin",
            _r6(F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
            F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        )
        .orderBy("bin")
    )


def boxplot(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, outlier count, by group."""
    per = cut_lineage(_per_value(df, group, value), "value-counts")
    q = _quantiles(per, group, value, _QUARTILES)
    fences = q.select(
        group,
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
        (F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0])).alias("lo"),
        (F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])).alias("hi"),
    )
    v = F.col(value).cast("double")
    inside = v.between(F.col("lo"), F.col("hi"))
    return (
        per.join(fences, group)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
            F.sum("n").alias("n"),
        )
    )


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return df.agg(count.alias("n_distinct"))


def nesting(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Parents per child; a child with more than one is not nested."""
    return (
        df.groupBy(child)
        .agg(F.count_distinct(parent).alias("n_parents"))
        .withColumn("nested", F.col("n_parents") <= 1)
    )


def keyword_leakage(df: DataFrame, text: str, label: str) -> DataFrame:
    """Share of each label's texts that contain the label's own name."""
    has = F.contains(F.lower(text), F.lower(label))
    return df.groupBy(label).agg(F.count("*").alias("n"), _r6(F.avg(has.cast("double"))).alias("leakage"))


def coverage(df: DataFrame, size: Column, limits: list[int]) -> DataFrame:
    """Share of rows whose size is within each limit."""
    counts = df.select(size.alias("size")).agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col("size") <= n).alias(str(n)) for n in limits]
    )
    return counts.unpivot("n_rows", [f"`{n}`" for n in limits], "size_limit", "n_within").select(
        F.col("size_limit").cast("int").alias("size_limit"),
        "n_within",
        _r6(F.try_divide("n_within", "n_rows")).alias("covered"),
    )
