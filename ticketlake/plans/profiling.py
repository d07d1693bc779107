"""Queries that load, profile, clean and sample the ticket table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlake.functions import text as tx
from ticketlake.operators import clean, profile, sampling
from ticketlake.plans.registry import TICKETS, clean_sql, query, tokens_sql
from ticketlake.schema import DATE_FORMAT, OPEN_STATUSES, PRIORITY_ORDER, TICKET
from ticketlake.sources.tickets import load_corpus, tickets

ALL_COLUMNS = TICKET.fieldNames()
TEXT_COLUMNS = [f.name for f in TICKET if f.dataType.simpleString() == "string"]
NUMBER_COLUMNS = ["satisfaction_rating", "time_to_resolution_hours"]
DATE_COLUMNS = ["created_date", "resolved_date"]

TICKET_ROWS_SQL = """SELECT ticket_id, strftime(created_date, '%Y-%m-%d %H:%M') AS created_date,
  strftime(resolved_date, '%Y-%m-%d %H:%M') AS resolved_date, category, sub_category, priority, status,
  subject, description, resolution, product_service, department, satisfaction_rating,
  time_to_resolution_hours FROM """


def printable(df):
    """Dates as minute text, so both engines hash the same values."""
    return df.withColumns({c: F.date_format(c, DATE_FORMAT) for c in ("created_date", "resolved_date")})


CLEAN_CTE = f""", normal AS (
  SELECT * REPLACE ({clean_sql('subject')} AS subject, {clean_sql('description')} AS description,
    {clean_sql('resolution')} AS resolution) FROM tickets),
ranked AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY doc_id) AS occurrence
  FROM normal WHERE length(description) > 10),
clean AS (SELECT * EXCLUDE (occurrence) FROM ranked WHERE occurrence = 1)
"""


@query("load_corpus", TICKETS + TICKET_ROWS_SQL + "tickets WHERE status IN ('Closed', 'Resolved')")
def _(spark, d):
    return tickets(spark, d, *ALL_COLUMNS).transform(load_corpus).transform(printable)


@query(
    "filter_open_tickets",
    TICKETS + "SELECT ticket_id, status, priority FROM tickets WHERE status IN ('Open', 'In Progress', 'Pending')",
)
def _(spark, d):
    return tickets(spark, d, "ticket_id", "status", "priority").filter(F.col("status").isin(OPEN_STATUSES))


@query(
    "filter_resolved_text",
    TICKETS
    + """SELECT ticket_id, resolution, time_to_resolution_hours FROM tickets
    WHERE resolution IS NOT NULL AND resolution <> '' AND time_to_resolution_hours IS NOT NULL""",
)
def _(spark, d):
    return tickets(spark, d, "ticket_id", "resolution", "time_to_resolution_hours").filter(
        F.col("resolution").isNotNull()
        & (F.col("resolution") != "")
        & F.col("time_to_resolution_hours").isNotNull()
    )


@query(
    "clean_min_length",
    TICKETS + f", c AS (SELECT ticket_id, {clean_sql('description')} AS description FROM tickets) "
    "SELECT ticket_id, length(description) AS n_chars FROM c WHERE length(description) > 10",
)
def _(spark, d):
    df = clean.clean_columns(tickets(spark, d, "ticket_id", "description"), ["description"])
    return clean.longer_than(df).select("ticket_id", F.length("description").alias("n_chars"))


@query(
    "clean_text",
    TICKETS
    + f"""SELECT ticket_id, {clean_sql('subject')} AS subject, {clean_sql('description')} AS description,
    {clean_sql('resolution')} AS resolution FROM tickets""",
)
def _(spark, d):
    return clean.clean_columns(tickets(spark, d, "ticket_id", "subject", "description", "resolution"))


@query(
    "dedup_description",
    TICKETS
    + """, r AS (SELECT ticket_id, doc_id, description,
      row_number() OVER (PARTITION BY description ORDER BY doc_id) AS occurrence FROM tickets)
    SELECT ticket_id, doc_id, description FROM r WHERE occurrence = 1""",
)
def _(spark, d):
    return clean.drop_duplicate_text(tickets(spark, d, "ticket_id", "doc_id", "description"))


@query("clean_tickets", TICKETS + CLEAN_CTE + TICKET_ROWS_SQL + "clean")
def _(spark, d):
    return (
        tickets(spark, d, "doc_id", *ALL_COLUMNS).transform(clean.clean_tickets).drop("doc_id").transform(printable)
    )


@query(
    "clean_drop_counts",
    TICKETS
    + CLEAN_CTE
    + """SELECT (SELECT count(*) FROM normal) AS n_before,
    (SELECT count(*) FROM normal WHERE length(description) <= 10) AS n_short,
    (SELECT count(*) FROM ranked WHERE occurrence > 1) AS n_duplicate,
    (SELECT count(*) FROM clean) AS n_final""",
)
def _(spark, d):
    return clean.drop_counts(tickets(spark, d, "description"))


_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS missing_count, count(*) AS n FROM tickets"
    for c in ALL_COLUMNS
)


@query(
    "missing_values",
    TICKETS
    + f""", m AS ({_MISSING_SQL}) SELECT column_name, cast(missing_count AS bigint) AS missing_count,
    round(100.0e0 * missing_count / n, 2) AS missing_pct FROM m WHERE missing_count > 0""",
)
def _(spark, d):
    return profile.missing_values(tickets(spark, d, *ALL_COLUMNS))


def _count_query(name: str, column: str) -> None:
    sql = TICKETS + f"SELECT {column}, count(*) AS n FROM tickets WHERE {column} IS NOT NULL GROUP BY {column}"
    query(name, sql)(lambda spark, d: profile.value_counts(tickets(spark, d, column), column))


_count_query("count_category", "category")
_count_query("count_status", "status")
_count_query("count_rating", "satisfaction_rating")
_count_query("count_department", "department")


@query(
    "majority_baseline",
    TICKETS
    + """, c AS (SELECT priority, count(*) AS n FROM tickets GROUP BY priority)
    SELECT arg_max(priority, struct_pack(n := n, p := priority)) AS label, round(max(n) / sum(n), 6) AS accuracy
    FROM c""",
)
def _(spark, d):
    return profile.majority_baseline(tickets(spark, d, "priority"), "priority")


@query(
    "count_cat_sub_pri",
    TICKETS
    + """SELECT category, sub_category, priority, count(*) AS n FROM tickets
    GROUP BY category, sub_category, priority ORDER BY n DESC, category, sub_category, priority LIMIT 10""",
)
def _(spark, d):
    df = tickets(spark, d, "category", "sub_category", "priority")
    return profile.value_counts(df, "category", "sub_category", "priority", top=10)


@query(
    "open_share",
    TICKETS
    + """SELECT cast(count_if(status IN ('Open', 'In Progress', 'Pending')) AS bigint) AS n_open, count(*) AS n_total,
    round(100.0e0 * count_if(status IN ('Open', 'In Progress', 'Pending')) / count(*), 6) AS pct_open FROM tickets""",
)
def _(spark, d):
    return profile.share(tickets(spark, d, "status"), F.col("status").isin(OPEN_STATUSES), "open")


_ORDER_SQL = "(VALUES (1, 'Critical'), (2, 'High'), (3, 'Medium'), (4, 'Low')) AS o(position, priority)"


@query(
    "priority_distribution",
    TICKETS
    + f"""SELECT o.position, o.priority, count(t.ticket_id) AS n FROM {_ORDER_SQL}
    LEFT JOIN tickets t ON t.priority = o.priority GROUP BY o.position, o.priority""",
)
def _(spark, d):
    return profile.in_class_order(tickets(spark, d, "priority"), "priority", PRIORITY_ORDER)


@query(
    "crosstab_cat_priority",
    TICKETS
    + "SELECT category, "
    + ", ".join(f'cast(count_if(priority = \'{p}\') AS bigint) AS "{p}"' for p in PRIORITY_ORDER)
    + " FROM tickets GROUP BY category",
)
def _(spark, d):
    return profile.crosstab(tickets(spark, d, "category", "priority"), "category", "priority", PRIORITY_ORDER)


@query(
    "crosstab_cat_sub",
    TICKETS
    + """, c AS (SELECT DISTINCT category FROM tickets), s AS (SELECT DISTINCT sub_category FROM tickets),
    n AS (SELECT category, sub_category, count(*) AS n FROM tickets GROUP BY category, sub_category)
    SELECT s.sub_category, c.category, coalesce(n.n, 0) AS n FROM s CROSS JOIN c
    LEFT JOIN n ON n.category = c.category AND n.sub_category = s.sub_category""",
)
def _(spark, d):
    return profile.crosstab_long(tickets(spark, d, "category", "sub_category"), "sub_category", "category")


def describe_sql(column: str, source: str = "tickets", name: str | None = None) -> str:
    return f"""SELECT '{name or column}' AS column_name, count({column}) AS "count",
    round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std,
    cast(min({column}) AS double) AS min, cast(quantile_cont({column}, 0.25) AS double) AS p25,
    cast(quantile_cont({column}, 0.5) AS double) AS p50, cast(quantile_cont({column}, 0.75) AS double) AS p75,
    cast(max({column}) AS double) AS max FROM {source}"""


LENGTHS_CTE = """, lengths AS (SELECT ticket_id, category, length(coalesce(description, '')) AS desc_length,
  length(coalesce(resolution, '')) AS resolution_length, resolution FROM tickets)
"""


def text_lengths(df):
    return df.withColumns(
        {
            "desc_length": F.length(tx.or_empty("description")),
            "resolution_length": F.length(tx.or_empty("resolution")),
        }
    )


@query("text_lengths", TICKETS + LENGTHS_CTE + "SELECT ticket_id, desc_length, resolution_length FROM lengths")
def _(spark, d):
    df = tickets(spark, d, "ticket_id", "description", "resolution").transform(text_lengths)
    return df.select("ticket_id", "desc_length", "resolution_length")


@query(
    "describe_lengths",
    TICKETS
    + LENGTHS_CTE
    + ", resolved AS (SELECT * FROM lengths WHERE resolution <> '') "
    + describe_sql("desc_length", "lengths")
    + " UNION ALL "
    + describe_sql("resolution_length", "resolved"),
)
def _(spark, d):
    df = tickets(spark, d, "description", "resolution").transform(text_lengths)
    # only tickets with a resolution count for its length
    df = df.withColumn("resolution_length", F.when(F.col("resolution_length") > 0, F.col("resolution_length")))
    return profile.describe(df, "desc_length", "resolution_length")


_TEXT_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, (SELECT count({c}) FROM tickets) AS "count",
    (SELECT count(DISTINCT {c}) FROM tickets) AS "unique",
    (SELECT {c} FROM tickets WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top,
    (SELECT max(n) FROM (SELECT count(*) AS n FROM tickets WHERE {c} IS NOT NULL GROUP BY {c})) AS freq"""
    for c in TEXT_COLUMNS
)


def _dates_sql(column: str) -> str:
    seconds = f"cast(epoch({column}) AS double)"
    shown = lambda x, name: f"strftime(make_timestamp(cast(floor({x}) AS bigint) * 1000000), '%Y-%m-%d %H:%M:%S') AS {name}_date"
    parts = [shown(f"avg({seconds})", "mean"), shown(f"min({seconds})", "min")]
    parts += [shown(f"quantile_cont({seconds}, {q})", n) for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    parts.append(shown(f"max({seconds})", "max"))
    return f"SELECT '{column}' AS column_name, count({column}) AS \"count\", {', '.join(parts)} FROM tickets"


@query(
    "describe_all",
    TICKETS
    + f""", strings AS ({_TEXT_SQL}), numbers AS ({' UNION ALL '.join(describe_sql(c) for c in NUMBER_COLUMNS)}),
    dates AS ({' UNION ALL '.join(_dates_sql(c) for c in DATE_COLUMNS)})
    SELECT column_name, "count", "unique", top, freq, NULL::double AS mean, NULL::double AS std, NULL::double AS min,
      NULL::double AS p25, NULL::double AS p50, NULL::double AS p75, NULL::double AS max,
      NULL::varchar AS mean_date, NULL::varchar AS min_date, NULL::varchar AS p25_date, NULL::varchar AS p50_date, NULL::varchar AS p75_date,
      NULL::varchar AS max_date FROM strings
    UNION ALL SELECT column_name, "count", NULL, NULL, NULL, mean, std, min, p25, p50, p75, max,
      NULL, NULL, NULL, NULL, NULL, NULL FROM numbers
    UNION ALL SELECT column_name, "count", NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
      mean_date, min_date, p25_date, p50_date, p75_date, max_date FROM dates""",
)
def _(spark, d):
    return profile.describe_all(tickets(spark, d, *TEXT_COLUMNS, *NUMBER_COLUMNS, *DATE_COLUMNS))


_INFO_SQL = " UNION ALL ".join(
    f"SELECT {i} AS position, '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS dtype, "
    f"count({f.name}) AS non_null, count(*) AS n_rows FROM tickets"
    for i, f in enumerate(TICKET, 1)
)


@query("table_info", TICKETS + _INFO_SQL)
def _(spark, d):
    return profile.table_info(tickets(spark, d, *ALL_COLUMNS))


@query(
    "median_hours_by_priority",
    TICKETS
    + """SELECT priority, median(time_to_resolution_hours) AS median, count(*) AS n FROM tickets
    WHERE time_to_resolution_hours IS NOT NULL GROUP BY priority""",
)
def _(spark, d):
    df = tickets(spark, d, "priority", "time_to_resolution_hours")
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY_ORDER]), F.col("priority"))
    return profile.group_median(df, "priority", "time_to_resolution_hours").orderBy(rank)


@query(
    "avg_rating_by_category",
    TICKETS
    + """SELECT category, round(avg(satisfaction_rating), 6) AS mean, count(*) AS n FROM tickets
    WHERE satisfaction_rating IS NOT NULL GROUP BY category""",
)
def _(spark, d):
    return profile.group_mean(tickets(spark, d, "category", "satisfaction_rating"), "category", "satisfaction_rating")


@query(
    "corr_hours_rating",
    TICKETS
    + """SELECT round(corr(time_to_resolution_hours, satisfaction_rating), 6) AS pearson_r, count(*) AS n
    FROM tickets WHERE time_to_resolution_hours IS NOT NULL AND satisfaction_rating IS NOT NULL""",
)
def _(spark, d):
    df = tickets(spark, d, "time_to_resolution_hours", "satisfaction_rating")
    return profile.correlation(df, "time_to_resolution_hours", "satisfaction_rating")


@query(
    "rated_points",
    TICKETS
    + """SELECT ticket_id, time_to_resolution_hours, satisfaction_rating FROM tickets
    WHERE satisfaction_rating IS NOT NULL""",
)
def _(spark, d):
    df = tickets(spark, d, "ticket_id", "time_to_resolution_hours", "satisfaction_rating")
    return df.filter(F.col("satisfaction_rating").isNotNull())


@query(
    "tickets_per_month",
    TICKETS
    + """, c AS (SELECT last_day(created_date) AS m, count(*) AS n FROM tickets GROUP BY ALL),
    g AS (SELECT last_day(unnest(generate_series(date_trunc('month', (SELECT min(m) FROM c)),
      date_trunc('month', (SELECT max(m) FROM c)), INTERVAL 1 MONTH))) AS m)
    SELECT strftime(g.m, '%Y-%m-%d') AS month_end, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON c.m = g.m""",
)
def _(spark, d):
    return profile.monthly_counts(tickets(spark, d, "created_date"), "created_date")


def histogram_sql(bins: int) -> str:
    """Over a CTE ``vals(v)``."""
    return f""", span AS (SELECT min(v) - pad AS lo, max(v) + pad AS hi
      FROM vals, (SELECT CASE WHEN min(v) = max(v) THEN 0.5e0 ELSE 0e0 END AS pad FROM vals) GROUP BY pad),
    edges AS (SELECT lo, (hi - lo) / {bins} AS width FROM span),
    filled AS (SELECT least({bins - 1}, cast(floor((v - lo) / width) AS integer)) AS bin, count(*) AS n
      FROM vals, edges GROUP BY ALL)
    SELECT g.bin, round(e.lo + g.bin * e.width, 6) AS bin_start, coalesce(f.n, 0) AS n
    FROM (SELECT cast(unnest(range(0, {bins})) AS integer) AS bin) g CROSS JOIN edges e
    LEFT JOIN filled f ON f.bin = g.bin"""


@query(
    "hist_desc_length",
    TICKETS + LENGTHS_CTE + ", vals AS (SELECT cast(desc_length AS double) AS v FROM lengths)" + histogram_sql(40),
)
def _(spark, d):
    df = tickets(spark, d, "description", "resolution").transform(text_lengths)
    return profile.histogram(df, "desc_length", 40)


@query(
    "hist_resolution_length",
    TICKETS
    + LENGTHS_CTE
    + ", vals AS (SELECT cast(resolution_length AS double) AS v FROM lengths WHERE resolution <> '')"
    + histogram_sql(40),
)
def _(spark, d):
    df = tickets(spark, d, "description", "resolution").filter("resolution <> ''").transform(text_lengths)
    return profile.histogram(df, "resolution_length", 40)


def boxplot_sql(group: str, value: str, source: str) -> str:
    return f""", q AS (SELECT {group}, cast(quantile_cont({value}, 0.25) AS double) AS q1,
      cast(quantile_cont({value}, 0.5) AS double) AS median, cast(quantile_cont({value}, 0.75) AS double) AS q3
      FROM {source} WHERE {value} IS NOT NULL GROUP BY {group}),
    f AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM q)
    SELECT f.{group}, f.q1, f.median, f.q3,
      cast(min(s.{value}) FILTER (s.{value} BETWEEN f.lo AND f.hi) AS double) AS whisker_low,
      cast(max(s.{value}) FILTER (s.{value} BETWEEN f.lo AND f.hi) AS double) AS whisker_high,
      count(*) FILTER (s.{value} NOT BETWEEN f.lo AND f.hi) AS n_outliers, count(*) AS n
    FROM {source} s JOIN f ON f.{group} = s.{group} WHERE s.{value} IS NOT NULL
    GROUP BY f.{group}, f.q1, f.median, f.q3"""


@query("boxplot_len_by_category", TICKETS + LENGTHS_CTE + boxplot_sql("category", "desc_length", "lengths"))
def _(spark, d):
    df = tickets(spark, d, "category", "description", "resolution").transform(text_lengths)
    return profile.boxplot(df, "category", "desc_length")


@query("boxplot_hours_by_priority", TICKETS + boxplot_sql("priority", "time_to_resolution_hours", "tickets"))
def _(spark, d):
    return profile.boxplot(
        tickets(spark, d, "priority", "time_to_resolution_hours"), "priority", "time_to_resolution_hours"
    )


@query("boxplot_hours_by_category", TICKETS + boxplot_sql("category", "time_to_resolution_hours", "tickets"))
def _(spark, d):
    return profile.boxplot(
        tickets(spark, d, "category", "time_to_resolution_hours"), "category", "time_to_resolution_hours"
    )


@query("subcat_nunique", TICKETS + "SELECT count(DISTINCT sub_category) AS n_distinct FROM tickets")
def _(spark, d):
    return profile.distinct_count(tickets(spark, d, "sub_category"), "sub_category")


@query(
    "nesting_check",
    TICKETS
    + """SELECT sub_category, count(DISTINCT category) AS n_parents, count(DISTINCT category) <= 1 AS nested
    FROM tickets GROUP BY sub_category""",
)
def _(spark, d):
    return profile.nesting(tickets(spark, d, "sub_category", "category"), "sub_category", "category")


@query(
    "keyword_leakage",
    TICKETS
    + """SELECT category, count(*) AS n,
    round(avg(cast(contains(lower(description), lower(category)) AS integer)), 6) AS leakage
    FROM tickets GROUP BY category""",
)
def _(spark, d):
    return profile.keyword_leakage(tickets(spark, d, "description", "category"), "description", "category")


@query(
    "length_coverage",
    TICKETS
    + f""", s AS (SELECT len({tokens_sql('description')}) AS size FROM tickets)
    SELECT cast(l.size_limit AS integer) AS size_limit, count(*) FILTER (s.size <= l.size_limit) AS n_within,
    round(count(*) FILTER (s.size <= l.size_limit) / count(*), 6) AS covered
    FROM s CROSS JOIN (VALUES (128), (256), (512)) AS l(size_limit) GROUP BY l.size_limit""",
)
def _(spark, d):
    return profile.coverage(tickets(spark, d, "description"), F.size(tx.tokens("description")), [128, 256, 512])


@query(
    "sample_eval",
    TICKETS
    + """SELECT ticket_id, category, sub_category, priority FROM tickets WHERE status IN ('Closed', 'Resolved')
    ORDER BY md5(concat(ticket_id, '-99')), ticket_id LIMIT 100""",
)
def _(spark, d):
    df = tickets(spark, d, "ticket_id", "category", "sub_category", "priority", "status")
    return sampling.sample_rows(load_corpus(df).drop("status"), 100, seed=99)


def split_sql(by: str | None = None, seed: int = 42) -> str:
    part = f"PARTITION BY {by} " if by else ""
    whole = f"PARTITION BY {by}" if by else ""
    return f""", ordered AS (SELECT ticket_id, category, priority,
      row_number() OVER ({part}ORDER BY md5(concat(ticket_id, '-{seed}')), ticket_id) AS pos,
      count(*) OVER ({whole}) AS n FROM tickets)
    SELECT ticket_id, category, priority, pos <= ceil(0.2e0 * n) AS is_test FROM ordered"""


@query("train_test_split", TICKETS + split_sql())
def _(spark, d):
    return sampling.split(tickets(spark, d, "ticket_id", "category", "priority"))


@query("split_stratified", TICKETS + split_sql("category"))
def _(spark, d):
    return sampling.split(tickets(spark, d, "ticket_id", "category", "priority"), by="category")
