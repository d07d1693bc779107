"""Queries of column functions, files, requests and index maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlake.functions import domain
from ticketlake.functions import text as tx
from ticketlake.operators.clean import clean_tickets
from ticketlake.operators.features import with_vectors
from ticketlake.plans.profiling import ALL_COLUMNS, CLEAN_CTE, TICKET_ROWS_SQL, printable
from ticketlake.plans.registry import TICKETS, WS_SQL, query
from ticketlake.plans.retrieval import VECTORS, _text, stored_tickets
from ticketlake.schema import (
    DATE_FORMAT,
    DEFAULT_BADGE,
    HOURS_BOUNDS,
    METADATA_FIELDS,
    MISSING_DESCRIPTION,
    PRIORITY_BADGES,
    URGENCY_PHRASES,
)
from ticketlake.session import fresh_path
from ticketlake.sources import csvfiles, index, requests
from ticketlake.sources.tables import table
from ticketlake.sources.tickets import load_corpus, tickets

# Files.


@query("scan_csv_tickets", TICKETS + TICKET_ROWS_SQL + "tickets")
def _(spark, d):
    path = fresh_path(spark, "tickets-csv")
    csvfiles.write_tickets(tickets(spark, d, *ALL_COLUMNS), path)
    return printable(csvfiles.read_tickets(spark, path))


@query("csv_roundtrip", TICKETS + CLEAN_CTE + TICKET_ROWS_SQL.replace("resolution,", "nullif(resolution, '') AS resolution,", 1) + "clean")
def _(spark, d):
    path = fresh_path(spark, "clean-csv")
    csvfiles.write_tickets(clean_tickets(tickets(spark, d, "doc_id", *ALL_COLUMNS)), path)
    # an open ticket's resolution is '' after cleaning and null again for a reader of the file
    return printable(csvfiles.read_tickets(spark, path)).withColumn("resolution", F.nullif("resolution", F.lit("")))


# Columns.


@query(
    "index_metadata",
    TICKETS
    + """SELECT ticket_id, coalesce(department, '') AS department, status, coalesce(resolution, '') AS resolution,
    coalesce(cast(satisfaction_rating AS varchar), 'nan') AS satisfaction_rating FROM tickets""",
)
def _(spark, d):
    df = tickets(spark, d, *METADATA_FIELDS).select(domain.metadata_map().alias("m"))
    shown = ["ticket_id", "department", "status", "resolution", "satisfaction_rating"]
    return df.select(*[F.col("m")[f].alias(f) for f in shown])


@query(
    "default_when_empty",
    TICKETS
    + """SELECT ticket_id, coalesce(nullif(trim(subject), ''), category) AS subject_or_category,
    coalesce(nullif(coalesce(resolution, ''), ''), status) AS resolution_or_status FROM tickets""",
)
def _(spark, d):
    return tickets(spark, d, "ticket_id", "subject", "category", "resolution", "status").select(
        "ticket_id",
        tx.default_when_empty(F.trim("subject"), "category").alias("subject_or_category"),
        tx.default_when_empty(tx.or_empty("resolution"), "status").alias("resolution_or_status"),
    )


@query(
    "fill_null",
    TICKETS
    + """SELECT ticket_id, coalesce(resolution, '') AS resolution, coalesce(product_service, '') AS product_service,
    coalesce(cast(satisfaction_rating AS varchar), '') AS rating_text FROM tickets""",
)
def _(spark, d):
    df = tickets(spark, d, "ticket_id", "resolution", "product_service", "satisfaction_rating")
    return df.fillna("", ["resolution", "product_service"]).select(
        "ticket_id", "resolution", "product_service", tx.or_empty("satisfaction_rating").alias("rating_text")
    )


@query(
    "text_preview",
    TICKETS
    + """SELECT ticket_id, left(subject, 40) AS subject_40, left(description, 80) AS description_80,
    left(resolution, 120) AS resolution_120, left(description, 200) AS description_200 FROM tickets""",
)
def _(spark, d):
    return tickets(spark, d, "ticket_id", "subject", "description", "resolution").select(
        "ticket_id",
        tx.preview("subject", 40).alias("subject_40"),
        tx.preview("description", 80).alias("description_80"),
        tx.preview("resolution", 120).alias("resolution_120"),
        tx.preview("description", 200).alias("description_200"),
    )


def _case(column: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE '{default}' END"


STEP_OF_STATUS = {"Open": "new", "Pending": "waiting"}


@query(
    "lookup_default",
    TICKETS
    + f"""SELECT ticket_id, {_case('priority', PRIORITY_BADGES, DEFAULT_BADGE)} AS badge,
    {_case('status', STEP_OF_STATUS, 'other')} AS step FROM tickets""",
)
def _(spark, d):
    return tickets(spark, d, "ticket_id", "priority", "status").select(
        "ticket_id",
        domain.lookup(F.col("priority"), PRIORITY_BADGES, DEFAULT_BADGE).alias("badge"),
        domain.lookup(F.col("status"), STEP_OF_STATUS, "other").alias("step"),
    )


@query(
    "round_scores",
    TICKETS
    + """, p AS (SELECT ticket_id, time_to_resolution_hours / 168 AS x FROM tickets)
    SELECT ticket_id, round(x, 2) AS x2, round(x, 3) AS x3 FROM p WHERE x IS NOT NULL""",
)
def _(spark, d):
    df = tickets(spark, d, "ticket_id", "time_to_resolution_hours").dropna()
    x = F.col("time_to_resolution_hours") / 168
    return df.select("ticket_id", F.round(x, 2).alias("x2"), F.round(x, 3).alias("x3"))


TEMPLATE = "{product} fails for {user} of {department}: {error}, see {product} notes and {unknown}"


@query(
    "fill_template",
    TICKETS
    + f"""SELECT ticket_id, replace(replace(replace(replace({_text(TEMPLATE)},
      '{{product}}', coalesce(product_service, '')), '{{department}}', department), '{{user}}', ticket_id),
      '{{error}}', subject) AS message FROM tickets""",
)
def _(spark, d):
    values = F.create_map(
        *[F.lit("product"), F.col("product_service"), F.lit("department"), F.col("department")],
        *[F.lit("user"), F.col("ticket_id"), F.lit("error"), F.col("subject")],
    )
    return tickets(spark, d, "ticket_id", "product_service", "department", "subject").select(
        "ticket_id", tx.fill_template(F.lit(TEMPLATE), values).alias("message")
    )


@query(
    "join_parts",
    TICKETS
    + """SELECT ticket_id, concat_ws(' ', nullif(subject, ''), nullif(product_service, ''), nullif(resolution, ''),
    nullif(department, '')) AS description FROM tickets""",
)
def _(spark, d):
    return tickets(spark, d, "ticket_id", "subject", "product_service", "resolution", "department").select(
        "ticket_id", tx.join_parts("subject", "product_service", "resolution", "department").alias("description")
    )


@query(
    "format_dates",
    TICKETS
    + """SELECT ticket_id, strftime(created_date, '%Y-%m-%d %H:%M') AS created_text,
    strftime(resolved_date, '%Y-%m-%d %H:%M') AS resolved_text,
    cast(date_diff('day', created_date, resolved_date) AS integer) AS days_open FROM tickets""",
)
def _(spark, d):
    df = tickets(spark, d, "ticket_id", "created_date", "resolved_date").select(
        "ticket_id",
        F.date_format("created_date", DATE_FORMAT).alias("created_text"),
        F.date_format("resolved_date", DATE_FORMAT).alias("resolved_text"),
    )
    parsed = [F.to_timestamp_ntz(c, F.lit(DATE_FORMAT)) for c in ("resolved_text", "created_text")]
    return df.withColumn("days_open", F.datediff(*parsed))


@query(
    "resolved_at",
    TICKETS
    + """SELECT ticket_id, strftime(created_date + to_microseconds(cast(time_to_resolution_hours * 3600 * 1000000
    AS bigint)), '%Y-%m-%d %H:%M:%S') AS resolved_at FROM tickets WHERE time_to_resolution_hours IS NOT NULL""",
)
def _(spark, d):
    df = tickets(spark, d, "ticket_id", "created_date", "time_to_resolution_hours").dropna()
    done = domain.resolved_at("created_date", "time_to_resolution_hours")
    return df.select("ticket_id", F.date_format(done, "yyyy-MM-dd HH:mm:ss").alias("resolved_at"))


_MIDDLE = "CASE priority " + " ".join(f"WHEN '{p}' THEN {(a + b) / 2}e0" for p, (a, b) in HOURS_BOUNDS.items()) + " END"


@query(
    "sla_band",
    TICKETS
    + f""", m AS (SELECT ticket_id, priority, time_to_resolution_hours AS h, {_MIDDLE} AS middle FROM tickets)
    SELECT ticket_id, priority, CASE WHEN h < middle * 0.5 THEN 'fast' WHEN h < middle THEN 'mid'
      WHEN h >= middle THEN 'slow' END AS band FROM m""",
)
def _(spark, d):
    return tickets(spark, d, "ticket_id", "priority", "time_to_resolution_hours").select(
        "ticket_id", "priority", domain.speed_band("time_to_resolution_hours", "priority").alias("band")
    )


# The supplied texts hold none of the fixed phrases, so frequent words of theirs join the lists.
PHRASES = {
    priority: phrases + [word]
    for (priority, phrases), word in zip(URGENCY_PHRASES.items(), ["the ", "der ", "les ", "los "])
}


def _any_sql(phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(description, {_text(p)})" for p in phrases) + ")"


@query(
    "phrase_tags",
    TICKETS
    + ", tags AS (SELECT ticket_id, priority, "
    + ", ".join(f"{_any_sql(ps)} AS {p.lower()}" for p, ps in PHRASES.items())
    + """ FROM tickets)
    SELECT priority, count(*) AS n, count(*) FILTER (critical) AS n_critical, count(*) FILTER (high) AS n_high,
      count(*) FILTER (medium) AS n_medium, count(*) FILTER (low) AS n_low,
      round(avg(CASE priority WHEN 'Critical' THEN cast(critical AS integer) WHEN 'High' THEN cast(high AS integer)
        WHEN 'Medium' THEN cast(medium AS integer) ELSE cast(low AS integer) END), 6) AS agreement
    FROM tags GROUP BY priority""",
)
def _(spark, d):
    df = tickets(spark, d, "priority", "description")
    df = df.select("priority", domain.phrase_classes("description", PHRASES).alias("tags"))
    tagged = [F.count_if(F.array_contains("tags", p)).alias(f"n_{p.lower()}") for p in PHRASES]
    agrees = F.array_contains("tags", F.col("priority")).cast("double")
    return df.groupBy("priority").agg(F.count("*").alias("n"), *tagged, F.round(F.avg(agrees), 6).alias("agreement"))


@query(
    "format_percent",
    TICKETS
    + """, c AS (SELECT status, count(*) AS n FROM tickets GROUP BY status)
    SELECT status, n, printf('%.1f%%', 100.0e0 * n / (SELECT count(*) FROM tickets)) AS share FROM c""",
)
def _(spark, d):
    counts = tickets(spark, d, "status").groupBy("status").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("status", "n", tx.percent(F.col("n") / total).alias("share"))


@query(
    "scores_sorted",
    TICKETS
    + """, c AS (SELECT department, category, count(*) AS n FROM tickets GROUP BY department, category)
    SELECT department, string_agg(category || ':' || n, ', ' ORDER BY n DESC, category) AS scores
    FROM c GROUP BY department""",
)
def _(spark, d):
    counts = tickets(spark, d, "department", "category").groupBy("department", "category").agg(F.count("*").alias("n"))
    # one entry per category, a bounded map
    scores = counts.groupBy("department").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("m"))
    entries = F.transform(tx.sort_scores("m"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return scores.select("department", F.array_join(entries, ", ").alias("scores"))


# Requests: conversation turns as JSON bodies; a system turn has no description field.


def request_bodies(spark, d):
    name = F.when(F.col("role") == "system", "note").otherwise("description")
    body = F.to_json(F.create_map(name, F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", body.alias("body"))


@query(
    "request_parse",
    f"""WITH r AS (SELECT conv_id, turn, CASE WHEN role <> 'system' THEN text END AS t FROM conversations),
    f AS (SELECT *, t IS NULL OR length(regexp_replace(t, '^{WS_SQL}|{WS_SQL}$', '', 'g')) = 0 AS bad FROM r)
    SELECT conv_id, turn, CASE WHEN NOT bad THEN t END AS description,
      CASE WHEN bad THEN {_text(MISSING_DESCRIPTION)} END AS error,
      CASE WHEN bad THEN '{{"error":"' || {_text(MISSING_DESCRIPTION)} || '"}}'
        ELSE '{{"n_chars":' || length(t) || '}}' END AS result FROM f""",
)
def _(spark, d):
    parsed = requests.parse_requests(request_bodies(spark, d)).withColumn("n_chars", F.length("description"))
    return requests.render_results(parsed, "n_chars").select("conv_id", "turn", "description", "error", "result")


# Index.


@query(
    "build_index",
    VECTORS
    + """SELECT ticket_id AS id, description AS document, category, sub_category, priority, department, status,
    coalesce(resolution, '') AS resolution, subject, coalesce(cast(satisfaction_rating AS varchar), 'nan')
    AS satisfaction_rating, len(vector) AS dimensions FROM corpus""",
)
def _(spark, d):
    path = fresh_path(spark, "index")
    index.build_index(with_vectors(load_corpus(stored_tickets(spark, d))), path)
    return (
        index.open_index(spark, path)
        .withColumn("dimensions", F.size("embedding").cast("bigint"))
        .drop("embedding", "ticket_id")
    )


@query("index_count", VECTORS + "SELECT count(*) AS n_indexed FROM corpus")
def _(spark, d):
    path = fresh_path(spark, "index")
    index.build_index(with_vectors(load_corpus(stored_tickets(spark, d))), path)
    return index.open_index(spark, path).agg(F.count("*").alias("n_indexed"))


UPDATES_SQL = """, closed AS (SELECT ticket_id AS id, subject, coalesce(resolution, '') AS resolution, 0 AS version
      FROM tickets WHERE status = 'Closed'),
    updates AS (
      SELECT ticket_id AS id, subject, 'revised: ' || coalesce(resolution, '') AS resolution, 1 AS version
      FROM tickets WHERE status = 'Resolved' OR priority = 'Critical'
      UNION ALL SELECT ticket_id, subject, 'final: ' || coalesce(resolution, ''), 2 FROM tickets
      WHERE category = 'de' AND (status = 'Resolved' OR priority = 'Critical'))
    """


def index_rows(df, version: int, mark: str = ""):
    return df.select(
        F.col("ticket_id").alias("id"),
        "subject",
        F.concat(F.lit(mark), tx.or_empty("resolution")).alias("resolution"),
        F.lit(version).alias("version"),
    )


def index_updates(df):
    """First revisions, and second ones of the same tickets in one category."""
    changed = df.filter((F.col("status") == "Resolved") | (F.col("priority") == "Critical"))
    return index_rows(changed, 1, "revised: ").unionByName(
        index_rows(changed.filter("category = 'de'"), 2, "final: ")
    )


@query(
    "index_upsert",
    TICKETS
    + UPDATES_SQL
    + """, merged AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS pos
      FROM (SELECT * FROM closed UNION ALL SELECT * FROM updates))
    SELECT id, subject, resolution, version FROM merged WHERE pos = 1""",
)
def _(spark, d):
    df = tickets(spark, d, "ticket_id", "subject", "category", "priority", "status", "resolution")
    return index.upsert(index_rows(df.filter("status = 'Closed'"), 0), index_updates(df))
