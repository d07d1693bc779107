"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# The ticket view of FIXTURES.md as leading CTEs; add more CTEs after it with a comma.
TICKETS = """WITH li AS (
  SELECT l_orderkey, l_partkey, l_quantity, l_shipdate,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_shipdate, l_linenumber, l_partkey, l_quantity) AS rn
  FROM lineitem),
b AS (SELECT item_id, text AS resolution, count(*) OVER () AS n FROM benchmark),
j AS (
  SELECT d.doc_id, d.text, d.lang, d.source, o.o_orderdate, o.o_orderstatus, o.o_orderpriority,
         c.c_mktsegment, p.p_name, b.resolution, l.l_quantity,
         abs(date_diff('day', o.o_orderdate, l.l_shipdate)) % 168 + 0.5 AS h
  FROM documents d
  JOIN orders o ON o.o_orderkey = d.doc_id
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN b ON b.item_id = d.doc_id % b.n
  LEFT JOIN li l ON l.l_orderkey = o.o_orderkey AND l.rn = 1
  LEFT JOIN part p ON p.p_partkey = l.l_partkey),
tickets AS (
SELECT
  concat('TKT-', cast(10001 + doc_id AS varchar)) AS ticket_id,
  doc_id,
  o_orderdate AS created_date,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_minutes(cast(h * 60 AS bigint)) END AS resolved_date,
  lang AS category,
  concat(lang, '/', source) AS sub_category,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High'
       WHEN '5-LOW' THEN 'Low' ELSE 'Medium' END AS priority,
  CASE WHEN o_orderstatus = 'F' AND doc_id % 5 = 0 THEN 'Resolved' WHEN o_orderstatus = 'F' THEN 'Closed'
       WHEN o_orderstatus = 'P' AND doc_id % 3 = 0 THEN 'Pending' WHEN o_orderstatus = 'P' THEN 'In Progress'
       ELSE 'Open' END AS status,
  split_part(text, chr(10), 1) AS subject,
  text AS description,
  CASE WHEN o_orderstatus = 'F' THEN resolution END AS resolution,
  p_name AS product_service,
  c_mktsegment AS department,
  CASE WHEN o_orderstatus = 'F' THEN cast(cast(l_quantity AS bigint) % 5 + 1 AS double) END AS satisfaction_rating,
  CASE WHEN o_orderstatus = 'F' THEN cast(h AS double) END AS time_to_resolution_hours
FROM j)
"""

# White space of both engines: Java's \\s plus the code points Python's str.strip and \\s also treat so.
WS_SQL = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"
TOKEN_SQL = r"[\p{L}\p{N}_]{2,}"


def clean_sql(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '{WS_SQL}', ' ', 'g'))"


def tokens_sql(column: str) -> str:
    return f"regexp_extract_all(lower(coalesce({column}, '')), '{TOKEN_SQL}')"
