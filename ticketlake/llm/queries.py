"""One query for each operator: the operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm import bpe, decontamination, extraction, langid, lm, merkle, packing, quality, repair
from ticketlake.llm.common import fold, table
from ticketlake.llm.exact_dedup import exact_dedup
from ticketlake.llm.line_dedup import line_dedup
from ticketlake.llm.simhash import near_duplicates
from ticketlake.llm.warc import archive_pages

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pieces(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, capacity=2048)
    return packing.pack(pieces, capacity=2048)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.digest(bpe.decode(encoded, path))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.fit(pages))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=2)
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm.score(table(spark, sf_dir, "documents"), fold(7) != 2)
    counts = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), *counts)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(3) == 1
    model = langid.fit(docs, ~held_out, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, times = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repair(rows, times_col=times)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), {"text": text})
    folded_root = merkle.folded(F.col("row.now"), F.col("path"))
    return rows.select(
        "row.doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        folded_root.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    n_items = F.size("items").cast("long").alias("n_items")
    items_sha256 = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", n_items, items_sha256, (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_extraction": op5_extraction,
    "op6_simhash": op6_simhash,
    "op7_lm": op7_lm,
    "op8_warc": op8_warc,
    "op9_line_dedup": op9_line_dedup,
    "op10_langid": op10_langid,
    "op11_repair": op11_repair,
    "op12_merkle": op12_merkle,
    "op13_decontamination": op13_decontamination,
}

# Equal texts: identical after lower-casing A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(column: str) -> str:
    """Words of op13: runs of what is not ASCII punctuation, control or white space."""
    return rf"""regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


ORACLES: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    # SHA-1 in base 32: the 40 hexadecimal digits as bits, five to a letter
    "op8_warc": """
        WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
        b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right('000' ||
                bin(strpos('0123456789abcdef', substr(x, i, 1)) - 1), 4)), '') AS bits FROM d),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS best FROM b)
        SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
                 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda k:
                   cast(substr(bits, 5 * i + k + 1, 1) AS bigint) << cast(4 - k AS bigint)))::bigint, 1)), '') AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> best THEN best END AS refers_to
        FROM m""",
    "op9_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
                   FROM documents),
        l AS (SELECT r, doc_id, i, line,
                     translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
              FROM (SELECT r, doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM d)),
        f AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN f USING (key) GROUP BY r, doc_id""",
    "op13_decontamination": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
        b AS (SELECT cast(item_id AS varchar) AS item, {_words("text")} AS w FROM benchmark),
        bw AS (SELECT DISTINCT item, w[i:i + 9] AS win
               FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        k AS (SELECT DISTINCT len(win) AS k FROM bw),
        dw AS (SELECT r, i, w[i:i + k - 1] AS win
               FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
        hit AS (SELECT r, i, len(win) AS k, item FROM dw JOIN bw USING (win)),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
                  FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
        SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
}
