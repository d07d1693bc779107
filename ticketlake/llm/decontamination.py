"""Benchmark decontamination: a broadcast hash set of benchmark word windows, met by all windows of the documents.

SQL functions only. Words are runs of characters other than ASCII punctuation, controls and white space; A-Z count
as lower case. A window is so many consecutive words of an item; a shorter item is one window of all its words.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.llm.common import ASCII_UPPER, cut_lineage, free_name, stored_rows, text_of, with_row

#: Characters that part words.
_OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WINDOW = 10
#: Bytes of words and ids in one broadcast; a larger set comes in parts, each with its own scan.
MAX_BROADCAST = 64 << 20


def words_of(text_col: str) -> Column:
    """The words of a text, in order; a null text has none."""
    lower = F.translate(text_of(text_col), ASCII_UPPER, ASCII_UPPER.lower())
    return F.array_remove(F.split(lower, f"[{_OTHER}]+"), "")


def _window_hash(hashes: str, at: str, size: int) -> str:
    """A hash of ``size`` words from their own hashes: a word is read once, not once for each window over it."""
    return f"xxhash64({', '.join(f'get({hashes}, {at} + {k})' for k in range(size))})"


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``hash``, ``words`` and ``items`` (sorted ids as text) of each different window, written once.

    An item without words has none; a null id is left out of ``items``.
    """
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(text_col).alias("w"))
    spans = F.expr(f"transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, {window}))")
    each = words.filter("size(w) > 0").select("item", F.explode_outer(spans).alias("words"))
    sets = each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hashed = sets.withColumn("h", F.expr("transform(words, x -> xxhash64(x))"))
    by_size = " ".join(f"WHEN {k} THEN {_window_hash('h', '0', k)}" for k in range(1, window + 1))
    hashed = hashed.select(F.expr(f"CASE size(words) {by_size} END").alias("hash"), "words", "items")
    return cut_lineage(hashed, "benchmark-windows")


def _occurrences(numbered: DataFrame, windows: DataFrame, sizes: list[int], parts: int) -> DataFrame:
    """``row``, ``doc_id``, ``n_words``, and ``at``, ``upto``, ``items`` of each occurrence of a window.

    The windows of a text are hashed within its row and meet the broadcast set in the same stage; where hashes are
    equal the words are compared. Each row also has a mark with ``at`` -1, so that rows without hits stay, and
    none is read twice for it. A set in ``parts`` is met one part after the other.
    """
    docs = numbered.withColumn("w", words_of("text")).drop("text").withColumn("n_words", F.expr("size(w)"))
    docs = docs.withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    windows_of_size = [
        f"""CASE WHEN n_words >= {k} THEN transform(sequence(1, n_words - {k - 1}), i ->
              named_struct('i', i, 'k', {k}, 'hash', {_window_hash("h", "i - 1", k)})) ELSE array() END"""
        for k in sizes
    ]
    mark = "array(named_struct('i', 0, 'k', 0, 'hash', 0L))"
    every = docs.withColumn("windows", F.expr(f"concat({', '.join([mark, *windows_of_size])})"))
    # "outer": of a plain one Catalyst asks before that the array be filled, and for that makes it within itself
    each = every.select("row", "doc_id", "n_words", "w", F.inline_outer("windows"))
    marks = windows.sparkSession.range(parts).selectExpr(
        "0L AS hash", "cast(array() AS array<string>) AS words", "cast(array() AS array<string>) AS items", "id AS part"
    )
    known = windows.withColumn("part", F.expr(f"pmod(hash, {parts}L)")).unionByName(marks)
    # not "=", which would make the words a part of the join's key and so cost their copy for every window
    same = "slice(w, greatest(i, 1), k) BETWEEN words AND words"
    found = [
        each.join(F.broadcast(known.filter(F.col("part") == part).drop("part")), "hash").filter(same) for part in range(parts)
    ]
    return reduce(DataFrame.unionByName, found).selectExpr(
        "row", "doc_id", "n_words", "i - 1 AS at", "i - 1 + k AS upto", "items"
    )


def scan(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_broadcast: int = MAX_BROADCAST,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``row``, ``n_words``, ``n_hit``, ``spans`` and ``items``.

    A word inside any occurrence of a window is hit. ``spans`` are the hit words as ordered ranges that do not meet
    (``at``, ``upto``: from 0, end excluded), ``n_hit`` is their number, ``items`` the ids, as sorted text, of the
    items with an occurring window. Null and empty texts have no words and no hits; repeated rows and null ids are
    judged each for itself; an empty benchmark hits nothing. Other columns are not read. ``row`` is ``row_col``, or
    else a number given here.

    Only occurrences and one mark for each row are shuffled, by row. The set is broadcast in parts of at most
    ``max_broadcast`` bytes, whatever the benchmark's size.
    """
    windows = item_windows(items, window)
    sizes = sorted(r[0] for r in windows.select(F.expr("size(words)")).distinct().collect())  # ``window`` numbers at most
    weight = windows.agg(F.sum(F.expr("64 + octet_length(array_join(words, ' ')) + octet_length(array_join(items, ' '))")))
    parts = max(1, math.ceil((weight.first()[0] or 0) / max_broadcast))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([row_col] if row_col else [])
    )
    if row_col is None:  # texts that are read once for each part have to keep their numbers
        narrow, row_col = with_row(narrow) if parts == 1 else stored_rows(narrow)
    hits = _occurrences(narrow.withColumnRenamed(row_col, "row"), windows, sizes, parts)

    by_row = Window.partitionBy("row").orderBy("at", "upto")
    before = F.max("upto").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    spans = (
        hits.withColumn("begins", F.coalesce(F.col("at") > before, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("begins").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "doc_id", "n_words", "span")
        .agg(F.min("at").alias("at"), F.max("upto").alias("upto"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    )
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.sum(F.col("upto") - F.col("at")).alias("n_hit"),
            F.array_sort(F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "upto")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .select("doc_id", "row", F.col("n_words").cast("long").alias("n_words"), "n_hit", "spans", "items")
    )


def drop_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_hit: float = 0.0) -> DataFrame:
    """The rows of ``docs``, with all their columns, of whose words at most the share ``max_hit`` is hit."""
    numbered, row = stored_rows(docs)
    bad = scan(numbered, items, window, row_col=row).filter(F.col("n_hit") > F.lit(max_hit) * F.col("n_words"))
    return numbered.join(bad.select(F.col("row").alias(row)), row, "left_anti").drop(row)


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the same rows and columns, the hit words taken out of ``text``, each with what follows it up to the next word.

    Texts without hits stay as they are, null ones too.
    """
    numbered, row = stored_rows(docs)
    name = free_name(numbered, "_spans")
    hit = scan(numbered, items, window, row_col=row).filter("n_hit > 0")
    joined = numbered.join(hit.select(F.col("row").alias(row), F.col("spans").alias(name)), row, "left")
    text = F.col("text")
    words = F.regexp_extract_all(text, F.lit(f"[^{_OTHER}]+[{_OTHER}]*"), F.lit(0))
    start = F.regexp_extract(text, f"^[{_OTHER}]*", 0)
    n = F.size(name)
    # what stays lies between the spans, before the first and after the last
    stays = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(
            F.coalesce(F.get(F.col(name), i - 1)["upto"], F.lit(0)).alias("at"),
            F.coalesce(F.get(F.col(name), i)["at"], F.size(words)).alias("upto"),
        ),
    )
    kept = F.transform(stays, lambda s: F.array_join(F.slice(words, s["at"] + 1, s["upto"] - s["at"]), ""))
    cleaned = F.when(F.col(name).isNull(), text).otherwise(F.concat(start, F.array_join(kept, "")))
    return joined.withColumn("text", cleaned).select(*docs.columns)
