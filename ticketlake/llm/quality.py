"""Quality rules: statistics of a text in SQL functions, and a decision list learned from labelled statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import text_of

_BLANKS = r"[\x20\x09-\x0D]+"
_WINDOW = 8  # words
_MIN_WORDS = 20
_MAX_REPEAT_PERCENT = 30

#: What rules may test: shares and means, so that they hold for texts of any length, and the number of words.
STATISTICS = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "_marks / greatest(n_words, 1)",
    "digits_per_char": "_digits / greatest(word_chars, 1)",
    "capitals_per_char": "_capitals / greatest(word_chars, 1)",
    "different_words": "_different / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(_lines, 1)",
    "repeated_lines": "n_dup_lines / greatest(_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
}


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``.

    Everything is a SQL function of the row's whole text, so nothing is shuffled. Words are parted by ASCII
    white space; a null text has none. Windows of eight words are compared by 64-bit hashes, in n log n for a
    text of n words: only texts with a repeated window sort theirs. ``docs`` must not have columns of the
    names added here; callers pass narrow rows.

    The counts pass through a struct with a row number. A filter on them is not moved below a number that
    depends on the rows, which would copy these expressions into each other without end.
    """
    n = _WINDOW
    window = ", ".join(f"get(_hashes, i + {k})" for k in range(n))
    df = (
        docs.withColumn("_text", text_of(text_col))
        .withColumn("_words", F.expr(rf"filter(split(_text, r'{_BLANKS}'), w -> w <> '')"))
        .withColumn("_filled", F.expr(r"filter(split(_text, r'\n'), x -> x rlike r'[^\x20\x09-\x0D]')"))
        .withColumn("_hashes", F.expr("transform(_words, w -> xxhash64(w))"))
        .withColumn(
            "_windows",
            F.expr(f"CASE WHEN size(_hashes) >= {n} THEN transform(sequence(0, size(_hashes) - {n}), i -> xxhash64({window})) END"),
        )
        .withColumn("_repeats", F.expr("size(array_distinct(_windows)) < size(_windows)"))
        .withColumn(
            "_sorted",
            F.expr("CASE WHEN _repeats THEN sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'i', i))) END"),
        )
        .withColumn(
            "_places",  # where repeated windows begin, in order
            F.expr(
                """sort_array(transform(filter(sequence(0, size(_sorted) - 1), j ->
                     coalesce(get(_sorted, j).h = get(_sorted, j - 1).h, false)
                     OR coalesce(get(_sorted, j).h = get(_sorted, j + 1).h, false)), j -> get(_sorted, j).i))"""
            ),
        )
    )
    covered = f"aggregate(sequence(0, size(_places) - 1), 0L, (s, j) -> s + least({n}, coalesce(get(_places, j) - get(_places, j - 1), {n})))"
    counts = (
        df.withColumn("n_words", F.expr("cast(size(_words) as long)"))
        .withColumn("word_chars", F.expr("cast(char_length(array_join(_words, '')) as long)"))
        .withColumn("n_symbols", F.expr("cast(regexp_count(_text, r'[#*$%&|<>]') as long)"))
        .withColumn("n_dup_lines", F.expr("cast(size(_filled) - size(array_distinct(_filled)) as long)"))
        .withColumn("n_repeat_words", F.expr(f"CASE WHEN _places IS NULL THEN 0L ELSE {covered} END"))
        .withColumn("base_failed", F.expr(f"n_words < {_MIN_WORDS} OR 100 * n_repeat_words > {_MAX_REPEAT_PERCENT} * n_words"))
        .withColumn("_marks", F.expr("regexp_count(_text, r'[!?]')"))
        .withColumn("_digits", F.expr(r"regexp_count(_text, r'\p{N}')"))
        .withColumn("_capitals", F.expr(r"regexp_count(_text, r'\p{Lu}')"))
        .withColumn("_different", F.expr("size(array_distinct(_hashes))"))
        .withColumn("_lines", F.expr("size(_filled)"))
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    shut = F.struct(*names, "_marks", "_digits", "_capitals", "_different", "_lines", F.monotonically_increasing_id())
    return counts.select(*docs.columns, shut.alias("_counts")).select(*docs.columns, "_counts.*")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts and all ``STATISTICS`` (as ``s_`` and their name) of each row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_counts(narrow).select(
        "doc_id",
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
        *(F.expr(f"cast({sql} as double)").alias(f"s_{name}") for name, sql in STATISTICS.items()),
    )


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool  # greater than the threshold, else at most
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        v = values[self.statistic]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        c = F.col(f"s_{self.statistic}")
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for condition in rule:
        out &= condition.holds(values)
    return out


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, cuts: int) -> Rule:
    """Adds the condition of most information gain until only bad rows are covered or none gains."""
    rule: Rule = ()
    live = np.ones(len(bad), bool)
    while live.any() and not bad[live].all() and len(rule) < 4:
        p, n = bad[live].sum(), live.sum()
        best, best_gain = None, 1e-9
        for name, v in values.items():
            v = v[live]
            thresholds = np.unique(np.quantile(v, np.linspace(0, 1, cuts + 2)[1:-1], method="lower"))
            for above in (True, False):
                held = (v[:, None] > thresholds) if above else (v[:, None] <= thresholds)
                p1, n1 = held[bad[live]].sum(0), held.sum(0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p1 > 0, p1 * (np.log2(p1 / n1) - np.log2(p / n)), -1.0)
                at = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[at] > best_gain:
                    beyond = v[v > thresholds[at]]  # halfway to the next value
                    cut = (thresholds[at] + beyond.min()) / 2 if len(beyond) else thresholds[at]
                    best, best_gain = Condition(name, above, float(cut)), gain[at]
        if best is None:
            break
        rule += (best,)
        live &= best.holds(values)
    return rule


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The shortest beginning of the rule that is best on rows it did not grow on; its precision and cover."""
    best: tuple[float, int, float, int] = (-2.0, 0, 0.0, 0)
    for size in range(1, len(rule) + 1):
        held = _covers(rule[:size], values, len(bad))
        p, n = int(bad[held].sum()), int(held.sum())
        worth = (2 * p - n) / n if n else -1.0
        if worth > best[0] + 1e-9:
            best = (worth, size, p / n if n else 0.0, n)
    return rule[: best[1]], best[2], best[3]


def learn(
    values: dict[str, np.ndarray], bad: np.ndarray, cuts: int = 64, precision: float = 0.95, cover: int = 3, most: int = 20
) -> list[Rule]:
    """Rules for bad rows by sequential covering: each grows on two thirds of the rows, is pruned on the rest,
    and what it covers is taken out. Ends when a rule is not precise or covers too little."""
    rules: list[Rule] = []
    live = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < most and bad[live & ~third].any():
        grown = _grow({k: v[live & ~third] for k, v in values.items()}, bad[live & ~third], cuts)
        rule, share, n = _prune(grown, {k: v[live & third] for k, v in values.items()}, bad[live & third])
        if not rule or share < precision or n < cover:
            break
        rules.append(rule)
        live &= ~_covers(rule, values, len(bad))
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, id_col: str = "doc_id") -> list[Rule]:
    """Rules learned from at most ``max_labelled`` labelled rows, those of least hash.

    ``labels`` has ``doc_id`` and ``quality`` (0 is bad); rows with a null in either are left out. Only the
    sample's ids are broadcast (16 bytes a row) and only its statistics reach the driver. Without labelled
    rows there are no rules, and every row that passes the base is kept.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    narrow = docs.select(F.col(id_col).alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    names = [f"s_{name}" for name in STATISTICS]
    rows = with_counts(narrow).select(
        "doc_id", "quality", *(F.expr(f"cast({sql} as double)").alias(n) for n, sql in zip(names, STATISTICS.values(), strict=True))
    )
    rows = sorted(rows.collect(), key=lambda r: tuple(r))  # at most max_labelled, but for repeated ids
    bad = np.array([r["quality"] == 0 for r in rows], bool)
    return learn({n[2:]: np.array([r[n] for r in rows], float) for n in names}, bad)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional expression: the first rule that holds says no."""
    out: Column | None = None
    for rule in rules:
        test = rule[0].column()
        for condition in rule[1:]:
            test &= condition.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of each row, from its whole text.

    A null or empty text has no words and fails the base; repeated rows are judged alike; an empty table gives
    no rows.
    """
    return counted(docs, id_col, text_col).select(
        "doc_id",
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
        (~F.col("base_failed") & verdict(rules)).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``judged`` keeps."""
    packed = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("text"))
    scored = with_counts(packed).select(
        "_row", "base_failed", *(F.expr(f"cast({sql} as double)").alias(f"s_{n}") for n, sql in STATISTICS.items())
    )
    return scored.filter(~F.col("base_failed") & verdict(rules)).select("_row.*")
