"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python sees it; plain Java \s misses the no-break space and others.
_SPACES = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"
_BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def clean_text(c: Column | str) -> Column:
    """Null to '', white space collapsed to one blank and trimmed; case and punctuation stay."""
    return F.trim(F.regexp_replace(or_empty(c), _SPACES, " "))


def strip(c: Column | str) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(_col(c), f"^{_SPACES}|{_SPACES}$", "")


def is_blank(c: Column | str) -> Column:
    return F.length(strip(c)) == 0


def default_when_empty(c: Column | str, fallback: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(c), F.lit("")), _col(fallback))


def preview(c: Column | str, n: int) -> Column:
    return F.left(_col(c), F.lit(n))


def tokens(c: Column | str) -> Column:
    """Lower-case words of two or more characters, in text order.

    Texts are split, since extracting all matches copies what is left of the text for each of them.
    """
    return F.filter(F.split(F.lower(or_empty(c)), _BETWEEN_WORDS), lambda word: F.char_length(word) >= 2)


def ngrams(words: Column | str) -> Column:
    """Single words followed by pairs of neighbours."""
    words = _col(words)
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def truncate(words: Column | str, n: int) -> Column:
    return F.slice(_col(words), 1, n)


def percent(x: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", _col(x) * 100)


def join_parts(*parts: Column | str) -> Column:
    """Blank-joined parts; null and empty ones are left out."""
    return F.concat_ws(" ", *[F.nullif(_col(p), F.lit("")) for p in parts])


def fill_template(template: Column | str, values: Column) -> Column:
    """Replace each ``{key}`` by its value, key after key in the order of the map."""
    return F.aggregate(
        F.map_entries(values),
        _col(template),
        lambda text, e: F.replace(
            text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))
        ),
    )


def sort_scores(scores: Column | str) -> Column:
    """Entries of a score map, highest first, ties by key."""
    order = F.array_sort(F.transform(F.map_entries(_col(scores)), lambda e: F.struct(-e["value"], e["key"])))
    return F.transform(order, lambda e: F.struct(e["key"].alias("key"), (-e["col1"]).alias("value")))
