"""Column functions that know the ticket domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketlake.functions.text import or_empty
from ticketlake.schema import HOURS_BOUNDS, METADATA_FIELDS


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """The mapped value of a small fixed mapping, or the default."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def metadata_text(name: str) -> Column:
    """Index metadata is text: a missing rating reads 'nan', other missing values ''."""
    if name == "satisfaction_rating":
        return F.coalesce(F.col(name).cast("string"), F.lit("nan"))
    return or_empty(name)


def metadata_map() -> Column:
    return F.create_map(*[x for f in METADATA_FIELDS for x in (F.lit(f), metadata_text(f))])


def resolved_at(created: str, hours: str) -> Column:
    """Creation time plus fractional hours."""
    return F.col(created) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col(hours) * 3600).cast("decimal(18,6)"))


def speed_band(hours: str, priority: str) -> Column:
    """fast below half the midpoint of the priority's usual range, mid below it, else slow."""
    middle = lookup(F.col(priority), {p: (low + high) / 2 for p, (low, high) in HOURS_BOUNDS.items()})
    return (
        F.when(F.col(hours) < middle * 0.5, "fast")
        .when(F.col(hours) < middle, "mid")
        .when(F.col(hours) >= middle, "slow")
    )


def contains_any(text: str, phrases: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(F.col(text), F.lit(p)) for p in phrases])


def phrase_classes(text: str, phrases: dict[str, list[str]]) -> Column:
    """The classes, in the order given, of which the text contains a phrase."""
    return F.array_compact(F.array(*[F.when(contains_any(text, ps), F.lit(c)) for c, ps in phrases.items()]))
