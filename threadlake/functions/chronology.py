"""Times as seconds and nanoseconds, and the order of events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.schema import CHRONOLOGY

RFC3339 = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def is_rfc3339(text: Column) -> Column:
    """Whether a text is a full timestamp with an offset."""
    return F.rlike(text, F.lit(RFC3339))


def seconds(text: Column) -> Column:
    """Seconds since 1970; null for what is no timestamp."""
    zone = F.upper(F.regexp_extract(text, RFC3339, 4))
    stamp = F.concat(F.regexp_extract(text, RFC3339, 1), F.lit("T"), F.regexp_extract(text, RFC3339, 2), zone)
    return F.when(is_rfc3339(text), F.unix_seconds(F.try_to_timestamp(stamp)))


def nanos(text: Column) -> Column:
    """Nanoseconds within the second."""
    digits = F.substring(F.regexp_extract(text, RFC3339, 3), 2, 9)
    return F.when(is_rfc3339(text), F.rpad(digits, 9, "0").cast("int")).cast("int")


def precision(text: Column) -> Column:
    """What the fraction's digits say."""
    digits = F.length(F.regexp_extract(text, r"\.([^Z+\-]*)", 1))
    return F.when(digits == 0, "second").when(digits <= 3, "millisecond").when(digits <= 6, "microsecond").otherwise("nanosecond")


def order_key(prefix: str = "") -> Column:
    """The whole order in one comparable value."""
    return F.struct(*(F.col(f"{prefix}{c}") for c in CHRONOLOGY))


def ascending() -> list[Column]:
    return [F.col(c).asc() for c in CHRONOLOGY]


def descending() -> list[Column]:
    return [F.col(c).desc() for c in CHRONOLOGY]


def gap_seconds(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Seconds between two intervals; 0 where they meet."""
    return F.greatest(F.lit(0).cast("long"), start_a - end_b, start_b - end_a)
