"""Days, recency in months and tenure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Single-digit months, days and time parts are accepted, text after the pattern is ignored.
_DAY_TEXT = r"^\s*(\d{4}-\d{1,2}-\d{1,2})"
_TIME_TEXT = r"^\s*(\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2})"


def parse_timestamp(text: Column, strict: bool = False) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text to a timestamp; bad text gives null, or an error if strict."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    return parse(F.regexp_extract(text, _TIME_TEXT, 1), F.lit("yyyy-M-d H:m:s"))


def parse_day(text: Column, with_time: bool = False, strict: bool = False) -> Column:
    """Text to a day. ``with_time`` asks for a time of day after the date, then drops it."""
    if with_time:
        return F.to_date(parse_timestamp(text, strict))
    parse = F.to_date if strict else F.try_to_date
    return parse(F.regexp_extract(text, _DAY_TEXT, 1), "yyyy-M-d")


def day(value: str | Column) -> Column:
    """A day from an ISO literal, or from a date or timestamp column."""
    return F.lit(value).cast("date") if isinstance(value, str) else F.to_date(value)


def recency_months(reference: str | Column, last: Column) -> Column:
    """Whole months from the day of ``last`` to the reference day."""
    return F.round(F.months_between(day(reference), F.to_date(last)), 0)


def tenure_months(reference: str | Column, since: Column) -> Column:
    """Whole months from ``since``, time of day included, to the reference day."""
    return F.round(F.months_between(day(reference), since), 0)


def tenure_columns(reference: str | Column, since: Column) -> dict[str, Column]:
    """Distance between two days in days, months and years, exact and rounded."""
    start, end = F.to_date(since), day(reference)
    days = F.datediff(end, start)
    months = F.months_between(end, start)
    return {
        "days": days,
        "years_by_days": days / F.lit(365.25),
        "months": months,
        "months_rounded": F.round(months, 2),
        "years_by_months": months / F.lit(12),
        "years": F.round(months / F.lit(12), 0),
    }
