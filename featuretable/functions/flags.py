"""0/1 flags and cleaned values from text attributes."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from featuretable.functions.predicates import any_contains


def equals_flag(value: Column, text: str = "True") -> Column:
    """1 where the value is exactly ``text``, else 0; null gives 0."""
    return F.when(value == F.lit(text), 1).otherwise(0)


def contains_flag(value: Column, *terms: str) -> Column:
    """1 where any term occurs (case matters), else 0; null gives 0."""
    return F.when(any_contains(value, terms), 1).otherwise(0)


def pattern_flag(value: Column, pattern: str) -> Column:
    """1 where the regular expression is found, else 0; null gives 0."""
    return F.when(value.rlike(pattern), 1).otherwise(0)


def number_or_default(
    value: Column, default: float, missing_text: str = "None", lenient: bool = False
) -> Column:
    """Numeric text as a double. Null and ``missing_text`` give the default.

    Other text that is no number is an error, unless ``lenient``: then it gives the default.
    """
    present = F.nullif(value, F.lit(missing_text))
    number = present.try_cast("double") if lenient else present.cast("double")
    return F.coalesce(number, F.lit(default))


def relabel(flag: Column, names: Mapping[str, str]) -> Column:
    """Texts for an integer flag, by replacing each pattern in turn."""
    text = flag.cast("int").cast("string")
    return reduce(lambda c, item: F.regexp_replace(c, item[0], item[1]), names.items(), text)
