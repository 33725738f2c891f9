"""Row filters. All are plain predicates, so they reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from featuretable.functions.predicates import all_present, any_contains, column


def where_any_contains(df: DataFrame, name: str, terms: Iterable[str]) -> DataFrame:
    """Rows whose text contains one of the terms; null rows go."""
    return df.filter(any_contains(column(name), terms))


def where_equals(df: DataFrame, name: str, value: object) -> DataFrame:
    """Rows with exactly this value; null rows go."""
    return df.filter(column(name) == value)


def drop_incomplete(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Rows without null or NaN in the named columns (all by default).

    One conjunct per column: over left joins Catalyst can then turn those whose right side must
    be present into inner joins and push the tests down to the scans.
    """
    return df.filter(all_present(df, names))
