"""Row predicates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def any_contains(value: Column, terms: Iterable[str]) -> Column:
    """True where any term occurs in the text; case matters; null stays null."""
    return reduce(or_, [value.contains(term) for term in terms])


def quoted(name: str) -> str:
    """A literal column name, dots and spaces included, for use in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """Column by its literal name."""
    return F.col(quoted(name))


def can_be_nan(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.FloatType, T.DoubleType))


def missing_sql(field: T.StructField) -> str:
    """SQL text for: null, or NaN where the type has NaN."""
    name = quoted(field.name)
    return f"({name} IS NULL OR isnan({name}))" if can_be_nan(field) else f"({name} IS NULL)"


def is_missing(field: T.StructField) -> Column:
    return F.expr(missing_sql(field))


def fields(df: DataFrame, names: Iterable[str] | None = None) -> list[T.StructField]:
    """Schema fields of the named columns (all by default), in the given order."""
    if names is None:
        return list(df.schema.fields)
    return [df.schema[name] for name in names]


def all_present(df: DataFrame, names: Iterable[str] | None = None) -> Column:
    """True where none of the named columns (all by default) is null or NaN."""
    tests = []
    for field in fields(df, names):
        name = quoted(field.name)
        tests.append(f"{name} IS NOT NULL")
        if can_be_nan(field):
            tests.append(f"NOT isnan({name})")
    return F.expr(" AND ".join(tests))
