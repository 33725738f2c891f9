"""Filling and reporting missing values."""

from __future__ import annotations

from collections.abc import Iterable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featuretable.functions.predicates import all_present, can_be_nan, column, fields, is_missing
from featuretable.operators.columns import one_row_per_column


def fill_constant(
    df: DataFrame, value: float | int | str | bool, names: Iterable[str]
) -> DataFrame:
    """Replace null and NaN by a constant in columns of the constant's type."""
    return df.na.fill(value, subset=list(names))


def _known(df: DataFrame, name: str) -> Column:
    value = column(name)
    return F.nanvl(value, F.lit(None)) if can_be_nan(df.schema[name]) else value


def fill_with_max(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Replace missing values by the largest value of the column.

    All maxima come from one scalar subquery, so the table stays lazy and Spark prunes from the
    subquery whatever the filled columns do not need. A gap in a column without any value is an
    error.
    """
    names = list(names)
    largest = df.agg(
        F.struct(*[F.max(_known(df, name)).alias(name) for name in names]).alias("largest")
    ).scalar()
    filled = {}
    for name in names:
        nothing = F.raise_error(F.lit(f"cannot fill {name}: it holds no value"))
        filled[name] = F.coalesce(
            _known(df, name), largest.getField(name), nothing.cast(df.schema[name].dataType)
        )
    return df.withColumns(filled)


def loss_report(df: DataFrame) -> DataFrame:
    """What dropping incomplete rows costs: the gaps of each column, and the rows before and after.

    One pass over the table gives one row; it is turned into one row per column afterwards.
    """
    columns = fields(df)
    totals = ["count(1) AS _rows", "count_if(_complete) AS _kept"]
    totals += [f"count_if(_g{i}) AS _m{i}" for i in range(len(columns))]
    gaps = df.select(
        all_present(df).alias("_complete"),
        *[is_missing(field).alias(f"_g{i}") for i, field in enumerate(columns)],
    )
    cells = {
        field.name: {"missing": f"_m{i}", "rows_before": "_rows", "rows_after": "_kept"}
        for i, field in enumerate(columns)
    }
    return one_row_per_column(gaps.selectExpr(*totals), cells)
