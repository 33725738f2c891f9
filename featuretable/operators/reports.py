"""Grouped reports and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featuretable.functions.numbers import percentage
from featuretable.functions.predicates import column


def count_by(
    df: DataFrame, by: str, of: str | None = None, name: str = "total", order: str = "count"
) -> DataFrame:
    """Group sizes: rows, or non-null values of ``of``.

    ``order`` is ``count`` (largest first), ``key``, ``key_desc`` or ``none``.
    """
    counted = df.groupBy(column(by)).agg(
        F.count(F.lit(1) if of is None else column(of)).alias(name)
    )
    sorts = {
        "count": [column(name).desc(), column(by).asc()],
        "key": [column(by).asc()],
        "key_desc": [column(by).desc()],
        "none": [],
    }
    return counted.orderBy(*sorts[order]) if sorts[order] else counted


def top_k(
    df: DataFrame, by: str, k: int = 10, of: str | None = None, name: str = "total"
) -> DataFrame:
    """The ``k`` largest groups, ties settled by the key."""
    counted = count_by(df, by, of, name, order="none")
    return counted.orderBy(column(name).desc(), column(by).asc()).limit(k)


def flag_totals(
    df: DataFrame, flag: str, label: str, total: str = "n_total", positives: str = "n_positive"
) -> DataFrame:
    """Group size and positive labels for each value of a flag."""
    return df.groupBy(column(flag)).agg(
        F.count(column(flag)).alias(total), F.sum(column(label)).alias(positives)
    )


def count_where(df: DataFrame, condition: Column, by: str, name: str = "total") -> DataFrame:
    """Group sizes among the rows that meet a condition."""
    return count_by(df.filter(condition), by, name=name, order="none")


def average_where(df: DataFrame, condition: Column, by: str, of: str, name: str) -> DataFrame:
    """Group averages among the rows that meet a condition."""
    return df.filter(condition).groupBy(column(by)).agg(F.avg(column(of)).alias(name))


def share_by_bucket(
    df: DataFrame,
    bucket: str,
    label: str,
    total: str = "n_total",
    positives: str = "n_positive",
    share: str = "percent_positive",
) -> DataFrame:
    """Labelled rows, positive ones and their percentage per bucket, in bucket order."""
    return (
        df.groupBy(column(bucket))
        .agg(F.count(column(label)).alias(total), F.sum(column(label)).alias(positives))
        .withColumn(share, percentage(column(positives), column(total)))
        .orderBy(column(bucket))
    )
