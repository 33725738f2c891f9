"""Left joins of one-row-per-key tables onto a base table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featuretable.functions.predicates import column


def left_join(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Every fact with its dimension row, nulls where there is none.

    The strategy is left to Spark: broadcast while the measured size of the dimension is below the
    threshold, else a sort-merge join whose hot partitions adaptive execution splits.
    """
    clashes = sorted((set(facts.columns) & set(dimension.columns)) - {key})
    if clashes:
        raise ValueError(f"columns on both sides: {clashes}")
    return facts.join(dimension, key, "left")


def left_assemble(base: DataFrame, key: str, tables: Sequence[DataFrame]) -> DataFrame:
    """Left-join tables onto the base, all on the same key.

    Tables grouped by the key are already partitioned for the joins, so only the base is shuffled.
    Put first the tables whose absence will remove the row later: they shrink what follows.
    """
    return reduce(lambda left, right: left_join(left, right, key), tables, base)


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """The table itself, after a job that fails if a key occurs twice."""
    repeated = df.groupBy(column(key)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    example = repeated.limit(1).collect()
    if example:
        raise ValueError(f"{key} is not unique, e.g. {example[0][0]!r}: {example[0][1]} rows")
    return df
