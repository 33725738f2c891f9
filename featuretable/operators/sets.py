"""Set difference and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featuretable.functions.predicates import column


def set_difference(full: DataFrame, part: DataFrame) -> DataFrame:
    """Distinct rows of ``full`` that are not in ``part``, nulls counting as equal.

    Both sides go through one aggregation instead of an anti join: a single shuffle, with copies
    of a row already folded together on the sending side.
    """
    names = full.columns
    sides = full.withColumn("_in_part", F.lit(0)).union(
        part.select(*[column(name) for name in names]).withColumn("_in_part", F.lit(1))
    )
    seen = sides.groupBy(*[column(name) for name in names]).agg(
        F.max("_in_part").alias("_in_part")
    )
    return seen.filter(F.col("_in_part") == 0).drop("_in_part")


def dedup_by_key(
    df: DataFrame, keys: str | Sequence[str], order_by: str | Sequence[str]
) -> DataFrame:
    """One row per key: the first by ``order_by``, ties settled by the remaining columns.

    The survivor is a minimum over whole rows, so each task sends one candidate per key, however
    many copies it holds.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    ranked = [name for name in order if name not in keys]
    ranked += [name for name in df.columns if name not in keys and name not in ranked]
    if not ranked:
        return df.select(*[column(name) for name in df.columns]).distinct()
    row = F.min(F.struct(*[column(name) for name in ranked])).alias("_row")
    first = df.groupBy(*[column(name) for name in keys]).agg(row)
    return first.select(
        *[
            column(name) if name in keys else F.col("_row").getField(name).alias(name)
            for name in df.columns
        ]
    )
