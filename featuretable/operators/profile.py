"""Table profiles and quality checks.

All but the exact distinct counts take one pass with partial aggregation; only single rows are
turned into one row per column.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featuretable.functions.predicates import column, fields, is_missing
from featuretable.operators.columns import one_row_per_column
from featuretable.operators.ranking import running_total_by
from featuretable.sources.scratch import materialize


SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def table_shape(df: DataFrame) -> DataFrame:
    """Number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns))
    )


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(column(name)).distinct()


def distinct_count(df: DataFrame, name: str, alias: str | None = None) -> DataFrame:
    """Exact number of distinct non-null values."""
    return df.agg(F.countDistinct(column(name)).alias(alias or name))


def distinct_profile(
    df: DataFrame, names: Iterable[str] | None = None, rsd: float | None = None
) -> DataFrame:
    """Distinct non-null values of every column, one row per column.

    Exact counts run one narrow branch per column: each reads its own column only and drops
    repeats before the shuffle. (A table that is not a plain scan of columnar files is stored first,
    once.) Several exact counts in one aggregate would instead copy every row
    once per column. With ``rsd`` all counts are estimated in a single pass.
    """
    names = [field.name for field in fields(df, names)]
    if rsd is not None:
        counts = {name: F.approx_count_distinct(column(name), rsd) for name in names}
        return _one_row_per_column(df, names, {"distinct_count": counts})
    if not _is_plain_scan(df):
        df = materialize(df.select(*[column(name) for name in names]), "profile")
    branches = [
        distinct_count(df, name, "distinct_count").select(
            F.lit(name).alias("column_name"), "distinct_count"
        )
        for name in names
    ]
    return reduce(DataFrame.unionAll, branches)


def _is_plain_scan(df: DataFrame) -> bool:
    """Whether the table is read from columnar files as it is, so that a column costs a column."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().strip()
    return "\n" not in plan and plan.startswith("Relation") and plan.endswith("parquet")


def distinct_keys(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Distinct non-null values of several columns in one pass over the table.

    A row becomes one short row per column; repeats fold together before the shuffle. For a few key
    columns of a table that is dear to scan.
    """
    names = list(names)
    pairs = F.array(*[
        F.struct(F.lit(name).alias("key"), column(name).cast("string").alias("value")) for name in names
    ])
    seen = df.select(F.inline(pairs)).filter("value IS NOT NULL").distinct()
    listed = df.sparkSession.createDataFrame([(name,) for name in names], "key string")
    found = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(found, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n_keys"))


def null_audit(df: DataFrame) -> DataFrame:
    """Number of null or NaN values per column, as one wide row."""
    return df.agg(
        *[F.count_if(is_missing(field)).alias(field.name) for field in fields(df)]
    )


def all_null_columns(df: DataFrame) -> DataFrame:
    """Names of the columns that hold no value at all."""
    names = df.columns
    counts = {name: F.count(column(name)) for name in names}
    return (
        _one_row_per_column(df, names, {"n_values": counts})
        .filter("n_values = 0")
        .select("column_name")
    )


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """The table without its empty columns. Runs one job, as the new schema depends on the data."""
    empty = {row.column_name for row in all_null_columns(df).collect()}
    return df.select(*[column(name) for name in df.columns if name not in empty])


def constant_columns(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Names of the columns whose non-null values are all the same."""
    names = [field.name for field in fields(df, names)]
    same = {name: F.min(column(name)) == F.max(column(name)) for name in names}
    return _one_row_per_column(df, names, {"same": same}).filter("same").select("column_name")


def describe_numeric(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Count, mean, sample standard deviation, minimum and maximum of numeric columns."""
    names = list(names)
    number = {name: column(name).cast("double") for name in names}
    return _one_row_per_column(
        df,
        names,
        {
            "n": {name: F.count(column(name)) for name in names},
            "mean": {name: F.avg(number[name]) for name in names},
            "stddev": {name: F.stddev_samp(number[name]) for name in names},
            "min": {name: F.min(number[name]) for name in names},
            "max": {name: F.max(number[name]) for name in names},
        },
    )


def describe_quantiles(
    df: DataFrame, names: Iterable[str], shares: Iterable[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Exact quantiles of numeric columns, one row per column: the smallest value with that share at or below it.

    Values of all columns are counted once each and ranked over ranges of (column, value), so neither a
    column nor a value that holds most rows meets in one task. Nulls and NaN do not count; a column
    without values has null quantiles.
    """
    names = list(names)
    shares = list(shares)
    cells = [F.struct(F.lit(i).alias("slot"), column(name).cast("double").alias("value")) for i, name in enumerate(names)]
    values = df.select(F.inline(F.array(*cells))).filter("value IS NOT NULL AND NOT isnan(value)")
    counts = values.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total_by(counts, ["slot"], [F.col("value").asc()], F.col("n"), "below")
    sizes = ranked.groupBy("slot").agg(F.sum("n").alias("total"))
    quantiles = []
    for share in shares:
        place = F.greatest(F.ceil(F.lit(share) * F.col("total")), F.lit(1))
        here = (F.col("below") < place) & (place <= F.col("below") + F.col("n"))
        quantiles.append(F.max(F.when(here, F.col("value"))).alias(f"q{round(100 * share)}"))
    found = ranked.join(F.broadcast(sizes), "slot").groupBy("slot").agg(*quantiles)
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "slot int, column_name string")
    return listed.join(found, "slot", "left").drop("slot")


def distinct_sketches(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """``column_name, sketch``: distinct values of every column as HyperLogLog sketches, in one pass.

    A sketch has a fixed size (``2 ** SKETCH_BITS`` registers) and is stored beside the load it describes;
    sketches of many loads merge without reading their rows again. Nulls do not count.
    """
    names = [field.name for field in fields(df, names)]
    sketch = {name: F.hll_sketch_agg(column(name).cast("string"), F.lit(SKETCH_BITS)) for name in names}
    return _one_row_per_column(df, names, {"sketch": sketch})


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch per column of the sketches of several loads, put together by ``unionByName``."""
    return sketches.groupBy("column_name").agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """``column_name, estimate``; the standard error is about ``SKETCH_ERROR`` of it."""
    return sketches.select("column_name", F.hll_sketch_estimate("sketch").alias("estimate"))


def describe_text(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Count, minimum and maximum of text or date columns, as text."""
    names = list(names)
    return _one_row_per_column(
        df,
        names,
        {
            "n": {name: F.count(column(name)) for name in names},
            "min": {name: F.min(column(name)).cast("string") for name in names},
            "max": {name: F.max(column(name)).cast("string") for name in names},
        },
    )


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows against distinct keys, and whether there is one row per key."""
    counts = df.groupBy(column(key)).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(column(key)).alias("n_keys")
    ).withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


def derived_vs_source(df: DataFrame, key: str, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Derived columns beside the source columns they should agree with, and the differences."""
    shown: list[Column] = [column(key)]
    for derived, source in pairs:
        shown += [
            column(derived),
            column(source),
            (column(derived) - column(source)).alias(f"{derived}_minus_{source}"),
        ]
    return df.select(*shown)


def _one_row_per_column(
    df: DataFrame, names: list[str], measures: dict[str, dict[str, Column]]
) -> DataFrame:
    """Aggregate in one pass, then lay the single result row out as one row per column."""
    flat = df.agg(
        *[
            expression[name].alias(f"_{i}_{measure}")
            for measure, expression in measures.items()
            for i, name in enumerate(names)
        ]
    )
    cells = {
        name: {measure: f"_{i}_{measure}" for measure in measures} for i, name in enumerate(names)
    }
    return one_row_per_column(flat, cells)
