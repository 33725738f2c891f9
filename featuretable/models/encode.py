"""Category encoding and feature vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, RFormula, StringIndexer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featuretable.functions.predicates import column
from featuretable.operators.assemble import left_join
from featuretable.operators.columns import drop
from featuretable.operators.profile import distinct_profile
from featuretable.operators.ranking import running_total
from featuretable.sources.scratch import materialize, scratch_path
from featuretable.sources.tables import read_table, write_table

# What a vector is in a Parquet file: sparse (0) with indices, or dense (1).
VECTOR = T.StructType(
    [
        T.StructField("type", T.ByteType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("indices", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)


def check_categories(df: DataFrame, names: Sequence[str], limit: int) -> None:
    """Fail before a fit whose category list would outgrow what the caller allows.

    Indexers of Spark ML keep every category on the driver and send the list to all tasks. One
    estimating pass sizes all columns; nothing is cut off silently.
    """
    sizes = distinct_profile(df, names, rsd=0.05).collect()
    large = {row.column_name: row.distinct_count for row in sizes if row.distinct_count > limit}
    if large:
        raise ValueError(f"more than {limit} categories: {large}; group them before encoding")


def category_index(df: DataFrame, name: str, index: str = "index") -> DataFrame:
    """Distinct values of a column with their numbers by falling frequency, ties by value.

    The numbers are the ones a ``StringIndexer`` gives, but the list of values stays distributed.
    """
    counts = df.filter(column(name).isNotNull()).groupBy(column(name)).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.desc("_n"), column(name).asc()]
    return running_total(counts, order, F.lit(1), index).select(column(name), column(index).cast("double").alias(index))


def with_category_index(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the category number of each column; a hot category is split by adaptive execution."""
    for name, index in zip(names, index_names(names), strict=True):
        df = df.join(category_index(df, name, index), name, "left")
    return df


@dataclass(frozen=True)
class CategoryIndex:
    """Category numbers learnt from training rows: one stored table of value and number per column.

    Only how many categories a column has is known to the driver.
    """

    tables: Mapping[str, DataFrame]
    sizes: Mapping[str, int]


def fit_category_index(train: DataFrame, names: Sequence[str]) -> CategoryIndex:
    """The numbers a ``StringIndexer`` gives, without its list of values on the driver."""
    tables = {
        name: materialize(category_index(train, name, index), "categories")
        for name, index in zip(names, index_names(names), strict=True)
    }
    return CategoryIndex(tables, {name: table.count() for name, table in tables.items()})


def _offsets(columns: Sequence[str], index: CategoryIndex) -> tuple[dict[str, int], int]:
    """First slot of each column and the width of the vector."""
    offsets, width = {}, 0
    for name in columns:
        offsets[name] = width
        width += index.sizes.get(name, 1)
    if width >= 1 << 31:
        raise ValueError(f"{width} slots: a vector has fewer than {1 << 31}")
    return offsets, width


def _number(name: str) -> Column:
    value = column(name).cast("double")
    missing = F.raise_error(F.lit(f"{name} has a null or NaN: fill it before it becomes a feature"))
    return F.when(value.isNull() | F.isnan(value), missing.cast("double")).otherwise(value)


def feature_vectors(
    df: DataFrame, columns: Sequence[str], index: CategoryIndex, features: str = "features"
) -> DataFrame:
    """``df`` with the named columns replaced by one sparse vector, in the given order.

    A column of ``index`` takes one slot per category, any other one slot; null and unseen categories
    become all zeros, null numbers fail the job. Category numbers come by joins, so neither driver nor
    tasks hold a list of values, and the metadata is the width alone (``slot_names`` has the names). The
    table is written with vectors as the structs they are in Parquet and read back as vectors.
    """
    offsets, width = _offsets(columns, index)
    categories = [name for name in columns if name in index.tables]
    numbers = [name for name in columns if name not in index.tables]
    joined = reduce(lambda rows, name: left_join(rows, index.tables[name], name), categories, df)
    taken = dict(zip(categories, index_names(categories), strict=True))
    slots = F.array(*[
        F.struct(
            (F.lit(offsets[name]) + (column(taken[name]).cast("int") if name in taken else 0)).alias("slot"),
            (F.lit(1.0) if name in taken else _number(name)).alias("value"),
        )
        for name in columns
    ])
    used = F.filter(slots, lambda s: s["slot"].isNotNull() & (s["value"] != 0))
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(width).alias("size"),
        F.transform(used, lambda s: s["slot"]).alias("indices"),
        F.transform(used, lambda s: s["value"]).alias("values"),
    )
    gone = [*numbers, *categories, *taken.values()]
    rows = drop(joined.withColumn(features, vector), gone)
    path = scratch_path(df.sparkSession, "features")
    write_table(rows.hint("rebalance"), path)
    width_only = {"ml_attr": {"num_attrs": width}}
    fields = [
        T.StructField(features, VectorUDT(), False, width_only) if f.name == features else f
        for f in rows.schema
    ]
    return read_table(df.sparkSession, path, T.StructType(fields), "parquet")


def slot_names(spark: SparkSession, columns: Sequence[str], index: CategoryIndex) -> DataFrame:
    """``slot, feature`` of the vectors that ``feature_vectors`` builds, as a table."""
    offsets, _ = _offsets(columns, index)
    plain = [(offsets[name], name) for name in columns if name not in index.tables]
    named = spark.createDataFrame(plain, "slot int, feature string")
    for name, vector in zip(index.tables, vector_names(list(index.tables)), strict=True):
        slot = (F.lit(offsets[name]) + column(index_names([name])[0]).cast("int")).alias("slot")
        feature = F.concat(F.lit(f"{vector}_"), column(name).cast("string")).alias("feature")
        named = named.unionAll(index.tables[name].select(slot, feature))
    return named


def index_names(names: Sequence[str]) -> list[str]:
    return [f"{name}Ind" for name in names]


def vector_names(names: Sequence[str]) -> list[str]:
    return [f"{name}_ohe" for name in names]


def string_indexer(names: Sequence[str], handle_invalid: str = "error") -> StringIndexer:
    """Indices by falling frequency, ties in alphabetical order."""
    return StringIndexer(
        inputCols=list(names),
        outputCols=index_names(names),
        stringOrderType="frequencyDesc",
        handleInvalid=handle_invalid,
    )


def category_encoder(names: Sequence[str], handle_invalid: str = "keep") -> Pipeline:
    """Index, then one-hot without the last slot.

    With ``keep`` the dropped slot is the one for values unseen in training, so those become all
    zeros; with ``error`` it is the rarest category.
    """
    indexer = string_indexer(names, handle_invalid)
    one_hot = OneHotEncoder(inputCols=index_names(names), outputCols=vector_names(names))
    return Pipeline(stages=[indexer, one_hot])


def fit_encoder(
    train: DataFrame,
    names: Sequence[str],
    handle_invalid: str = "keep",
    limit: int | None = None,
) -> PipelineModel:
    """The fitted encoder; with ``limit`` columns of more categories are refused first."""
    if limit is not None:
        check_categories(train, names, limit)
    return category_encoder(names, handle_invalid).fit(train)


def apply_encoder(model: PipelineModel, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the vectors; drop the indices and the raw categories."""
    return drop(model.transform(df), [*index_names(names), *names])


def fit_formula(train: DataFrame, label: str, key: str):
    """All columns but label and key as one ``features`` vector, in column order."""
    return RFormula(formula=f"{label} ~ . - {key}").fit(train)


def vector_slots(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each vector column as ``size`` and ``slots`` (slot and value of what is not 0).

    The table is stored and read again with vectors as the structs they are in Parquet, so sparse
    vectors never become arrays of their full width.
    """
    path = scratch_path(df.sparkSession, "vectors")
    write_table(df, path)
    fields = [
        T.StructField(f.name, VECTOR) if f.name in names else f for f in df.schema
    ]
    stored = read_table(df.sparkSession, path, T.StructType(fields), "parquet")
    return stored.withColumns({name: _slots_of(column(name)) for name in names})


def _slots_of(vector: Column) -> Column:
    slots = F.transform(
        vector["values"],
        lambda v, i: F.struct(F.coalesce(vector["indices"][i], i).alias("slot"), v.alias("value")),
    )
    size = F.coalesce(vector["size"], F.size(vector["values"]))
    return F.struct(
        size.alias("size"), F.filter(slots, lambda s: s["value"] != 0).alias("slots")
    )
