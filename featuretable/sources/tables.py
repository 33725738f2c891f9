"""JSON and Parquet tables with explicit schemas."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featuretable.functions.predicates import column

FORMATS = ("parquet", "json")


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    fmt: str = "json",
    required: Sequence[str] = (),
) -> DataFrame:
    """Scan a table. With a schema only its fields are decoded and no inference job runs.

    JSON leaves out null fields when written, so a column that is null throughout comes back
    only if the schema names it. A field that the files do not have reads as null as well: columns
    named in ``required`` are counted in one pass, and one that holds no value is an error.
    """
    _check_format(fmt)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    table = reader.load(path)
    if required:
        counts = [F.count(column(name)).alias(f"n{i}") for i, name in enumerate(required)]
        found = table.agg(F.count(F.lit(1)).alias("rows"), *counts).first()
        empty = [name for i, name in enumerate(required) if not found[f"n{i}"]]
        if found["rows"] and empty:
            raise ValueError(f"no value at all in {empty} of {path}")
    return table


CORRUPT = "_malformed_line"


def read_lines(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON lines by a schema, with their file, and with the whole line where it does not fit the schema.

    Such a line is cut off, no JSON, or has a value of another type. Which lines these are depends on the
    columns that a query reads, so :func:`set_aside` should store the rows before they are used.
    """
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(whole).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.withColumn("_file", F.col("_metadata.file_path"))


def set_aside(rows: DataFrame, good_path: str, bad_path: str) -> tuple[DataFrame, DataFrame]:
    """Store the rows of :func:`read_lines` apart: well-formed ones, and ``file, line`` of the others.

    Both tables are Parquet and replace what is there. The source is parsed once, into a table beside the good one
    that is split by a column; the result is read back.
    """
    spark = rows.sparkSession
    both = f"{good_path.rstrip('/')}.parsed"
    rows.write.mode("overwrite").parquet(both)
    stored = spark.read.schema(rows.schema).parquet(both)
    bad = F.col(CORRUPT).isNotNull()
    write_table(stored.filter(~bad).drop(CORRUPT, "_file"), good_path)
    write_table(stored.filter(bad).select(F.col("_file").alias("file"), F.col(CORRUPT).alias("line")), bad_path)
    _delete(spark, both)
    kept = T.StructType([f for f in rows.schema if f.name not in (CORRUPT, "_file")])
    return spark.read.schema(kept).parquet(good_path), spark.read.schema("file string, line string").parquet(bad_path)


def lines_by_file(malformed: DataFrame) -> DataFrame:
    """Number of malformed lines of each file that has any."""
    return malformed.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table, by default replacing what is there (see :func:`replace_table`)."""
    _check_format(fmt)
    if mode == "overwrite":
        replace_table(df, path, fmt)
    else:
        df.write.format(fmt).mode(mode).save(path)


def replace_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table beside its path, then put it in the place of what is there.

    A job that fails leaves the old table as it was, and so does a new table that cannot be read back. The old
    one is moved to ``path.previous`` and deleted last; if a driver dies between the two moves, the next
    replacement (or :func:`restore_table`) moves it back. A table may be replaced by one that is read from it.
    """
    _check_format(fmt)
    spark = df.sparkSession
    path = path.rstrip("/")
    restore_table(spark, path)
    if not _exists(spark, path):
        df.write.format(fmt).mode("errorifexists").save(path)
        return
    staged = f"{path}.{uuid.uuid4().hex}"
    try:
        df.write.format(fmt).save(staged)
        spark.read.format(fmt).schema(df.schema).load(staged).count()
    except BaseException:
        _delete(spark, staged)
        raise
    _move(spark, path, f"{path}.previous")
    _move(spark, staged, path)
    _delete(spark, f"{path}.previous")


def restore_table(spark: SparkSession, path: str) -> bool:
    """Undo half of a replacement: the old table returns if there is no new one, else it is deleted."""
    path = path.rstrip("/")
    if not _exists(spark, f"{path}.previous"):
        return False
    if _exists(spark, path):
        _delete(spark, f"{path}.previous")
        return False
    _move(spark, f"{path}.previous", path)
    return True


def _files(spark: SparkSession, path: str):
    """The path as Hadoop has it, and its file system: any store that Spark writes to."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    found, files = _files(spark, path)
    return files.exists(found)


def _delete(spark: SparkSession, path: str) -> None:
    found, files = _files(spark, path)
    files.delete(found, True)


def _move(spark: SparkSession, source: str, target: str) -> None:
    found, files = _files(spark, source)
    if not files.rename(found, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{source} cannot be moved to {target}")


def _check_format(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


def business_schema(attributes: list[str] | tuple[str, ...]) -> T.StructType:
    """Business rows; attribute names carry dots in the raw files."""
    return T.StructType(
        _fields(T.StringType(), "business_id", "name", "categories", "city", "state")
        + _fields(T.LongType(), "is_open", "review_count")
        + _fields(T.DoubleType(), "stars")
        + _fields(T.StringType(), *attributes)
    )


def checkin_schema() -> T.StructType:
    """One row per visit."""
    return T.StructType(_fields(T.StringType(), "business_id", "date"))


def covid_schema() -> T.StructType:
    return T.StructType(
        _fields(T.StringType(), "business_id", "Temporary Closed Until", "delivery or takeout")
    )


def user_schema(since: str) -> T.StructType:
    """``since`` names the column with the day the user joined."""
    return T.StructType(
        _fields(T.StringType(), "user_id", since)
        + _fields(T.DoubleType(), "average_stars")
        + _fields(T.LongType(), "fans", "review_count")
    )


def review_schema() -> T.StructType:
    return T.StructType(
        _fields(T.StringType(), "review_id", "business_id", "user_id", "date")
        + _fields(T.DoubleType(), "stars")
        + _fields(T.LongType(), "cool", "funny", "useful")
    )


def tip_schema() -> T.StructType:
    return T.StructType(
        _fields(T.StringType(), "business_id", "date") + _fields(T.LongType(), "compliment_count")
    )
