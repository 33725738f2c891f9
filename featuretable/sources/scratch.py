"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import functools
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

from featuretable.functions.predicates import column
from featuretable.sources.tables import read_table, write_table

SETTING = "spark.checkpoint.dir"

_written: list[str] = []


@functools.cache
def _own_local_folder() -> str:
    return tempfile.mkdtemp(prefix="featuretable-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table under the session's ``spark.checkpoint.dir``.

    Where the setting is missing, a local session (tests) gets a folder of its own; a cluster
    session is refused, because a folder on one machine would be lost with that machine. A
    ``file:`` folder on a cluster gives a warning: only a mount that all machines share will do.
    """
    root = spark.conf.get(SETTING, None)
    local = spark.sparkContext.master.startswith("local")
    if not root:
        if not local:
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        root = _own_local_folder()
    elif not local and (root.startswith("file:") or root.startswith("/")):
        warnings.warn(f"{SETTING} is {root}: all machines have to share that folder", stacklevel=2)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def remove_written(spark: SparkSession) -> None:
    """Delete the intermediate tables of this driver; for jobs, when their results are written."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(
    df: DataFrame, name: str, fmt: str = "parquet", rebalance: bool = True, by: str | None = None
) -> DataFrame:
    """Write a table once and read it back: later jobs start from files, not from the lineage.

    Unlike cached blocks the files survive the loss of executors. The rows are rebalanced on the
    way, so that jobs which read the table many times find evenly filled files of a useful size
    (unless told not to, where the partitioning itself matters). With ``by``, each value of that column
    has files of its own (Parquet alone), and a filter on it reads no others.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    rows = df.hint("rebalance", *([by] if by else [])) if rebalance else df
    if fmt == "parquet":
        # Written once and read a few times, on disks that many such tables share.
        rows.write.option("compression", "zstd").parquet(path, partitionBy=by)
    else:
        write_table(rows, path, fmt)
    stored = read_table(spark, path, df.schema, fmt)
    return stored if by is None else stored.select(*(column(name) for name in df.columns))
