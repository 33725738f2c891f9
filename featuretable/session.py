"""Session settings the operators rely on for large, skewed inputs."""

from __future__ import annotations

from pyspark.sql import SparkSession

SCALE_SETTINGS = {
    # Dates are compared at day precision, so every session must agree on the zone.
    "spark.sql.session.timeZone": "UTC",
    # Shuffle widths are chosen at run time: start wide, then merge to the advisory size.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # A key holding a third of a table is split at the join, even if that costs a shuffle later.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Broadcast only what Spark has measured to be below this size; all else is a sort-merge join.
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    # Where every partition of one side is this small, hash it and skip both sorts.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Large facts are thinned at the scan by a Bloom filter of the keys an inner join will keep.
    # The filter has a fixed size (10 MB), however many keys go into it.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256m",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "10000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "10000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "83886080",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "83886080",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(app_name: str, master: str | None = None, **extra: str) -> SparkSession:
    """Session with ``SCALE_SETTINGS``; ``extra`` keys use ``__`` for dots.

    ``spark.sql.shuffle.partitions`` is left to the caller: about two to three times the
    total cores on a cluster (the upper bound that AQE merges down from), the core count locally.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for name, value in SCALE_SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in extra.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()
