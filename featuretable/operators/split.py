"""Stratified samples, splits and folds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featuretable.functions.predicates import column
from featuretable.operators.reports import count_by
from featuretable.sources.scratch import materialize

STEP_BITS = 12
HASH_DIGITS = 15  # hexadecimal: 60 bits, so that any share is met to one part in 10^18


def hash_number(key: Column, seed: int, digits: int = HASH_DIGITS) -> Column:
    """A number that depends on key and seed only, never on partitioning or row order."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def hash_bucket(key: Column, seed: int, buckets: int) -> Column:
    """The number of one of ``buckets`` even buckets."""
    return F.pmod(hash_number(key, seed, 8), F.lit(buckets))


def in_train(key: Column, label: Column, fractions: Mapping[object, float], seed: int) -> Column:
    """True for the sampled share of each stratum; strata without a fraction are never sampled."""
    limit = F.lit(0).cast("bigint")
    for stratum, share in fractions.items():
        below = F.lit(int(share * 16**HASH_DIGITS)).cast("bigint")
        limit = F.when(label == F.lit(stratum), below).otherwise(limit)
    return F.coalesce(hash_number(key, seed) < limit, F.lit(False))


def hash_split(
    df: DataFrame, key: str, label: str, fractions: Mapping[object, float], seed: int
) -> tuple[DataFrame, DataFrame]:
    """Stratified train and test tables.

    A row's side is a function of its key, so both tables are plain filters: nothing is shuffled,
    they are disjoint and complete, and a recomputed task gives the same rows again.
    """
    chosen = in_train(column(key), column(label), fractions, seed)
    return df.filter(chosen), df.filter(~chosen)


def exact_limits(
    df: DataFrame, key: str, label: str, fractions: Mapping[object, float], seed: int
) -> dict[object, int]:
    """Per stratum the hash below which exactly its share of the rows (rounded) lies.

    A distributed selection: a histogram of the leading bits of the hash says in which bucket the limit
    lies, and the next bits are counted in that bucket alone. A pass brings at most ``2 ** STEP_BITS``
    counts for each stratum to the driver, and few passes are needed, since buckets shrink 4,096-fold.
    Rows with equal keys have equal hashes and stay together, so shares are exact where keys are unique.
    """
    hashed = df.select(column(label).alias("label"), hash_number(column(key), seed).alias("hash"))
    hashed = materialize(hashed.filter(F.col("label").isin(list(fractions))), "hashes")
    sizes = {r["label"]: r["n"] for r in count_by(hashed, "label", name="n", order="none").collect()}
    wanted = {s: int(share * sizes.get(s, 0) + 0.5) for s, share in fractions.items()}
    limits = {s: 0 for s in fractions if not wanted[s]}
    limits |= {s: 16**HASH_DIGITS for s in fractions if wanted[s] and wanted[s] == sizes[s]}
    still = {s: (0, wanted[s]) for s in fractions if s not in limits}  # leading bits, rows yet to find
    for shift in range(4 * HASH_DIGITS - STEP_BITS, -1, -STEP_BITS):
        if not still:
            break
        inside = F.lit(False)
        for stratum, (prefix, _) in still.items():
            leading = F.shiftright("hash", shift + STEP_BITS) == prefix
            inside = inside | ((F.col("label") == F.lit(stratum)) & leading)
        counts = hashed.filter(inside).groupBy("label", F.shiftright("hash", shift).alias("bucket"))
        histogram: dict[object, list[tuple[int, int]]] = {}
        for r in counts.agg(F.count(F.lit(1)).alias("n")).collect():
            histogram.setdefault(r["label"], []).append((r["bucket"], r["n"]))
        for stratum, (_, left) in list(still.items()):
            for bucket, n in sorted(histogram[stratum]):
                if left <= n:
                    break
                left -= n
            still[stratum] = (bucket, left)
            if left == n or shift == 0:
                limits[stratum] = (bucket + 1) << shift
                del still[stratum]
    return limits


def exact_split(
    df: DataFrame, key: str, label: str, fractions: Mapping[object, float], seed: int
) -> tuple[DataFrame, DataFrame]:
    """Like :func:`hash_split`, but with shares that hold to the row in every stratum."""
    chosen = F.lit(False)
    for stratum, limit in exact_limits(df, key, label, fractions, seed).items():
        chosen = chosen | ((column(label) == F.lit(stratum)) & (hash_number(column(key), seed) < F.lit(limit)))
    chosen = F.coalesce(chosen, F.lit(False))
    return df.filter(chosen), df.filter(~chosen)


def with_fold(df: DataFrame, key: str, folds: int, seed: int, name: str = "fold") -> DataFrame:
    """Add a fold number for cross-validation, again from the key alone."""
    return df.withColumn(name, hash_bucket(column(key), seed, folds).cast("int"))


def stratified_sample(
    df: DataFrame, label: str, fractions: Mapping[object, float], seed: int
) -> DataFrame:
    """Spark's own stratified sample. Which rows it takes depends on the partitioning."""
    return df.sampleBy(label, dict(fractions), seed)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return count_by(df, label, name="n", order="none")


def split_sizes(
    df: DataFrame, key: str, label: str, fractions: Mapping[object, float], seed: int
) -> DataFrame:
    """Observations on both sides of the hash split, in one pass."""
    chosen = in_train(column(key), column(label), fractions, seed)
    return df.agg(F.count_if(chosen).alias("n_train"), F.count_if(~chosen).alias("n_test"))
