"""From raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as
the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featuretable.llm import exact_dedup, packing, quality_rules, queries, simhash, toxicity
from featuretable.sources.scratch import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; the classifier learns from all labelled ones."""
    learning = toxicity.labelled_rows(docs, queries.table(spark, sf_dir, "labels"), F.lit(True))
    model = toxicity.fit(learning)
    rows = docs.select(F.struct("*").alias("row"))
    scored = toxicity.score(rows, model, text="row", field="text", carry=("row",))
    return scored.filter(F.col("score") < 0.5).select("row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the perplexity bands of their language."""
    rows = docs.select(F.struct("*").alias("row"), "lang")
    found = quality_rules.measure(rows, text="row", field="text", carry=("row", "lang"))
    measured = materialize(found, "quality", rebalance=False)
    judged = quality_rules.judge(measured, quality_rules.bands(measured))
    return judged.filter("kept").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.vocabulary(queries.TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("packing", pack),
]

#: No SQL can express the learned stages; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
