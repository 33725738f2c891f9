"""Exact duplicates with a heavy-hitter split, DataFrame functions only.

1. Digests: SHA-256 of the text with A-Z in lower case, one row per document, written once; everything
   after works on these short rows.
2. Candidates for frequent digests: ``approx_top_k``, Spark's frequent-items sketch, a Misra-Gries summary
   with at most ``TRACKED`` counters in each task and after merging. Every digest with more than
   ``rows / TRACKED`` copies (about) is among them; at most ``WINNERS`` come out.
3. The candidates' exact counts and largest ids come from one aggregation that combines in the
   tasks before it shuffles. Verified winners (really repeated) are at most ``WINNERS`` rows and are
   broadcast: rows with such a digest get their group's values in place, without a shuffle.
4. The remaining digests, none of which is frequent, are grouped and joined by digest.

Which of equal texts stays: the largest id; a null id loses to any other. Of rows that share text and
id (repeated rows) one stays: the one with the smallest row number given when digests were written.

Edge cases: null texts count as empty and are duplicates of empty ones. An empty table gives an empty
result. Long texts are hashed whole. Extra columns are ignored; ours are chosen by position.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featuretable.functions.predicates import column
from featuretable.llm.joins import without, wrapped
from featuretable.sources.scratch import materialize

TRACKED = 16_384
WINNERS = 1_024


def normalised(text: Column) -> Column:
    """The text with ASCII capitals in lower case; null is empty."""
    return F.translate(
        F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase
    )


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, digest, row`` of every document, stored."""
    rows = docs.select(
        column(doc_id).alias("doc_id"),
        digest(column(text)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    return materialize(rows, "digests")


def frequent(rows: DataFrame) -> DataFrame:
    """``digest, best, n`` of the verified frequent digests: at most ``WINNERS`` rows."""
    key = F.hex("digest")
    found = rows.agg(
        F.call_function("approx_top_k", key, F.lit(WINNERS), F.lit(TRACKED)).alias("top")
    )
    candidates = found.select(F.explode("top").alias("c")).select(F.unhex("c.item").alias("digest"))
    exact = rows.join(F.broadcast(candidates), "digest", "left_semi")
    return grouped(exact).filter(F.col("n") > 1)


def grouped(rows: DataFrame) -> DataFrame:
    """Per digest: the row that stays (largest id, nulls last, then smallest row number) and the size."""
    return rows.groupBy("digest").agg(
        F.max(F.struct("doc_id", (-F.col("row")).alias("back"))).alias("best"),
        F.count(F.lit(1)).alias("n"),
    )


def decide(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, digest``."""
    rows = digests(docs, text, doc_id)
    heavy = materialize(frequent(rows), "frequent")
    of_heavy = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    of_rest = rest.join(grouped(rest), "digest")
    return of_heavy.unionByName(of_rest).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == -F.col("best.back")).alias("kept"),
        "digest",
    )


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all columns.

    Only the ids that go are joined to the texts. Repeated rows (same id and text) cannot be told
    apart by id; where there are any, one of each is taken after the join.
    """
    decided = materialize(decide(docs, text, doc_id), "decided")
    ids = decided.groupBy("doc_id").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    ids = ids.withColumnRenamed("doc_id", "id")
    unclear = ids.filter((F.col("n") > 1) | F.col("id").isNull()).select("id")
    if unclear.isEmpty():
        return without(docs, doc_id, ids.filter(~F.col("stays")).select("id"))
    gone = ids.filter(~F.col("stays") & (F.col("n") == 1) & F.col("id").isNotNull()).select("id")
    rows = wrapped(docs, doc_id).withColumn("digest", digest(F.col("row").getField(text)))
    known = F.col("id").eqNullSafe(F.col("id_"))
    clear = rows.join(gone.union(unclear).select(F.col("id").alias("id_")), known, "left_anti")
    stays = decided.filter("kept").select(F.col("doc_id").alias("id_"), F.col("digest").alias("digest_"))
    rest = rows.join(unclear.select(F.col("id").alias("id_")), known, "left_semi")
    rest = rest.join(stays, known & (F.col("digest") == F.col("digest_")), "left_semi")
    return clear.union(rest.dropDuplicates(["id", "digest"])).select("row.*")
