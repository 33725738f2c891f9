"""Connected components by alternating large-star and small-star rounds.

Every round is an aggregation and a join on the edges that are left, written to the shared folder, so
that neither lineage nor any list of links or members grows on the driver or in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featuretable.sources.scratch import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round on distinct edges ``a > b``."""
    both = edges
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        new = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return new.filter(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    ).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has a link; the root is the smallest node of its component.

    Links may repeat, stand in either direction, or join a node with itself.
    """
    x, y = F.col(a), F.col(b)
    edges = links.filter(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    edges = materialize(edges.distinct(), "links")
    before = _state(edges)
    while before[0]:
        edges = materialize(_star(_star(edges, True), False), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
