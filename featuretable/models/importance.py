"""Named feature importances."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featuretable.models.nested import node_importances, node_table


def feature_names(df: DataFrame, features: str = "features") -> dict[int, str]:
    """Slot to name, from the metadata of the vector column."""
    groups = df.schema[features].metadata["ml_attr"]["attrs"]
    slots = [(slot["idx"], slot["name"]) for group in groups.values() for slot in group]
    return dict(sorted(slots))


def feature_importance(
    model: Model,
    df: DataFrame,
    top: int | None = None,
    features: str = "features",
    digits: int = 2,
    names: DataFrame | None = None,
) -> DataFrame:
    """Importance of each vector slot, largest first: one row per feature, not per data row.

    Gains are added up from the stored nodes of the trees; a feature that no node uses has 0. Names come
    from the table ``names`` (slot, feature) if given, else from the metadata of the vectors.
    """
    spark = df.sparkSession
    named = names
    if named is None:
        named = spark.createDataFrame(list(feature_names(df, features).items()), "slot int, feature string")
    scores = node_importances(node_table(model, df))
    table = named.join(scores, "slot", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    ranked = table.select("slot", "feature", "importance", F.round("importance", digits).alias("importance_rounded"))
    ranked = ranked.orderBy(F.desc("importance"), "slot")
    return ranked if top is None else ranked.limit(top)
