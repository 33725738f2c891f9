"""From the base table to tuned and compared classifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featuretable import fixed_values as V
from featuretable.models.encode import (
    apply_encoder,
    feature_vectors,
    fit_category_index,
    fit_encoder,
    fit_formula,
    slot_names,
)
from featuretable.models.metrics import model_metrics
from featuretable.models.tune import FAMILIES, grid_search
from featuretable.operators.columns import drop
from featuretable.operators.split import hash_split, with_fold
from featuretable.sources.scratch import materialize

KEY, LABEL = "business_id", "label"
CATEGORIES = ("state", "city")

# The text behind the label, and fields recomputed from reviews.
NOT_FEATURES = ("delivery_or_takeout", "count_reviews", "avg_business_stars")


@dataclass(frozen=True)
class Prepared:
    """Train and test tables with key, label and features; train has a fold as well.

    ``names`` has slot and feature where the metadata of the vectors gives their width alone.
    """

    train: DataFrame
    test: DataFrame
    names: DataFrame | None = None


def split(
    basetable: DataFrame, share: float = V.TRAIN_SHARE, seed: int = V.SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    """Stratified train and test rows, without the columns that give the label away."""
    return hash_split(drop(basetable, NOT_FEATURES), KEY, LABEL, {0: share, 1: share}, seed)


def encode(
    train: DataFrame, test: DataFrame, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """One-hot vectors for the categories, learnt from the training rows alone."""
    model = fit_encoder(train, CATEGORIES, limit=limit)
    return apply_encoder(model, train, CATEGORIES), apply_encoder(model, test, CATEGORIES)


def vectorize(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One formula, fitted on train and applied to both."""
    formula = fit_formula(train, LABEL, KEY)
    wanted = [KEY, LABEL, "features"]
    return formula.transform(train).select(wanted), formula.transform(test).select(wanted)


def vectorize_by_joins(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vectors of ``encode`` and ``vectorize`` and their slot names, with category lists that stay
    distributed: for categories that outgrow the driver."""
    index = fit_category_index(train, CATEGORIES)
    columns = [c for c in train.columns if c not in (KEY, LABEL, *CATEGORIES)] + list(CATEGORIES)
    wanted = [KEY, LABEL, "features"]
    parts = [feature_vectors(rows, columns, index).select(wanted) for rows in (train, test)]
    return parts[0], parts[1], slot_names(train.sparkSession, columns, index)


def prepare(
    basetable: DataFrame, folds: int = V.FOLDS, seed: int = V.SPLIT_SEED, by_joins: bool = False
) -> Prepared:
    """Split, encode and vectorize; ``by_joins`` keeps the category lists off the driver.

    The base table is written out first: encoder, formula and every tree level or solver step read
    it again, and none of them should rebuild it from the facts.
    """
    stored = materialize(basetable, "basetable")
    if by_joins:
        train, test, names = vectorize_by_joins(*split(stored, seed=seed))
        return Prepared(materialize(with_fold(train, KEY, folds, seed + 1), "train"), test, names)
    train, test = vectorize(*encode(*split(stored, seed=seed)))
    folded = with_fold(train, KEY, folds, seed + 1)
    return Prepared(
        materialize(folded, "train"),
        materialize(test, "test"),
    )


def fit(
    family: str,
    prepared: Prepared,
    grid: Mapping[str, Sequence] | None = None,
    folds: int = V.FOLDS,
    parallelism: int = 4,
) -> CrossValidatorModel:
    return grid_search(family, prepared.train, grid, folds, parallelism=parallelism)


def judge(family: str, fitted: CrossValidatorModel, prepared: Prepared) -> DataFrame:
    """Train and test metrics of the winning model."""
    return model_metrics(
        family, fitted.bestModel, {"train": prepared.train, "test": prepared.test}
    )


def leaderboard(metrics: Sequence[DataFrame]) -> DataFrame:
    """Test rows of all families, best first."""
    rows = reduce(DataFrame.unionByName, metrics)
    return rows.filter("part = 'test'").orderBy(F.desc("auc_raw"), "model")


def compare(
    basetable: DataFrame,
    grids: Mapping[str, Mapping[str, Sequence]] | None = None,
    folds: int = V.FOLDS,
    parallelism: int = 4,
) -> DataFrame:
    """Tune every family (on its full grid unless told otherwise) and rank them."""
    prepared = prepare(basetable, folds)
    grids = {name: None for name in FAMILIES} if grids is None else grids
    judged = [
        judge(name, fit(name, prepared, grid, folds, parallelism), prepared)
        for name, grid in grids.items()
    ]
    return leaderboard(judged)
