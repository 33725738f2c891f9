from __future__ import annotations

import pytest
from helpers import rows
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from featuretable import fixed_values as V
from featuretable.models import encode, importance, metrics, tune
from featuretable.operators import split
from featuretable.plans import modelling

SHARES = {0: 0.7, 1: 0.3}


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(4000).select(
        F.concat(F.lit("k"), "id").alias("key"),
        F.when(F.col("id") % 9 == 8, None).otherwise((F.col("id") % 3 == 0).cast("int")).alias("label"),
    )


def test_hash_split_is_disjoint_complete_and_stable(labelled):
    train, test = split.hash_split(labelled, "key", "label", SHARES, 42)
    again, _ = split.hash_split(labelled.repartition(7, "label"), "key", "label", SHARES, 42)
    other, _ = split.hash_split(labelled, "key", "label", SHARES, 43)
    assert train.count() + test.count() == labelled.count()
    assert train.join(test, "key", "left_semi").count() == 0
    assert rows(train) == rows(again)
    assert rows(train) != rows(other)


def test_hash_split_keeps_the_share_of_each_stratum(labelled):
    train, _ = split.hash_split(labelled, "key", "label", SHARES, 42)
    whole = dict(split.class_balance(labelled, "label").collect())
    taken = dict(split.class_balance(train, "label").collect())
    assert None not in taken
    for label, share in SHARES.items():
        assert taken[label] / whole[label] == pytest.approx(share, abs=0.04)
    sizes = split.split_sizes(labelled, "key", "label", SHARES, 42).first()
    assert tuple(sizes) == (sum(taken.values()), sum(whole.values()) - sum(taken.values()))


def test_folds_cover_all_rows_about_evenly(labelled):
    counts = dict(split.with_fold(labelled, "key", 5, 42).groupBy("fold").count().collect())
    assert sorted(counts) == [0, 1, 2, 3, 4]
    assert max(counts.values()) < 1.2 * min(counts.values())


def test_stratified_sample_never_takes_unlabelled_rows(labelled):
    taken = dict(
        split.stratified_sample(labelled, "label", SHARES, 42).groupBy("label").count().collect()
    )
    assert set(taken) == {0, 1}


@pytest.fixture(scope="module")
def scored(spark):
    return spark.range(1000).select(
        (F.col("id") % 4 == 0).cast("int").alias("label"),
        (F.pmod(F.hash("id"), F.lit(5)) < 2).cast("double").alias("prediction"),
    )


def test_metrics_agree_with_spark(scored):
    assert metrics.auc_hard(scored).first()[0] == pytest.approx(
        BinaryClassificationEvaluator(rawPredictionCol="prediction").evaluate(scored)
    )
    assert metrics.auc_raw(scored, raw="prediction") == pytest.approx(
        metrics.auc_hard(scored).first()[0]
    )
    for row in metrics.precision_recall(scored).collect():
        for name in ("precision", "recall"):
            spark_value = MulticlassClassificationEvaluator(
                metricName=f"{name}ByLabel", metricLabel=row["class"]
            ).evaluate(scored)
            assert row[name] == pytest.approx(spark_value)


def test_a_class_that_is_never_predicted_has_precision_zero(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0), (1, 0.0)], "label int, prediction double")
    assert rows(metrics.precision_recall(df)) == [(0.0, pytest.approx(1 / 3), 1.0), (1.0, 0.0, 0.0)]
    assert rows(metrics.confusion_matrix(df)) == [(0.0, 0.0, 1), (1.0, 0.0, 2)]


@pytest.mark.parametrize("label", [0, 1])
def test_hard_auc_with_one_class_agrees_with_spark(spark, label):
    df = spark.createDataFrame([(label, 0.0), (label, 1.0)], "label int, prediction double")
    expected = BinaryClassificationEvaluator(rawPredictionCol="prediction").evaluate(df)
    assert metrics.auc_hard(df).first()[0] == pytest.approx(expected)


def test_small_and_odd_shares_are_met(spark):
    rows_ = spark.range(100_000).select("id", F.lit(1).alias("label"))
    for share in (0.0004, 0.7005):
        train, _ = split.hash_split(rows_, "id", "label", {1: share}, 42)
        spread = (100_000 * share * (1 - share)) ** 0.5
        assert abs(train.count() - 100_000 * share) < 4 * spread


def test_raw_auc_uses_all_distinct_scores(spark):
    scored_ = spark.range(20_000).select(
        (F.pmod(F.hash("id"), F.lit(3)) == 0).cast("int").alias("label"), F.rand(3).alias("score")
    )
    exact = metrics.auc_by_ranks(scored_).first()[0]
    assert metrics.auc_raw(scored_, raw="score") == pytest.approx(exact, abs=1e-12)
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert metrics.auc_by_ranks(ties).first()[0] == pytest.approx(3.5 / 4)


def test_category_index_equals_the_string_indexer(spark):
    df = spark.range(3000).select(F.concat(F.lit("k"), F.floor(F.sqrt("id"))).alias("a.b"), "id")
    found = {r[0]: r[1] for r in encode.category_index(df, "a.b").collect()}
    plain = df.withColumnRenamed("a.b", "c")
    labels = encode.string_indexer(["c"]).fit(plain).labels
    assert found == {label: float(i) for i, label in enumerate(labels)}


def test_too_many_categories_are_refused(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="categories"):
        encode.fit_encoder(df, ["c"], limit=100)


def test_unseen_categories_become_all_zero(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    model = encode.fit_encoder(train, ["c"])
    found = encode.apply_encoder(model, spark.createDataFrame([("a",), ("z",)], "c string"), ["c"])
    assert found.columns == ["c_ohe"]
    assert [row[0].toArray().tolist() for row in found.collect()] == [[1.0, 0.0], [0.0, 0.0]]


def test_vectors_by_joins_equal_those_of_the_encoder(spark, model_rows):
    train, test = modelling.split(model_rows)
    test = test.withColumn("state", F.when(F.col("business_id") % 5 > 0, F.col("state"))).withColumn(
        "city", F.when(F.col("business_id") % 7 > 0, F.col("city")).otherwise("unseen")
    )
    by_list = modelling.vectorize(*modelling.encode(train, test))
    *by_joins, names = modelling.vectorize_by_joins(train, test)
    for one, two in zip(by_list, by_joins, strict=True):
        want = {r[0]: (r.label, r.features.toArray().tolist()) for r in one.collect()}
        assert {r[0]: (r.label, r.features.toArray().tolist()) for r in two.collect()} == want
    assert by_joins[0].schema["features"].metadata == {"ml_attr": {"num_attrs": names.count()}}
    assert dict(names.collect()) == importance.feature_names(by_list[0])


def test_vectors_by_joins_of_odd_tables(spark):
    """Null categories, clashing and odd column names, no rows, a null number."""
    df = spark.createDataFrame(
        [(1, "x", None, 0.0), (2, None, "p", 2.5), (2, None, "p", 2.5)], "id int, `a.b` string, c string, n double"
    )
    index = encode.fit_category_index(df, ["a.b", "c"])
    assert index.sizes == {"a.b": 1, "c": 1}
    got = encode.feature_vectors(df, ["c", "n", "a.b"], index)
    assert got.columns == ["id", "features"]
    found = sorted((r.id, r.features.toArray().tolist()) for r in got.collect())
    assert found == [(1, [0.0, 0.0, 1.0]), (2, [1.0, 2.5, 0.0]), (2, [1.0, 2.5, 0.0])]
    names = encode.slot_names(spark, ["c", "n", "a.b"], index)
    assert rows(names) == [(0, "c_ohe_p"), (1, "n"), (2, "a.b_ohe_x")]
    none = df.limit(0)
    empty = encode.fit_category_index(none, ["c"])
    assert encode.feature_vectors(none, ["c", "n"], empty).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        encode.feature_vectors(df.withColumn("cInd", F.lit(1)), ["c"], index)
    with pytest.raises(Exception, match="fill it before"):
        encode.feature_vectors(df.withColumn("n", F.lit(None).cast("double")), ["n"], index)


def test_models_learn_from_vectors_by_joins(model_rows):
    """Same table, same scores: names come from the table of slots."""
    grid = {"maxDepth": [3]}
    found = {}
    for by_joins in (False, True):
        prepared = modelling.prepare(model_rows, folds=3, by_joins=by_joins)
        fitted = modelling.fit("decision_tree", prepared, grid, folds=3)
        table = importance.feature_importance(fitted.bestModel, prepared.train, top=1, names=prepared.names)
        board = modelling.judge("decision_tree", fitted, prepared).filter("part = 'test'").first()
        found[by_joins] = (table.first().feature, round(table.first().importance, 9), round(board.auc_raw, 9))
    assert found[False] == found[True]
    assert found[True][0] == "attributes_RestaurantsDelivery"


def test_grids_have_the_full_size():
    sizes = {
        name: len(tune.param_maps(kind.estimator(), kind.grid))
        for name, kind in tune.FAMILIES.items()
    }
    assert sizes == {"logistic_regression": 6, "decision_tree": 25, "random_forest": 18}


@pytest.fixture(scope="module")
def model_rows(spark):
    """A small base table in which delivery decides the label most of the time."""
    noisy = F.pmod(F.hash("id"), F.lit(10)) == 0
    return spark.range(600).select(
        F.col("id").alias("business_id"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("state"),
        F.concat(F.lit("c"), F.col("id") % 11).alias("city"),
        (F.col("id") % 50).alias("review_count"),
        (F.col("id") % 2).cast("int").alias("attributes_RestaurantsDelivery"),
        F.lit("TRUE").alias("delivery_or_takeout"),
        F.lit(1).alias("count_reviews"),
        F.lit(1.0).alias("avg_business_stars"),
        F.when(noisy, 1 - F.col("id") % 2).otherwise(F.col("id") % 2).cast("int").alias("label"),
    )


def test_models_from_split_to_leaderboard(spark, model_rows):
    prepared = modelling.prepare(model_rows, folds=3)
    assert prepared.train.columns == ["business_id", "label", "features", "fold"]
    names = importance.feature_names(prepared.train)
    assert list(names.values())[:2] == ["review_count", "attributes_RestaurantsDelivery"]
    assert not {"count_reviews", "fold", "business_id", "label"} & set(names.values())

    grids = {
        "logistic_regression": {"regParam": [0.1, 0.01], "maxIter": [10]},
        "decision_tree": {"maxDepth": [2]},
        "random_forest": {"numTrees": [5], "maxDepth": [3]},
    }
    fitted = {
        name: modelling.fit(name, prepared, grid, folds=3) for name, grid in grids.items()
    }
    table = tune.cv_metrics(spark, "logistic_regression", fitted["logistic_regression"])
    assert table.count() == 2
    assert all(0.8 < row.mean_auc <= 1.0 for row in table.collect())
    best = dict(
        tune.best_params(spark, "random_forest", fitted["random_forest"])
        .select("param", "value")
        .collect()
    )
    assert best == {"numTrees": "5", "maxDepth": "3"}

    ranked = importance.feature_importance(
        fitted["random_forest"].bestModel, prepared.train, top=5
    ).collect()
    assert len(ranked) == 5
    assert ranked[0].feature == "attributes_RestaurantsDelivery"
    assert ranked[0].importance_rounded == round(ranked[0].importance, 2)

    judged = [modelling.judge(name, model, prepared) for name, model in fitted.items()]
    board = modelling.leaderboard(judged).collect()
    assert {row.model for row in board} == set(grids)
    assert [row.auc_raw for row in board] == sorted((row.auc_raw for row in board), reverse=True)
    assert all(0.8 < row.auc_hard <= 1.0 for row in board)


def test_folds_and_features_do_not_depend_on_partitioning(model_rows):
    one = modelling.prepare(model_rows, folds=3)
    two = modelling.prepare(model_rows.repartition(9), folds=3)
    assert rows(one.train) == rows(two.train)
    assert rows(one.test) == rows(two.test)


def test_defaults_are_the_full_setup():
    assert (V.FOLDS, V.TRAIN_SHARE, V.SPLIT_SEED) == (10, 0.7, 42)
