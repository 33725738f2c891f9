"""Malformed lines, replaced tables, merged states and exact shares."""

from __future__ import annotations

import json

import pytest
from helpers import rows
from pyspark.sql import functions as F

from featuretable.operators import profile, rollup, split
from featuretable.operators.ranking import running_total_by
from featuretable.plans import basetable as B
from featuretable.sources import tables as S


# -- lines that do not fit the schema


def test_malformed_lines_are_set_aside_by_file(spark, tmp_path):
    source = tmp_path / "tips"
    source.mkdir()
    good = [json.dumps({"business_id": f"b{i}", "date": "2020-01-01", "compliment_count": i}) for i in range(5)]
    (source / "a.json").write_text("\n".join([*good, good[0][:-5], "no json", '{"compliment_count": "many"}']) + "\n")
    (source / "b.json").write_text("\n".join([good[0], '{"business_id": "only"}', "[1", ""]) + "\n")
    kept, bad = S.set_aside(S.read_lines(spark, str(source), S.tip_schema()), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert kept.columns == S.tip_schema().fieldNames()
    assert sorted(r.business_id for r in kept.collect()) == ["b0", "b0", "b1", "b2", "b3", "b4", "only"]
    assert sorted(r.line for r in bad.collect()) == sorted([good[0][:-5], "no json", '{"compliment_count": "many"}', "[1"])
    counts = {r.file.rsplit("/", 1)[1]: r.n_lines for r in S.lines_by_file(bad).collect()}
    assert counts == {"a.json": 3, "b.json": 1}
    assert not (tmp_path / "good.parsed").exists()
    # The same lines are aside whatever a query reads.
    assert kept.select("date").count() == 7


def test_no_malformed_lines(spark, tmp_path):
    spark.createDataFrame([("b", "2020-01-01", 1)], S.tip_schema()).write.json(str(tmp_path / "t"))
    kept, bad = S.set_aside(S.read_lines(spark, str(tmp_path / "t"), S.tip_schema()), str(tmp_path / "g"), str(tmp_path / "x"))
    assert kept.count() == 1 and bad.count() == 0 and S.lines_by_file(bad).count() == 0


# -- tables that are replaced


def test_a_failing_job_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    S.write_table(spark.range(10), path)
    broken = spark.range(10).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        S.write_table(broken, path)
    assert spark.read.parquet(path).count() == 10
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


@pytest.mark.parametrize("fmt", S.FORMATS)
def test_a_table_can_replace_itself(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    schema = spark.range(1).schema
    S.write_table(spark.range(10), path, fmt)
    S.write_table(S.read_table(spark, path, schema, fmt).filter("id < 4"), path, fmt)
    assert rows(S.read_table(spark, path, schema, fmt)) == [(0,), (1,), (2,), (3,)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_half_a_replacement_is_undone(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(f"{path}.previous")
    assert S.restore_table(spark, path) and spark.read.parquet(path).count() == 3
    spark.range(5).write.parquet(f"{path}.previous")  # died before the deletion
    assert not S.restore_table(spark, path)
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "t.previous").exists()


def test_appending_adds(spark, tmp_path):
    path = str(tmp_path / "t")
    S.write_table(spark.range(3), path)
    S.write_table(spark.range(2), path, mode="append")
    assert spark.read.parquet(path).count() == 5


# -- states that are merged

REVIEWS = [
    ("b1", "u1", 5.0, 1, "2020-01-01"), ("b1", "u1", 3.0, None, "2020-03-01"), ("b1", "u2", None, 2, "2019-01-01"),
    ("b2", "u1", 4.0, 0, None), ("b2", None, 1.0, 1, "2020-02-02"), ("b3", "u9", 2.0, 1, "2020-02-03"), (None, "u1", 2.0, 1, "2020-02-03"),
]
REVIEW = "business_id string, user_id string, stars double, useful long, date string"
USERS = [("u1", 1, 10, 5.0), ("u2", None, 20, 6.0), ("u3", 7, 7, 7.0)]
USER = "user_id string, fans long, review_count long, user_LOR_months double"


@pytest.mark.parametrize("unique", [False, True])
def test_loads_add_up_to_the_full_rollup(spark, unique):
    reviews, users = spark.createDataFrame(REVIEWS, REVIEW), spark.createDataFrame(USERS, USER)
    whole = B.rollup_review(reviews, users, "2020-04-01")
    state = B.review_state(reviews.limit(0))
    for i in range(0, len(REVIEWS), 2):
        state = B.add_reviews(state, spark.createDataFrame(REVIEWS[i : i + 2], REVIEW))
    found = B.review_rollup(state, users, "2020-04-01", unique)
    assert found.dtypes == whole.dtypes
    assert rows(found) == rows(whole)


def test_activity_states_add_up(spark):
    facts = spark.createDataFrame([(r[0], r[4]) for r in REVIEWS], "business_id string, date string")
    parsed = F.to_timestamp("date")
    whole = rollup.rollup_activity(facts, "business_id", "date", "2020-04-01", "n", "months", parsed)
    parts = [rollup.activity_state(facts.filter(F.crc32("date") % 2 == i if i < 2 else F.col("date").isNull()), "business_id", "date", parsed) for i in range(3)]
    merged = rollup.merge_activity(parts[0].unionByName(parts[1]).unionByName(parts[2]), "business_id")
    assert rows(rollup.finish_activity(merged, "business_id", "2020-04-01", "n", "months")) == rows(whole)


def test_a_hot_member_is_split(spark, setting):
    """A third of all facts is by one member, in as many entities."""
    setting("spark.sql.shuffle.partitions", "8")
    for name, value in {
        "autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1",
        "adaptive.maxShuffledHashJoinLocalMapThreshold": "0", "adaptive.advisoryPartitionSizeInBytes": "50k",
        "adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }.items():
        setting(f"spark.sql.{name}", value)
    facts = spark.range(0, 200_000, 1, 8).select(
        F.concat(F.lit("b"), F.col("id") % 70_001).alias("business_id"),
        F.when(F.col("id") % 3 == 0, "u0").otherwise(F.concat(F.lit("u"), F.col("id") % 5000)).alias("user_id"),
        (F.col("id") % 5).cast("double").alias("stars"), (F.col("id") % 3).alias("useful"), F.lit("2020-01-01").alias("date"),
    )
    users = spark.range(5000).select(
        F.concat(F.lit("u"), "id").alias("user_id"), (F.col("id") % 9).alias("fans"), F.col("id").alias("review_count"),
        F.lit(1.0).alias("user_LOR_months"),
    )
    sums = []
    for unique in (False, True):
        found = B.rollup_review(facts, users, "2020-04-01", unique)
        kept = found.agg(F.count("*"), F.sum("count_reviews"), F.sum(F.round("avg_reviewer_fanscount", 6)))
        sums.append(rows(kept))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan, unique
    assert sums[0] == sums[1]
    assert sums[0][0][:2] == (70_001, 200_000)


# -- exact shares and quantiles


def test_exact_split_holds_to_the_row(spark):
    table = spark.range(5000).select("id", (F.col("id") % 7).cast("int").alias("label"))
    table = table.unionAll(spark.range(5000, 5010).select("id", F.lit(None).cast("int")))
    shares = {0: 0.7, 1: 0.0, 2: 1.0, 3: 0.001, 4: 0.3333}
    train, test = split.exact_split(table, "id", "label", shares, 42)
    sizes = {r.label: r.n for r in table.groupBy("label").agg(F.count("*").alias("n")).collect()}
    found = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert found == {s: n for s, share in shares.items() if (n := int(share * sizes[s] + 0.5))}
    assert train.count() + test.count() == 5010
    # The same hash as the split by a limit: nearly the same rows.
    loose, _ = split.hash_split(table, "id", "label", shares, 42)
    assert train.join(loose, ["id", "label"], "left_anti").count() < 60


def test_exact_split_of_few_rows(spark):
    for n in (0, 1, 2, 3):
        table = spark.range(n).select("id", F.lit("x").alias("label"))
        train, test = split.exact_split(table, "id", "label", {"x": 0.5, "y": 0.5}, 1)
        assert (train.count(), test.count()) == (int(n / 2 + 0.5), n - int(n / 2 + 0.5))


def test_equal_keys_stay_together(spark):
    table = spark.range(10).select((F.col("id") % 2).alias("id"), F.lit(1).alias("label"))
    train, _ = split.exact_split(table, "id", "label", {1: 0.3}, 1)
    assert train.count() in (5, 10) and train.select("id").distinct().count() * 5 == train.count()


def test_quantiles_equal_sorted_values(spark):
    values = [3.0, 1.0, 1.0, 1.0, 9.0, None, float("nan"), -2.5, 1.0, 7.0]
    table = spark.createDataFrame([(v, i, None) for i, v in enumerate(values)], "a double, b int, c double")
    found = {r.column_name: (r.q25, r.q50, r.q90) for r in profile.describe_quantiles(table, ["a", "b", "c"], (0.25, 0.5, 0.9)).collect()}
    ordered = sorted(v for v in values if v is not None and v == v)
    pick = lambda v, q: float(v[max(1, -int(-q * len(v) // 1)) - 1])
    assert found["a"] == tuple(pick(ordered, q) for q in (0.25, 0.5, 0.9))
    assert found["b"] == tuple(pick(range(10), q) for q in (0.25, 0.5, 0.9))
    assert found["c"] == (None, None, None)


def test_running_total_in_groups(spark):
    table = spark.range(300).select((F.col("id") % 3).alias("g"), "id", F.lit(2).alias("v")).unionAll(
        spark.range(5).select(F.lit(None).cast("long"), "id", F.lit(1))
    )
    found = running_total_by(table.repartition(6), ["g"], [F.col("id").desc()], F.col("v"), "below")
    assert found.columns == ["g", "id", "v", "below"]
    for r in found.collect():
        want = 2 * len([i for i in range(300) if i % 3 == r.g and i > r.id]) if r.g is not None else 4 - r.id
        assert r.below == want


def test_merged_sketches_estimate_the_union(spark):
    table = spark.range(20_000).select("id", (F.col("id") % 10).alias("few"), F.lit(None).cast("string").alias("none"))
    parts = [profile.distinct_sketches(table.filter(F.col("id").between(a, b))) for a, b in ((0, 12_000), (8_000, 20_000))]
    merged = profile.merge_sketches(parts[0].unionByName(parts[1]))
    found = {r.column_name: r.estimate for r in profile.sketched_counts(merged).collect()}
    assert found["id"] == pytest.approx(20_000, rel=3 * profile.SKETCH_ERROR)
    assert found["few"] == 10 and found.get("none", 0) in (0, None)
