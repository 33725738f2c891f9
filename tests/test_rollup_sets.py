from __future__ import annotations

import datetime as dt
import random

import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from featuretable.operators.assemble import left_assemble, left_join, require_unique
from featuretable.operators.rollup import rollup_activity, rollup_with_members
from featuretable.operators.sets import dedup_by_key, set_difference

DAY = "2020-04-01"


def member_rollup(facts, members):
    return rollup_with_members(
        facts, members, entity="b", member="u", date="d", reference=DAY,
        fact_averages={"avg_s": "s"}, member_averages={"avg_f": "f"},
        count_of="s", count_as="n", distinct_as="n_u", recency_as="months",
    )


def test_activity_counts_dated_rows_and_takes_the_latest(spark):
    facts = spark.createDataFrame(
        [("a", dt.date(2020, 3, 1)), ("a", dt.date(2019, 4, 1)), ("a", None), ("b", None)],
        "b string, d date",
    )
    found = rollup_activity(facts, "b", "d", DAY, "n", "months")
    assert rows(found) == [("a", 2, 1.0), ("b", 0, None)]


def test_member_rollup_equals_join_then_aggregate(spark):
    """Half of all facts belong to one business, a third of the rest to one user."""
    draw = random.Random(7)
    facts = [
        (
            "hot" if draw.random() < 0.5 else f"b{draw.randrange(20)}",
            None if draw.random() < 0.05 else ("u0" if draw.random() < 0.3 else f"u{draw.randrange(40)}"),
            dt.date(2015, 1, 1) + dt.timedelta(days=draw.randrange(1900)),
            None if draw.random() < 0.1 else draw.randrange(1, 6),
        )
        for _ in range(3000)
    ]
    # Some users are unknown, some have no value.
    members = {f"u{i}": (None if i % 7 == 0 else i) for i in range(30)}
    found = {
        r.b: r
        for r in member_rollup(
            spark.createDataFrame(facts, "b string, u string, d date, s int"),
            spark.createDataFrame(list(members.items()), "u string, f int"),
        ).collect()
    }
    assert len(found) == len({f[0] for f in facts})
    for business, row in found.items():
        own = [f for f in facts if f[0] == business]
        stars = [f[3] for f in own if f[3] is not None]
        fans = [members[f[1]] for f in own if members.get(f[1]) is not None]
        assert row.avg_s == pytest.approx(sum(stars) / len(stars))
        assert row.avg_f == (pytest.approx(sum(fans) / len(fans)) if fans else None)
        assert row.n == len(stars)
        assert row.n_u == len({f[1] for f in own if f[1] is not None})


def test_left_join_keeps_facts_and_refuses_shared_columns(spark):
    facts = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    dim = spark.createDataFrame([(1, "one")], "k int, name string")
    assert rows(left_join(facts, dim, "k")) == rows(
        spark.createDataFrame([(1, "x", "one"), (2, "y", None), (None, "z", None)], "k int, v string, n string")
    )
    with pytest.raises(ValueError, match="v"):
        left_join(facts, facts, "k")


def test_assembly_keeps_one_row_per_base_row(spark):
    base = spark.range(5).withColumnRenamed("id", "k")
    tables = [
        spark.createDataFrame([(1, 10)], "k long, a int"),
        spark.createDataFrame([(1, 1), (3, 3)], "k long, b int"),
    ]
    assert rows(left_assemble(base, "k", tables)) == sorted(
        [(0, None, None), (1, 10, 1), (2, None, None), (3, None, 3), (4, None, None)], key=repr
    )


def test_uniqueness_is_enforced(spark):
    good = spark.range(3)
    assert require_unique(good, "id") is good
    with pytest.raises(ValueError, match="not unique"):
        require_unique(good.union(good), "id")


PAIRS = st.lists(st.tuples(st.sampled_from([1, 2, 3, None]), st.sampled_from(["x", "y", None])), max_size=20)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(full=PAIRS, part=PAIRS)
def test_set_difference_is_except_distinct(spark, full, part):
    schema = "`a.b` int, c string"
    found = set_difference(spark.createDataFrame(full, schema), spark.createDataFrame(part, schema))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(set(full) - set(part), key=repr)


def test_set_difference_accepts_vectors(spark):
    from pyspark.ml.linalg import Vectors

    full = spark.createDataFrame(
        [(1, Vectors.dense([1.0, 0.0])), (1, Vectors.dense([1.0, 0.0])), (2, Vectors.sparse(2, [], []))],
        ["id", "v"],
    )
    assert [r.id for r in set_difference(full, full.filter("id = 2")).collect()] == [1]


def test_dedup_keeps_the_first_and_settles_ties(spark):
    data = [("a", 2, "p"), ("a", 1, "q"), ("a", 1, "b"), ("b", None, "z"), ("b", 1, "y")]
    df = spark.createDataFrame(data, "k string, o int, rest string")
    expected = [("a", 1, "b"), ("b", None, "z")]
    assert rows(dedup_by_key(df, "k", "o")) == expected
    assert rows(dedup_by_key(df.repartition(7, "rest"), "k", "o")) == expected
    assert dedup_by_key(df, "k", "o").columns == df.columns
