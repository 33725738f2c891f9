from __future__ import annotations

import pytest
from helpers import rows
from pyspark.errors import PySparkException

from featuretable.operators import impute, profile

NAN = float("nan")


@pytest.fixture
def wide(spark):
    return spark.createDataFrame(
        [
            (1, True, 1.5, "x", None, "same", "it's"),
            (2, False, NAN, None, None, "same", None),
            (3, None, None, "x", None, None, "b"),
            (4, True, 2.5, "y", None, "same", "b"),
        ],
        "id int, flag boolean, `d.x` double, s string, empty string, fixed string, `it's` string",
    )


def test_null_audit_counts_null_and_nan_by_type(wide):
    found = profile.null_audit(wide).first().asDict()
    assert found == {"id": 0, "flag": 1, "d.x": 2, "s": 1, "empty": 4, "fixed": 1, "it's": 1}


def test_empty_columns_are_listed_and_dropped(wide):
    assert rows(profile.all_null_columns(wide)) == [("empty",)]
    assert profile.drop_all_null_columns(wide).columns == [
        "id", "flag", "d.x", "s", "fixed", "it's",
    ]


def test_constant_columns(wide):
    assert rows(profile.constant_columns(wide)) == [("fixed",)]
    assert rows(profile.constant_columns(wide, ["id", "s"])) == []


def test_distinct_profile_exact_and_estimated(wide):
    expected = {"id": 4, "flag": 2, "d.x": 3, "s": 2, "empty": 0, "fixed": 1, "it's": 2}
    assert dict(profile.distinct_profile(wide).collect()) == expected
    assert dict(profile.distinct_profile(wide, rsd=0.02).collect()) == expected
    assert dict(profile.distinct_profile(wide, ["s"]).collect()) == {"s": 2}
    assert rows(profile.distinct_count(wide, "d.x", "n")) == [(3,)]


def test_shape_values_and_keys(wide):
    assert rows(profile.table_shape(wide)) == [(4, 7)]
    assert rows(profile.distinct_values(wide, "flag")) == [(False,), (None,), (True,)]
    assert rows(profile.key_uniqueness(wide, "id")) == [(4, 4, True)]
    assert rows(profile.key_uniqueness(wide, "s")) == [(4, 2, False)]
    assert rows(profile.key_uniqueness(wide.filter("id > 9"), "id")) == [(0, 0, True)]


def test_describe(wide):
    assert rows(profile.describe_numeric(wide, ["id"])) == [
        ("id", 4, 2.5, pytest.approx(1.2909944487), 1.0, 4.0)
    ]
    assert rows(profile.describe_text(wide, ["s"])) == [("s", 3, "x", "y")]


def test_derived_against_source(spark):
    df = spark.createDataFrame([(1, 5, 3), (2, 1, None)], "k int, derived int, source int")
    assert rows(profile.derived_vs_source(df, "k", [("derived", "source")])) == [
        (1, 5, 3, 2), (2, 1, None, None),
    ]


def test_fill_constant_touches_numbers_and_nan_only(wide):
    found = impute.fill_constant(wide, 0, ["`d.x`"]).select("id", "`d.x`")
    assert rows(found) == [(1, 1.5), (2, 0.0), (3, 0.0), (4, 2.5)]


def test_fill_with_max_uses_each_columns_own_maximum(spark):
    df = spark.createDataFrame(
        [(1, 3.0, 10), (2, None, None), (3, NAN, 7), (4, 1.0, None)], "id int, a double, b int"
    )
    expected = [(1, 3.0, 10), (2, 3.0, 10), (3, 3.0, 7), (4, 1.0, 10)]
    assert rows(impute.fill_with_max(df, ["a", "b"])) == expected
    assert impute.fill_with_max(df, ["a", "b"]).dtypes == df.dtypes


def test_fill_with_max_fails_without_any_value(spark):
    df = spark.createDataFrame([(1, None)], "id int, a double")
    with pytest.raises(PySparkException, match="cannot fill a"):
        impute.fill_with_max(df, ["a"]).collect()


def test_loss_report(wide):
    found = {r.column_name: tuple(r)[1:] for r in impute.loss_report(wide.drop("empty")).collect()}
    assert found["d.x"] == (2, 4, 2)
    assert found["id"] == (0, 4, 2)
    assert found["it's"] == (1, 4, 2)
