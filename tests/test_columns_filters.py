from __future__ import annotations

import pytest
from helpers import rows

from featuretable.operators import columns, filters


@pytest.fixture
def dotted(spark):
    return spark.createDataFrame(
        [("a", "True", "9-17", None), ("b", None, None, 1.0)],
        "id string, `attributes.Kids` string, `hours.Monday` string, `open until` double",
    )


def test_names_lose_dots_and_spaces(dotted):
    named = columns.replace_in_names(dotted, {".": "_", " ": "_"})
    assert named.columns == ["id", "attributes_Kids", "hours_Monday", "open_until"]
    assert rows(named) == rows(dotted)


def test_colliding_names_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, a_b int")
    with pytest.raises(ValueError, match="a_b"):
        columns.replace_in_names(df, {".": "_"})


def test_selecting_by_part_of_the_name_and_by_list(dotted):
    assert columns.select_matching(dotted, "hours", ["id"]).columns == ["hours.Monday", "id"]
    assert columns.keep(dotted, ["open until", "id"]).columns == ["open until", "id"]
    assert columns.drop(dotted, ["hours.Monday", "not there"]).columns == [
        "id", "attributes.Kids", "open until",
    ]
    assert columns.key_first(dotted, "open until").columns[0] == "open until"
    assert columns.rename(dotted, {"id": "key"}).columns[0] == "key"


def test_any_contains_is_case_sensitive_and_drops_null(spark):
    df = spark.createDataFrame(
        [(1, "Food, Bars"), (2, "fast food"), (3, None), (4, "Sports Bars"), (5, "Shoes")],
        "id int, c string",
    )
    assert rows(filters.where_any_contains(df, "c", ["Food", "Bars"]).select("id")) == [(1,), (4,)]


def test_equality_drops_null_and_other_case(spark):
    df = spark.createDataFrame([(1, "FALSE"), (2, "False"), (3, None)], "id int, c string")
    assert rows(filters.where_equals(df, "c", "FALSE").select("id")) == [(1,)]


def test_incomplete_rows_go_for_null_and_nan(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a"), (2, float("nan"), "a"), (3, None, "a"), (4, 1.0, None)],
        "id int, `x.y` double, s string",
    )
    assert rows(filters.drop_incomplete(df)) == [(1, 1.0, "a")]
    assert rows(filters.drop_incomplete(df, ["s"]).select("id")) == [(1,), (2,), (3,)]
