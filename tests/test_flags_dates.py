from __future__ import annotations

import datetime as dt

import pytest
from helpers import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from featuretable import fixed_values as V
from featuretable.functions import dates, flags
from featuretable.functions.numbers import percentage


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def column(df, expression):
    return [r[1] for r in sorted(df.select("i", expression.alias("x")).collect())]


def test_equality_flag(spark):
    df = texts(spark, "True", "False", "None", None, "true", " True")
    assert column(df, flags.equals_flag(F.col("t"))) == [1, 0, 0, 0, 0, 0]


@pytest.mark.parametrize(
    ("flag", "ones", "zeros"),
    [
        ("doesnt_serve_alcohol", ["u'none'", "none"], ["None", "u'full_bar'", None]),
        ("has_ambience", ["{'casual': True}"], ["{'casual': False}", "None", None]),
        ("has_age_restrict", ["u'21plus'"], ["u'allages'", None]),
        ("allows_smoking", ["yes", "u'outdoor'"], ["no", "Yes", None]),
        ("has_wifi", ["u'free'", "paid"], ["u'no'", None]),
    ],
)
def test_special_flags(spark, flag, ones, zeros):
    terms = next(t for name, _, t in V.SPECIAL_FLAGS if name == flag)
    df = texts(spark, *ones, *zeros)
    expected = [1] * len(ones) + [0] * len(zeros)
    assert column(df, flags.contains_flag(F.col("t"), *terms)) == expected
    assert column(df, flags.pattern_flag(F.col("t"), "|".join(terms))) == expected


def test_number_or_default(spark):
    df = texts(spark, "1", "None", None, "3.5")
    assert column(df, flags.number_or_default(F.col("t"), 2.5)) == [1.0, 2.5, 2.5, 3.5]
    odd = texts(spark, "cheap")
    assert column(odd, flags.number_or_default(F.col("t"), 2.5, lenient=True)) == [2.5]
    with pytest.raises(PySparkException):
        odd.select(flags.number_or_default(F.col("t"), 2.5)).collect()


def test_relabel_works_on_integer_and_double_flags(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0)], "i int, d double")
    names = {"0": "Not Good", "1": "Good"}
    for source in ("i", "d"):
        assert column(df, flags.relabel(F.col(source), names)) == ["Not Good", "Good"]


def test_days_from_text(spark):
    df = texts(
        spark, "2020-04-01 10:20:30", "2020-4-1 1:2:3", "2020-02-29", " 2020-04-01 00:00:00.5 x",
        "2021-02-29", "soon", "", None,
    )
    first = dt.date(2020, 4, 1)
    assert column(df, dates.parse_day(F.col("t"))) == [
        first, first, dt.date(2020, 2, 29), first, None, None, None, None,
    ]
    assert column(df, dates.parse_day(F.col("t"), with_time=True)) == [
        first, first, None, first, None, None, None, None,
    ]
    with pytest.raises(PySparkException):
        texts(spark, "soon").select(dates.parse_day(F.col("t"), strict=True)).collect()


def test_recency_ignores_and_tenure_keeps_the_time_of_day(spark):
    df = spark.createDataFrame(
        [
            (0, dt.datetime(2020, 3, 1, 23, 59)), (1, dt.datetime(2020, 1, 31)),
            (2, dt.datetime(2019, 10, 17)), (3, None),
            # 15.5 of 31 days: the half is only reached with the time of day.
            (4, dt.datetime(2020, 3, 16, 12)),
        ],
        "i int, t timestamp",
    )
    assert column(df, dates.recency_months("2020-04-01", F.col("t"))) == [1.0, 2.0, 5.0, None, 1.0]
    assert column(df, dates.tenure_months("2020-04-01", F.col("t"))) == [1.0, 2.0, 5.0, None, 1.0]
    late = df.filter("i = 4").withColumn("t", F.col("t") + F.expr("INTERVAL 1 HOUR"))
    assert column(late, dates.recency_months("2020-04-01", F.col("t"))) == [1.0]
    assert column(late, dates.tenure_months("2020-04-01", F.col("t"))) == [0.0]


def test_tenure_columns(spark):
    df = spark.createDataFrame([(0, dt.date(2018, 10, 1))], "i int, t date")
    found = df.select(
        *[c.alias(n) for n, c in dates.tenure_columns("2020-04-01", F.col("t")).items()]
    ).first()
    assert found.asDict() == {
        "days": 548, "years_by_days": 548 / 365.25, "months": 18.0, "months_rounded": 18.0,
        "years_by_months": 1.5, "years": 2.0,
    }


def test_percentage(spark):
    df = spark.createDataFrame([(0, 1, 3), (1, 2, 3), (2, 0, 0)], "i int, a int, b int")
    assert column(df, percentage(F.col("a"), F.col("b"))) == [33.33, 66.67, None]


def test_rows_helper_sorts(spark):
    assert rows(spark.range(3)) == [(0,), (1,), (2,)]
