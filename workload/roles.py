"""The test tables in the roles of the source tables.

Each role is a list of (column, expression) over one table. The expressions are plain SQL that Spark
and DuckDB read alike, so both start from the same rows; everything after that is written twice.
Text attributes do not exist in the test tables and are derived from the part columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from featuretable import fixed_values as V
from featuretable.operators.assemble import require_unique
from featuretable.plans.basetable import ReferenceDays, Sources
from featuretable.sources.tables import read_table

FACT_DAY = "2001-12-01"
EVENT_DAY = "2024-06-01"
DAYS = ReferenceDays(checkin=EVENT_DAY, review=FACT_DAY, tip=EVENT_DAY, user=FACT_DAY)


def _simple_flag(i: int) -> str:
    # The order of the tests makes each flag its own mix of 'True', 'False', 'None' and null.
    return (
        f"CASE (p_partkey * {i + 3} + p_size) % {5 + i % 3} "
        "WHEN 0 THEN 'True' WHEN 1 THEN 'None' WHEN 2 THEN NULL WHEN 3 THEN 'True' ELSE 'False' END"
    )


_SPECIAL = {
    "attributes.Alcohol": "CASE p_partkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'None' "
    "WHEN 2 THEN 'full_bar' WHEN 3 THEN NULL WHEN 4 THEN 'u-none' ELSE 'beer_and_wine' END",
    "attributes.Ambience": "CASE p_size % 4 WHEN 0 THEN '{romantic: False, casual: True}' "
    "WHEN 1 THEN '{romantic: False, casual: False}' WHEN 2 THEN NULL ELSE 'None' END",
    "attributes.BestNights": "CASE p_size % 5 WHEN 0 THEN '{friday: True}' WHEN 1 THEN NULL "
    "ELSE '{friday: False}' END",
    "attributes.Music": "CASE p_partkey % 7 WHEN 0 THEN '{dj: True}' WHEN 1 THEN '{dj: TRUE}' "
    "WHEN 2 THEN NULL ELSE '{dj: False}' END",
    "attributes.BusinessParking": "CASE p_partkey % 3 WHEN 0 THEN '{lot: True}' WHEN 1 THEN NULL "
    "ELSE '{lot: False}' END",
    "attributes.GoodForMeal": "CASE p_size % 6 WHEN 0 THEN '{lunch: True, dinner: True}' "
    "WHEN 1 THEN NULL ELSE '{lunch: False}' END",
    "attributes.AgesAllowed": "CASE p_partkey % 5 WHEN 0 THEN '21plus' WHEN 1 THEN '18plus' "
    "WHEN 2 THEN 'allages' ELSE NULL END",
    "attributes.DietaryRestrictions": "CASE p_size % 9 WHEN 0 THEN '{vegan: True}' WHEN 1 THEN "
    "'{vegan: False}' ELSE NULL END",
    "attributes.Smoking": "CASE p_partkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'outdoor' "
    "WHEN 2 THEN 'no' ELSE NULL END",
    "attributes.WiFi": "CASE p_size % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' WHEN 2 THEN 'no' "
    "ELSE NULL END",
    "attributes.RestaurantsPriceRange2": "CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 'None' "
    "WHEN 2 THEN '1' WHEN 3 THEN '2' WHEN 4 THEN '3' ELSE '4' END",
    "attributes.BYOBCorkage": "CASE p_size % 2 WHEN 0 THEN 'no' ELSE NULL END",
    "attributes.NoiseLevel": "CASE p_size % 3 WHEN 0 THEN 'quiet' ELSE 'loud' END",
    "attributes.RestaurantsAttire": "CASE p_size % 3 WHEN 0 THEN 'casual' ELSE NULL END",
}

_NEVER = "CASE WHEN p_size < 0 THEN 'x' END"

BUSINESS = [
    ("business_id", "p_partkey"),
    ("name", "p_name"),
    (
        "categories",
        "CASE WHEN p_size = 49 THEN NULL WHEN p_size % 10 = 0 THEN 'Shopping' "
        "WHEN p_size % 3 = 0 THEN 'Food, ' || p_name WHEN p_size % 3 = 1 THEN 'Bars, ' || p_name "
        "ELSE 'Restaurants, ' || p_name END",
    ),
    ("city", "p_brand"),
    ("state", "p_type"),
    ("is_open", "CAST(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS BIGINT)"),
    ("review_count", "CAST(p_size AS BIGINT)"),
    ("stars", "CAST(2 + p_size % 9 AS DOUBLE) / 2"),
    ("hours.Monday", "CASE p_size % 3 WHEN 0 THEN '9:0-17:0' WHEN 1 THEN NULL ELSE '0:0-0:0' END"),
    ("hours.Sunday", "CASE p_size % 4 WHEN 0 THEN '10:0-14:0' ELSE NULL END"),
    ("attributes.NeverSet", _NEVER),
    ("attributes.NeverUsed", _NEVER),
    *[
        (
            name.replace("attributes_", "attributes."),
            "CASE WHEN p_size > 90 THEN 'True' ELSE 'False' END"
            if name == "attributes_Open24Hours"
            else _simple_flag(i),
        )
        for i, name in enumerate(V.SIMPLE_FLAGS)
    ],
    *_SPECIAL.items(),
]

REVIEW = [
    ("review_id", "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"),
    ("business_id", "l_partkey"),
    ("user_id", "l_suppkey"),
    ("date", "l_shipdate"),
    ("stars", "l_quantity"),
    ("cool", "CAST(round(l_tax * 100) AS BIGINT)"),
    ("useful", "CAST(round(l_discount * 100) AS BIGINT)"),
]

USER = [
    ("user_id", "s_suppkey"),
    ("average_stars", "CAST(1 + s_suppkey % 5 AS DOUBLE)"),
    ("fans", "CAST(s_nationkey AS BIGINT)"),
    ("review_count", "CAST(round(s_acctbal) AS BIGINT)"),
    (
        "user_since",
        "CAST(DATE '1990-01-01' + CAST((s_suppkey * 37) % 1500 AS INT) AS STRING) || ' ' || "
        "lpad(CAST(s_nationkey % 24 AS STRING), 2, '0') || ':30:15'",
    ),
]

CHECKIN = [("business_id", "user_id"), ("date", "ts")]
TIP = [
    ("business_id", "user_id"),
    ("date", "ts"),
    ("compliment_count", "CAST(floor(value / 100) AS BIGINT)"),
]
COVID = [
    ("business_id", "doc_id"),
    ("Temporary Closed Until", "CASE WHEN toxic = 0 THEN 'FALSE' ELSE '2001-12-24' END"),
    ("delivery or takeout", "CASE WHEN quality = 1 THEN 'TRUE' ELSE 'FALSE' END"),
]

# Text dates: whole, day only, junk, missing.
_TEXT_DATE = (
    "CASE event_id % 5 WHEN 0 THEN substr(CAST(ts AS STRING), 1, 10) WHEN 1 THEN 'no date' "
    "WHEN 2 THEN NULL ELSE substr(CAST(ts AS STRING), 1, 19) END"
)
CHECKIN_TEXT = [("business_id", "user_id"), ("date", _TEXT_DATE)]
COVID_BOOLEAN = [
    ("business_id", "doc_id"),
    ("Temporary Closed Until", "CASE WHEN toxic = 0 THEN false ELSE true END"),
    ("delivery or takeout", "CASE WHEN quality = 1 THEN true ELSE false END"),
]
STARTS_TEXT = [
    ("o_orderkey", "o_orderkey"),
    (
        "since",
        "CASE o_orderkey % 4 WHEN 0 THEN substr(CAST(o_orderdate AS STRING), 1, 10) "
        "WHEN 1 THEN 'no date' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) || ' 23:59:58' END",
    ),
]

ROLES = {
    "business": ("part", None, BUSINESS),
    "review": ("lineitem", None, REVIEW),
    "users": ("supplier", None, USER),
    "checkin": ("events", "event_type = 'view'", CHECKIN),
    "tip": ("events", "event_type = 'click'", TIP),
    "covid": ("labels", None, COVID),
    "checkin_text": ("events", "event_type = 'view'", CHECKIN_TEXT),
    "tip_text": ("events", "event_type = 'click'", CHECKIN_TEXT),
    "covid_boolean": ("labels", None, COVID_BOOLEAN),
    "starts_text": ("orders", None, STARTS_TEXT),
}


# Declared like every other input, so that building a plan needs no inference job.
SCHEMAS = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = StructType.fromDDL(SCHEMAS[name])
    return read_table(spark, f"{sf_dir}/{name}.parquet", schema, fmt="parquet")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, condition, columns = ROLES[name]
    rows = table(spark, sf_dir, source)
    if condition is not None:
        rows = rows.filter(condition)
    return rows.selectExpr(*[f"{expression} AS `{column}`" for column, expression in columns])


def sources(spark: SparkSession, sf_dir: str) -> Sources:
    users = require_unique(role(spark, sf_dir, "users"), "user_id")
    return Sources(
        business=role(spark, sf_dir, "business"),
        checkin=role(spark, sf_dir, "checkin"),
        covid=role(spark, sf_dir, "covid"),
        user=users,
        review=role(spark, sf_dir, "review"),
        tip=role(spark, sf_dir, "tip"),
        unique_users=True,
    )


def role_sql(name: str) -> str:
    """The same rows as a DuckDB select."""
    source, condition, columns = ROLES[name]
    listed = ", ".join(f'{expression} AS "{column}"' for column, expression in columns)
    where = f" WHERE {condition}" if condition else ""
    return f"SELECT {listed} FROM {source}{where}"
