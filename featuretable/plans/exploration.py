"""The standard reports over the source tables and the base table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featuretable import fixed_values as V
from featuretable.functions.flags import relabel
from featuretable.operators.columns import rename
from featuretable.operators.reports import (
    average_where,
    count_by,
    count_where,
    flag_totals,
    share_by_bucket,
    top_k,
)

TAKE_OUT = "attributes_RestaurantsTakeOut"
FOR_KIDS = "attributes_GoodForKids"
DELIVERY = "attributes_RestaurantsDelivery"


def businesses_per(clean: DataFrame, by: str, order: str = "count") -> DataFrame:
    return count_by(clean, by, of="business_id", name="total_business", order=order)


def reviews_per_star(review: DataFrame) -> DataFrame:
    return count_by(review, "stars", of="business_id", name="number_of_reviews", order="key")


def most_reviewed(review: DataFrame, k: int = 10) -> DataFrame:
    return top_k(review, "business_id", k, of="business_id", name="number_of_reviews")


def tips_per_compliments(tip: DataFrame) -> DataFrame:
    return count_by(tip, "compliment_count", name="n_tips", order="key")


def most_tipped(tip: DataFrame, k: int = 10) -> DataFrame:
    return top_k(tip, "business_id", k, of="business_id", name="number_of_tips")


def users_per_year(tenure: DataFrame, user: str = "user_id") -> DataFrame:
    """Users by whole years of membership; ``tenure`` comes from the tenure table."""
    return count_by(tenure, "years", of=user, name="total_users")


def takeout_before_after(table: DataFrame) -> DataFrame:
    """All businesses and those with the label, by earlier take-out."""
    return rename(flag_totals(table, TAKE_OUT, "label"), {TAKE_OUT: "takeout_availability"})


def kids_before_after(table: DataFrame) -> DataFrame:
    """The same by kid-friendliness, with texts for the flag."""
    # The texts shown for both flag values.
    names = {"0": "Not Good", "1": "Good"}
    totals = flag_totals(table, FOR_KIDS, "label")
    return rename(
        totals.withColumn(FOR_KIDS, relabel(F.col(FOR_KIDS), names)), {FOR_KIDS: "good_for_kids"}
    )


def new_deliveries(table: DataFrame) -> DataFrame:
    """Labels of businesses that did not deliver before."""
    return count_where(table, F.col(DELIVERY) == 0, "label", "n_businesses")


def average_reviews_of_new_deliveries(table: DataFrame) -> DataFrame:
    return average_where(
        table, F.col(DELIVERY) == 0, "label", "review_count", "avg_review_count"
    )


def share_by_price(table: DataFrame) -> DataFrame:
    """Percentage of labelled businesses per price level."""
    return share_by_bucket(
        rename(table, {V.PRICE: "price_range"}), "price_range", "label"
    )
