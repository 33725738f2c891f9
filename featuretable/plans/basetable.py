"""One clean row per business from the six source tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featuretable import fixed_values as V
from featuretable.functions.dates import parse_day, parse_timestamp, tenure_columns, tenure_months
from featuretable.functions.flags import contains_flag, equals_flag, number_or_default
from featuretable.functions.predicates import column
from featuretable.operators.assemble import left_assemble
from featuretable.operators.columns import drop, keep, replace_in_names
from featuretable.operators.filters import drop_incomplete, where_any_contains, where_equals
from featuretable.operators.impute import fill_constant, fill_with_max
from featuretable.operators.rollup import finish_members, member_state, merge_members, rollup_activity
from featuretable.operators.sets import dedup_by_key
from featuretable.sources.scratch import materialize

KEY = "business_id"
COUNT_GAPS = ("count_checkins", "count_tip")
RECENCY_GAPS = ("checkin_recency_months", "tip_recency_months")


@dataclass(frozen=True)
class Sources:
    business: DataFrame
    checkin: DataFrame
    covid: DataFrame
    user: DataFrame
    review: DataFrame
    tip: DataFrame
    user_since: str = "user_since"
    unique_users: bool = False  # known to hold every user once: one grouping less


@dataclass(frozen=True)
class ReferenceDays:
    """The day each table's recency or tenure is measured to."""

    checkin: str = V.REFERENCE_DAY
    review: str = V.REFERENCE_DAY
    tip: str = V.REFERENCE_DAY
    user: str = V.REFERENCE_DAY


def timestamp_of(df: DataFrame, name: str) -> Column:
    """A date column as it is, or parsed once here if the table carries it as text."""
    value = column(name)
    return parse_timestamp(value) if isinstance(df.schema[name].dataType, T.StringType) else value


def truth_text(value: Column) -> Column:
    """``TRUE``/``FALSE`` for booleans, and for the text a boolean becomes when read as text.

    Any other text stays as it is; mixed case is no boolean.
    """
    text = value.cast("string")
    return F.when(text.isin("true", "false"), F.upper(text)).otherwise(text)


def clean_business(
    business: DataFrame, terms: Iterable[str] | None = V.CATEGORY_TERMS
) -> DataFrame:
    """Attribute names without dots; with ``terms`` only the businesses of those categories."""
    renamed = replace_in_names(business, {".": "_"})
    return renamed if terms is None else where_any_contains(renamed, "categories", terms)


def kept_columns() -> list[str]:
    """All business columns worth keeping, in alphabetical order."""
    special = [source for _, source, _ in V.SPECIAL_FLAGS]
    return sorted([*V.SIMPLE_FLAGS, *special, V.PRICE, *V.UNUSED_ATTRIBUTES, *V.BASE_COLUMNS])


def business_features(clean: DataFrame) -> DataFrame:
    """Base columns, flags and price: one projection, no join back to the source."""
    return clean.select(
        *V.BASE_COLUMNS,
        *[equals_flag(F.col(name)).alias(name) for name in V.SIMPLE_FLAGS],
        number_or_default(F.col(V.PRICE), V.PRICE_DEFAULT, V.PRICE_MISSING_TEXT).alias(V.PRICE),
        *[
            contains_flag(F.col(source), *terms).alias(name)
            for name, source, terms in V.SPECIAL_FLAGS
        ],
    )


def covid_labels(covid: DataFrame) -> DataFrame:
    """The label of every business that is not closed, one row per business."""
    named = replace_in_names(keep(covid, [KEY, V.CLOSED, V.DELIVERY]), {" ": "_"})
    closed, delivery = V.CLOSED.replace(" ", "_"), V.DELIVERY.replace(" ", "_")
    texts = named.withColumns({name: truth_text(column(name)) for name in (closed, delivery)})
    is_open = where_equals(texts, closed, V.OPEN_TEXT)
    labelled = drop(is_open, [closed]).withColumn(
        "label", equals_flag(F.col(delivery), V.POSITIVE_TEXT)
    )
    return dedup_by_key(labelled, KEY, delivery)


def reviewers(user: DataFrame, reference: str, since: str) -> DataFrame:
    """User columns that describe a reviewer, with the tenure in months."""
    return user.select(
        "user_id",
        F.col("average_stars").alias("average_reviewer_stars"),
        "fans",
        "review_count",
        tenure_months(reference, timestamp_of(user, since)).alias("user_LOR_months"),
    )


def tenure_table(user: DataFrame, key: str, reference: str, since: str) -> DataFrame:
    """Distance from each user's first day to the reference day, in several units."""
    start = column(since)
    if isinstance(user.schema[since].dataType, T.StringType):
        start = parse_day(start)  # the time of day, if there is one, does not matter here
    return user.select(
        key, *[value.alias(name) for name, value in tenure_columns(reference, start).items()]
    )


def rollup_checkin(checkin: DataFrame, reference: str) -> DataFrame:
    """Visits per business; the table holds one row per visit."""
    parsed = timestamp_of(checkin, "date")
    return rollup_activity(
        checkin, KEY, "date", reference, "count_checkins", "checkin_recency_months", parsed
    )


def rollup_tip(tip: DataFrame, reference: str) -> DataFrame:
    parsed = timestamp_of(tip, "date")
    return rollup_activity(
        tip, KEY, "date", reference, "count_tip", "tip_recency_months", parsed
    )


REVIEW_FACTS = {"avg_business_stars": "stars", "avg_useful_reviews_count": "useful"}
REVIEW_MEMBERS = {
    "avg_reviewer_fanscount": "fans",
    "avg_reviewers_reviewcount": "review_count",
    "avg_reviewers_LOR": "user_LOR_months",
}


def review_state(review: DataFrame) -> DataFrame:
    """The reviews of one load, reduced to what :func:`review_rollup` needs of them."""
    reviews = review.select(
        KEY, "user_id", "stars", "useful", timestamp_of(review, "date").alias("date")
    )
    return member_state(reviews, KEY, "user_id", "date", list(REVIEW_FACTS.values()), "useful")


def add_reviews(state: DataFrame, review: DataFrame) -> DataFrame:
    """A stored state with the reviews of one more load; earlier loads are not read again."""
    return merge_members(state.unionByName(review_state(review)), KEY, "user_id")


def review_rollup(
    state: DataFrame, users: DataFrame, reference: str, unique_users: bool = False
) -> DataFrame:
    """Ratings, reviewers and recency per business; ``users`` comes from :func:`reviewers`."""
    return finish_members(
        state,
        users,
        entity=KEY,
        member="user_id",
        reference=reference,
        fact_averages=REVIEW_FACTS,
        member_averages=REVIEW_MEMBERS,
        count_as="count_reviews",
        distinct_as="count_reviewers",
        recency_as="review_recency_months",
        unique_members=unique_users,
    )


def rollup_review(
    review: DataFrame, users: DataFrame, reference: str, unique_users: bool = False
) -> DataFrame:
    return review_rollup(review_state(review), users, reference, unique_users)


def raw_basetable(
    sources: Sources,
    days: ReferenceDays = ReferenceDays(),
    terms: Iterable[str] | None = V.CATEGORY_TERMS,
    store_rollups: bool = False,
) -> DataFrame:
    """Business features left-joined with all rollups and the label.

    The two tables a complete row cannot do without are joined first. Filling needs the maxima of
    the check-in and tip rollups before it can start; with ``store_rollups`` these two (one row per
    business) are written out first, so that their facts are scanned once instead of twice.
    """
    features = business_features(clean_business(sources.business, terms))
    users = reviewers(sources.user, days.user, sources.user_since)
    label = covid_labels(sources.covid)
    review = rollup_review(sources.review, users, days.review, sources.unique_users)
    checkin = rollup_checkin(sources.checkin, days.checkin)
    tip = rollup_tip(sources.tip, days.tip)
    if store_rollups:
        checkin, tip = materialize(checkin, "checkin-rollup"), materialize(tip, "tip-rollup")
    joined = left_assemble(features, KEY, [label, review, checkin, tip])
    order = features.columns
    for table in (checkin, review, tip, label):
        order += [name for name in table.columns if name != KEY]
    return keep(joined, order)


def fill_gaps(raw: DataFrame) -> DataFrame:
    """No activity means a count of 0 and the longest recency there is."""
    return fill_with_max(fill_constant(raw, 0, COUNT_GAPS), RECENCY_GAPS)


def basetable(
    sources: Sources,
    days: ReferenceDays = ReferenceDays(),
    terms: Iterable[str] | None = V.CATEGORY_TERMS,
    store_rollups: bool = False,
) -> DataFrame:
    """The complete rows of the filled base table, as one lazy plan from scan to result.

    Filled columns have no gaps left and need no test. ``store_rollups`` is for large check-in and
    tip tables, see :func:`raw_basetable`.
    """
    filled = fill_gaps(raw_basetable(sources, days, terms, store_rollups))
    open_columns = [c for c in filled.columns if c not in (*COUNT_GAPS, *RECENCY_GAPS)]
    return drop_incomplete(filled, open_columns)
