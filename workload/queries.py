"""One Spark query per operator, over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featuretable import fixed_values as V
from featuretable.functions.dates import parse_day, recency_months
from featuretable.functions.flags import contains_flag, equals_flag, number_or_default, pattern_flag
from featuretable.models import encode, metrics
from featuretable.operators import assemble, columns, filters, impute, profile, sets, split
from featuretable.plans import basetable as B
from featuretable.plans import exploration, modelling
from featuretable.sources.scratch import materialize, scratch_path
from featuretable.sources.tables import (
    covid_schema,
    read_lines,
    read_table,
    review_schema,
    set_aside,
    write_table,
)
from workload import model_checks as checks
from workload.roles import DAYS, EVENT_DAY, FACT_DAY, role, sources, table

Query = Callable[[SparkSession, str], DataFrame]

# Queries on tuned models; those that tune the larger families take minutes even on small tables.
FITTED = (
    "fold_sizes", "fit_logistic", "score_table", "fit_decision_tree", "fit_random_forest", "cv_metrics",
    "best_params", "feature_importance", "model_metrics", "model_leaderboard",
)
SHARES = {0: V.TRAIN_SHARE, 1: V.TRAIN_SHARE}


# -- inputs shared by several queries


def _renamed_business(spark: SparkSession, d: str) -> DataFrame:
    return columns.replace_in_names(role(spark, d, "business"), {".": "_"})


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return B.clean_business(role(spark, d, "business"))


def _reviewers(spark: SparkSession, d: str) -> DataFrame:
    return B.reviewers(role(spark, d, "users"), FACT_DAY, "user_since")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return B.raw_basetable(sources(spark, d), DAYS)


def basetable(spark: SparkSession, d: str) -> DataFrame:
    return B.basetable(sources(spark, d), DAYS)


def _tenure(spark: SparkSession, d: str) -> DataFrame:
    return B.tenure_table(table(spark, d, "orders"), "o_orderkey", FACT_DAY, "o_orderdate")


def _rule_scored(spark: SparkSession, d: str) -> DataFrame:
    """A fixed rule as classifier, so that the metrics can be checked in SQL."""
    return table(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when((F.col("l_quantity") > 30) | (F.col("l_discount") > 0.08), 1.0)
        .otherwise(0.0)
        .alias("prediction"),
    )


# -- columns, filters, scalars


def rename_columns(spark, d):
    return _renamed_business(spark, d)


def select_matching_columns(spark, d):
    return columns.select_matching(_renamed_business(spark, d), "hours", ["business_id", "name"])


def project_keep_list(spark, d):
    return columns.keep(_renamed_business(spark, d), B.kept_columns())


def project_drop_list(spark, d):
    return columns.drop(role(spark, d, "review"), ["review_id", "cool", "date"])


def key_first(spark, d):
    return columns.key_first(
        columns.keep(_renamed_business(spark, d), [*V.SIMPLE_FLAGS, V.PRICE, "business_id"]),
        "business_id",
    )


def filter_any_contains(spark, d):
    return _clean(spark, d).select("business_id", "categories")


def filter_open(spark, d):
    named = columns.replace_in_names(role(spark, d, "covid"), {" ": "_"})
    return filters.where_equals(named, "Temporary_Closed_Until", V.OPEN_TEXT)


def flag_equals(spark, d):
    return _renamed_business(spark, d).select(
        "business_id", *[equals_flag(F.col(name)).alias(name) for name in V.SIMPLE_FLAGS]
    )


def flag_match(spark, d):
    return _renamed_business(spark, d).select(
        "business_id",
        *[contains_flag(F.col(name), *terms).alias(flag) for flag, name, terms in V.SPECIAL_FLAGS],
    )


def numeric_default(spark, d):
    price = number_or_default(F.col(V.PRICE), V.PRICE_DEFAULT, V.PRICE_MISSING_TEXT)
    return _renamed_business(spark, d).select("business_id", price.alias("price"))


def binary_label(spark, d):
    return role(spark, d, "covid").select(
        "business_id", equals_flag(F.col("`delivery or takeout`"), V.POSITIVE_TEXT).alias("label")
    )


def covid_labels(spark, d):
    return B.covid_labels(role(spark, d, "covid"))


def parse_dates(spark, d):
    order = F.col("o_orderdate")
    full = order.cast("string")
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, full)
        .when(
            F.col("o_orderkey") % 5 == 1,
            F.concat_ws("-", F.year(order), F.month(order), F.concat(F.day(order), F.lit(" 7:5:3"))),
        )
        .when(F.col("o_orderkey") % 5 == 2, F.substring(full, 1, 10))
        .when(F.col("o_orderkey") % 5 == 3, F.lit("no date"))
        .otherwise(F.concat(full, F.lit(".250 and more")))
    )
    return table(spark, d, "orders").select(
        "o_orderkey",
        parse_day(text).cast("string").alias("day"),
        parse_day(text, with_time=True).cast("string").alias("day_of_time"),
    )


def recency(spark, d):
    return table(spark, d, "events").select(
        "event_id", recency_months(EVENT_DAY, F.col("ts")).alias("recency_months")
    )


def recency_of_lineitems(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        recency_months(FACT_DAY, F.col("l_shipdate")).alias("recency_months"),
    )


def tenure_months(spark, d):
    return _reviewers(spark, d).select("user_id", "user_LOR_months")


# -- joins and rollups


def fact_join_dim(spark, d):
    reviews = role(spark, d, "review").select("business_id", "date", "stars", "useful", "user_id")
    joined = assemble.left_join(reviews, _reviewers(spark, d), "user_id")
    return joined.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))


def business_features(spark, d):
    return B.business_features(_clean(spark, d))


def rollup_checkin(spark, d):
    return B.rollup_checkin(role(spark, d, "checkin"), EVENT_DAY)


def rollup_tip(spark, d):
    return B.rollup_tip(role(spark, d, "tip"), EVENT_DAY)


def rollup_review(spark, d):
    users = assemble.require_unique(role(spark, d, "users"), "user_id")
    reviewers = B.reviewers(users, FACT_DAY, "user_since")
    return B.rollup_review(role(spark, d, "review"), reviewers, FACT_DAY, unique_users=True)


def rollup_incremental(spark, d):
    """Reviews in three loads: each is reduced, and merged into the stored state of those before it."""
    reviews = role(spark, d, "review")
    load = F.crc32("review_id") % 3
    state = materialize(B.review_state(reviews.filter(load == 0)), "review-state")
    for number in (1, 2):
        state = materialize(B.add_reviews(state, reviews.filter(load == number)), "review-state")
    return B.review_rollup(state, _reviewers(spark, d), FACT_DAY)


def rollup_checkin_text(spark, d):
    """Dates as text: whole, without time of day, junk, or missing."""
    return B.rollup_checkin(role(spark, d, "checkin_text"), EVENT_DAY)


def rollup_tip_text(spark, d):
    return B.rollup_tip(role(spark, d, "tip_text"), EVENT_DAY)


def rollup_review_repeats(spark, d):
    """A user table that lists every third user twice."""
    users = _reviewers(spark, d)
    repeated = users.unionAll(users.filter("user_id % 3 = 0"))
    return B.rollup_review(role(spark, d, "review"), repeated, FACT_DAY)


def covid_labels_boolean(spark, d):
    """The closed and delivery flags as booleans."""
    return B.covid_labels(role(spark, d, "covid_boolean"))


def tenure_columns_text(spark, d):
    """First days as text, with and without time of day, and junk."""
    starts = role(spark, d, "starts_text")
    return B.tenure_table(starts, "o_orderkey", FACT_DAY, "since")


def _through_json(df, schema):
    path = scratch_path(df.sparkSession, "json")
    write_table(df, path, "json")
    return read_table(df.sparkSession, path, schema, "json")


def json_scan_review(spark, d):
    """Reviews as JSON lines, read by the declared schema: ids and dates arrive as text."""
    review = role(spark, d, "review").withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
    texts = review.withColumns({n: F.col(n).cast("string") for n in ("business_id", "user_id")})
    return _through_json(texts, review_schema())


def json_scan_covid(spark, d):
    """Covid rows with one flag as text and one as boolean, read by the declared schema."""
    covid = role(spark, d, "covid")
    mixed = covid.select(
        F.col("business_id").cast("string"), V.CLOSED, (F.col(V.DELIVERY) == "TRUE").alias(V.DELIVERY)
    )
    found = _through_json(mixed, covid_schema())
    return columns.replace_in_names(found, {" ": "_"})


def json_scan_malformed(spark, d):
    """Reviews as JSON lines, some cut off and some with a text where a number belongs; both kinds are set aside."""
    review = role(spark, d, "review").withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
    texts = review.withColumns({n: F.col(n).cast("string") for n in ("business_id", "user_id")})
    line = F.to_json(F.struct(*texts.columns))
    kind = (F.col("business_id").cast("long") + F.col("user_id").cast("long")) % 10
    cut = F.substring(line, F.lit(1), F.length(line) - 9)
    lines = texts.select(
        F.when(kind == 0, cut).when(kind == 1, F.regexp_replace(line, '"cool":\\d+', '"cool":"many"')).otherwise(line).alias("value")
    )
    path = scratch_path(spark, "lines")
    lines.write.text(path)
    rows = read_lines(spark, path, review_schema())
    good, bad = set_aside(rows, scratch_path(spark, "good"), scratch_path(spark, "bad"))
    review_id = F.get_json_object(F.concat(F.regexp_extract("line", '^\\{"review_id":"[^"]*"', 0), F.lit("}")), "$.review_id")
    listed = bad.select(review_id.alias("review_id"), F.lit(False).alias("well_formed"))
    return good.withColumn("well_formed", F.lit(True)).unionByName(listed, allowMissingColumns=True)


def flag_pattern(spark, d):
    """Flags by regular expressions."""
    clean = _renamed_business(spark, d)
    return clean.select(
        "business_id",
        pattern_flag(F.col("attributes_Smoking"), "^(yes|outdoor)$").alias("allows_smoking"),
        pattern_flag(F.col("attributes_WiFi"), "paid|free").alias("has_wifi"),
        pattern_flag(F.col("attributes_AgesAllowed"), "^[0-9]+plus").alias("has_age_restrict"),
    )


def basetable_roundtrip(spark, d):
    return materialize(basetable(spark, d), "basetable", fmt="json")


# -- cleaning and quality


def impute_constant(spark, d):
    return impute.fill_constant(_raw(spark, d), 0, B.COUNT_GAPS).select(
        "business_id", *B.COUNT_GAPS
    )


def impute_max(spark, d):
    return impute.fill_with_max(_raw(spark, d), B.RECENCY_GAPS).select(
        "business_id", *B.RECENCY_GAPS
    )


def drop_incomplete(spark, d):
    return filters.drop_incomplete(_raw(spark, d))


def incomplete_report(spark, d):
    return impute.loss_report(B.fill_gaps(_raw(spark, d)))


def drop_all_null_columns(spark, d):
    return profile.drop_all_null_columns(_renamed_business(spark, d))


def all_null_columns(spark, d):
    return profile.all_null_columns(_renamed_business(spark, d))


def constant_columns(spark, d):
    return profile.constant_columns(flag_equals(spark, d), V.SIMPLE_FLAGS)


def null_audit(spark, d):
    return profile.null_audit(_raw(spark, d))


def key_uniqueness(spark, d):
    return profile.key_uniqueness(_raw(spark, d), "business_id")


def derived_vs_source(spark, d):
    return profile.derived_vs_source(
        _raw(spark, d),
        "business_id",
        [("count_reviews", "review_count"), ("avg_business_stars", "stars")],
    )


def distinct_keys(spark, d):
    keys = {
        "business": ["business_id"],
        "checkin": ["business_id"],
        "covid": ["business_id"],
        "review": ["business_id", "review_id", "user_id"],
        "tip": ["business_id"],
    }
    counts = [
        profile.distinct_keys(role(spark, d, name), names).select(
            F.lit(name).alias("source"), "key", "n_keys"
        )
        for name, names in keys.items()
    ]
    return reduce(DataFrame.unionAll, counts)


def distinct_profile(spark, d):
    return profile.distinct_profile(table(spark, d, "lineitem"))


def distinct_values(spark, d):
    return profile.distinct_values(role(spark, d, "tip"), "compliment_count")


def describe_numeric(spark, d):
    found = profile.describe_numeric(role(spark, d, "review"), ["cool", "stars", "useful"])
    return found.withColumns({name: F.round(name, 6) for name in ("mean", "stddev")})


def describe_quantiles(spark, d):
    return profile.describe_quantiles(role(spark, d, "review"), ["cool", "stars", "useful"])


def distinct_sketches(spark, d):
    """Sketches of three loads, merged, beside the exact counts: the estimate lies within three standard errors."""
    lines = table(spark, d, "lineitem")
    loads = [profile.distinct_sketches(lines.filter(F.crc32(F.col("l_orderkey").cast("string")) % 3 == i)) for i in range(3)]
    merged = profile.sketched_counts(profile.merge_sketches(materialize(reduce(DataFrame.unionByName, loads), "sketches")))
    exact = profile.distinct_profile(lines).join(merged, "column_name")
    off = F.abs(F.col("estimate") - F.col("distinct_count"))
    bound = 3 * profile.SKETCH_ERROR * F.col("distinct_count")
    return exact.select("column_name", "distinct_count", (off <= bound).alias("within_bound"))


def describe_text(spark, d):
    return profile.describe_text(
        role(spark, d, "review").withColumn("date", F.to_date("date")), ["date", "review_id"]
    )


def table_shape(spark, d):
    return profile.table_shape(_clean(spark, d))


# -- reports


def count_by_category(spark, d):
    return exploration.businesses_per(_renamed_business(spark, d), "categories")


def count_by_stars(spark, d):
    return exploration.businesses_per(_clean(spark, d), "stars", order="key_desc")


def count_by_state(spark, d):
    return exploration.businesses_per(_clean(spark, d), "state")


def count_by_city(spark, d):
    return exploration.businesses_per(_clean(spark, d), "city")


def reviews_by_stars(spark, d):
    return exploration.reviews_per_star(role(spark, d, "review"))


def tips_by_compliments(spark, d):
    return exploration.tips_per_compliments(role(spark, d, "tip"))


def tenure_histogram(spark, d):
    return exploration.users_per_year(_tenure(spark, d), "o_orderkey")


def top_k_reviews(spark, d):
    return exploration.most_reviewed(role(spark, d, "review"))


def top_k_tips(spark, d):
    return exploration.most_tipped(role(spark, d, "tip"))


def flag_before_after(spark, d):
    return exploration.takeout_before_after(basetable(spark, d))


def flag_report_labels(spark, d):
    return exploration.kids_before_after(basetable(spark, d))


def label_count_where(spark, d):
    return exploration.new_deliveries(basetable(spark, d))


def label_avg_where(spark, d):
    return exploration.average_reviews_of_new_deliveries(basetable(spark, d))


def share_by_bucket(spark, d):
    return exploration.share_by_price(basetable(spark, d))


# -- sets, samples and splits


def set_difference(spark, d):
    orders = table(spark, d, "orders")
    names = ["o_custkey", "o_orderpriority"]
    return sets.set_difference(
        orders.select(names), orders.filter("o_orderstatus = 'F'").select(names)
    )


def dedup_by_key(spark, d):
    first = sets.dedup_by_key(table(spark, d, "orders"), "o_custkey", "o_orderdate")
    return first.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def class_balance(spark, d):
    return split.class_balance(basetable(spark, d), "label")


def sample_by(spark, d):
    """Spark's sample per label: a subset, with a share within five standard deviations."""
    labelled = covid_labels(spark, d)
    taken = materialize(split.stratified_sample(labelled, "label", SHARES, V.SPLIT_SEED), "sample")
    counts = taken.groupBy("label").agg(F.count(F.lit(1)).alias("_taken"))
    foreign = taken.join(labelled, "business_id", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("_foreign"))
    whole = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n_total"))
    n, share = F.col("n_total"), V.TRAIN_SHARE
    off = F.abs(F.coalesce("_taken", F.lit(0)) - n * share)
    return whole.join(counts, "label", "left").join(foreign, "label", "left").select(
        "label",
        "n_total",
        F.col("_foreign").isNull().alias("is_subset"),
        (off <= 5 * F.sqrt(n * share * (1 - share))).alias("share_holds"),
    )


def hash_split(spark, d):
    labelled = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label")
    )
    train, test = split.hash_split(labelled, "o_orderkey", "label", SHARES, V.SPLIT_SEED)
    return train.withColumn("part", F.lit("train")).unionAll(
        test.withColumn("part", F.lit("test"))
    )


def exact_split(spark, d):
    labelled = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label")
    )
    train, test = split.exact_split(labelled, "o_orderkey", "label", SHARES, V.SPLIT_SEED)
    return train.withColumn("part", F.lit("train")).unionAll(
        test.withColumn("part", F.lit("test"))
    )


def split_sizes(spark, d):
    return split.split_sizes(basetable(spark, d), "business_id", "label", SHARES, V.SPLIT_SEED)


# -- metrics of a fixed rule


def auc_hard(spark, d):
    return metrics.auc_hard(_rule_scored(spark, d)).select(F.round("auc_hard", 9).alias("auc_hard"))


def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_rule_scored(spark, d))


def precision_recall(spark, d):
    return metrics.precision_recall(_rule_scored(spark, d))


def auc_raw(spark, d):
    """Raw scores with many ties and over a thousand different values."""
    scored = table(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        (F.col("l_quantity") * 100 + F.round(F.col("l_discount") * 100)).alias("score"),
    )
    return metrics.auc_by_ranks(scored).select(F.round("auc_raw", 9).alias("auc_raw"))


# -- encoding


def string_index(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return encode.with_category_index(parts, ["p_brand", "p_type"])


def _only_slot(name: str) -> Column:
    """Slot of a one-hot vector that holds a single 1, or -1."""
    slots = F.col(name)["slots"]
    one = (F.size(slots) == 1) & (slots[0]["value"] == 1.0)
    return F.when(one, slots[0]["slot"]).when(F.size(slots) == 0, -1)


def one_hot(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_type")
    encoder = encode.fit_encoder(parts, ["p_type"], handle_invalid="error")
    return encode.vector_slots(encoder.transform(parts), ["p_type_ohe"]).select(
        "p_partkey",
        "p_type",
        _only_slot("p_type_ohe").alias("slot"),
        F.col("p_type_ohe.size").alias("n_slots"),
    )


def _stored_split(spark, d):
    return modelling.split(materialize(basetable(spark, d), "basetable"))


def encode_pipeline(spark, d):
    parts = []
    for part, rows in zip(
        ("train", "test"), modelling.encode(*_stored_split(spark, d)), strict=True
    ):
        shown = [F.lit(part).alias("part"), "business_id"]
        vectors = [f"{name}_ohe" for name in modelling.CATEGORIES]
        for name, vector in zip(modelling.CATEGORIES, vectors, strict=True):
            shown += [
                _only_slot(vector).alias(f"{name}_slot"),
                F.col(vector)["size"].alias(f"{name}_slots"),
            ]
        parts.append(encode.vector_slots(rows, vectors).select(*shown))
    return parts[0].unionAll(parts[1])


def rformula_features(spark, d):
    """Non-zero slots of every feature vector, one row per slot."""
    parts = []
    tables = modelling.vectorize(*modelling.encode(*_stored_split(spark, d)))
    for part, rows in zip(("train", "test"), tables, strict=True):
        parts.append(
            encode.vector_slots(rows, ["features"]).select(
                F.lit(part).alias("part"), "business_id", F.inline("features.slots")
            )
        )
    return parts[0].unionAll(parts[1])


def features_by_joins(spark, d):
    """As ``rformula_features``, with category numbers that come by joins."""
    parts = []
    tables = modelling.vectorize_by_joins(*_stored_split(spark, d))[:2]
    for part, rows in zip(("train", "test"), tables, strict=True):
        parts.append(
            encode.vector_slots(rows, ["features"]).select(
                F.lit(part).alias("part"), "business_id", F.inline("features.slots")
            )
        )
    return parts[0].unionAll(parts[1])


def feature_slots(spark, d):
    """Slot and name of every feature of the vectors built by joins."""
    return modelling.vectorize_by_joins(*_stored_split(spark, d))[2]


# -- models: full grids, ten folds, each family fitted once per session and folder


def _checked(check: Callable[..., DataFrame], *args: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return check(checks.fits(spark, d, basetable), *args)

    return run


def queries() -> dict[str, Query]:
    plain = [
        rename_columns, select_matching_columns, project_keep_list, project_drop_list, key_first,
        filter_any_contains, filter_open, flag_equals, flag_match, numeric_default, binary_label,
        covid_labels, parse_dates, tenure_months, fact_join_dim, business_features,
        rollup_checkin, rollup_tip, rollup_review, basetable, basetable_roundtrip,
        impute_constant, impute_max, drop_incomplete, incomplete_report, drop_all_null_columns,
        all_null_columns, constant_columns, null_audit, key_uniqueness, derived_vs_source,
        distinct_keys, distinct_profile, distinct_values, describe_numeric, describe_text,
        table_shape, count_by_category, count_by_stars, count_by_state, count_by_city,
        reviews_by_stars, tips_by_compliments, tenure_histogram, top_k_reviews, top_k_tips,
        flag_before_after, flag_report_labels, label_count_where, label_avg_where,
        share_by_bucket, set_difference, dedup_by_key, class_balance, sample_by, hash_split,
        split_sizes, auc_hard, confusion_matrix, precision_recall, string_index, one_hot,
        encode_pipeline, rformula_features, features_by_joins, feature_slots, auc_raw, rollup_checkin_text, rollup_tip_text,
        rollup_review_repeats, covid_labels_boolean, tenure_columns_text, json_scan_review,
        json_scan_covid, flag_pattern, rollup_incremental, json_scan_malformed, describe_quantiles,
        distinct_sketches, exact_split,
    ]
    found = {query.__name__: query for query in plain}
    found["basetable_raw"] = _raw
    found["recency_months"] = recency_of_lineitems
    found["recency_months_events"] = recency
    found["tenure_columns"] = _tenure
    found["fit_logistic"] = _checked(checks.fit, "logistic_regression")
    found["fit_decision_tree"] = _checked(checks.fit, "decision_tree")
    found["fit_random_forest"] = _checked(checks.fit, "random_forest")
    found["cv_metrics"] = _checked(checks.cv_metrics)
    found["best_params"] = _checked(checks.best_params)
    found["score_table"] = _checked(checks.score_table)
    found["feature_importance"] = _checked(checks.feature_importance)
    found["model_metrics"] = _checked(checks.model_metrics)
    found["model_leaderboard"] = _checked(checks.leaderboard)
    found["fold_sizes"] = _checked(checks.fold_sizes)
    return found
