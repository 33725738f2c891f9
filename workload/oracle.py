"""DuckDB SQL for the registered queries.

Starts from the same role rows as the Spark queries and states every result directly: member averages
by joining users to every review, duplicates by row_number, set difference by EXCEPT, and so on.
"""

from __future__ import annotations

from featuretable import fixed_values as V
from workload.roles import BUSINESS, EVENT_DAY, FACT_DAY, role_sql


def months(a: str, b: str) -> str:
    """Months between two timestamps: whole if the days agree or both end their month, else by
    31sts of the difference with time of day, to 8 digits."""
    whole = f"((year({a}) - year({b})) * 12 + month({a}) - month({b}))"
    rest = (
        f"((day({a}) - day({b})) * 86400 + (epoch({a}) - epoch(date_trunc('day', {a}))) "
        f"- (epoch({b}) - epoch(date_trunc('day', {b}))))"
    )
    same_day = f"day({a}) = day({b})"
    month_ends = f"({a}::DATE = last_day({a}::DATE) AND {b}::DATE = last_day({b}::DATE))"
    return (
        f"round(CASE WHEN {same_day} OR {month_ends} THEN {whole}::DOUBLE "
        f"ELSE {whole}::DOUBLE + {rest} / 2678400.0 END, 8)"
    )


def recency(day: str, last: str) -> str:
    return tenure(day, f"date_trunc('day', {last})")


def tenure(day: str, since: str) -> str:
    reference = f"TIMESTAMP '{day}'"
    return f"round({months(reference, since)}, 0)"


# Seven tenths of 2^60.
_LIMIT = int(0.7 * 2**60)

# The columns worth keeping, in alphabetical order.
_KEPT = """
attributes_AcceptsInsurance attributes_AgesAllowed attributes_Alcohol attributes_Ambience attributes_BYOB
attributes_BYOBCorkage attributes_BestNights attributes_BikeParking attributes_BusinessAcceptsBitcoin
attributes_BusinessAcceptsCreditCards attributes_BusinessParking attributes_ByAppointmentOnly
attributes_Caters attributes_CoatCheck attributes_Corkage attributes_DietaryRestrictions
attributes_DogsAllowed attributes_DriveThru attributes_GoodForDancing attributes_GoodForKids
attributes_GoodForMeal attributes_HappyHour attributes_HasTV attributes_Music attributes_NoiseLevel
attributes_Open24Hours attributes_OutdoorSeating attributes_RestaurantsAttire
attributes_RestaurantsCounterService attributes_RestaurantsDelivery
attributes_RestaurantsGoodForGroups attributes_RestaurantsPriceRange2
attributes_RestaurantsReservations attributes_RestaurantsTableService attributes_RestaurantsTakeOut
attributes_Smoking attributes_WheelchairAccessible attributes_WiFi business_id city is_open
review_count stars state
""".split()

_RENAMED = ", ".join(f'"{name}" AS "{name.replace(".", "_")}"' for name, _ in BUSINESS)
_SIMPLE = ", ".join(f"CASE WHEN {name} = 'True' THEN 1 ELSE 0 END AS {name}" for name in V.SIMPLE_FLAGS)
_PRICE = f"CASE WHEN {V.PRICE} IS NULL OR {V.PRICE} = 'None' THEN 2.5::DOUBLE ELSE {V.PRICE}::DOUBLE END"
_SPECIAL = """
CASE WHEN attributes_Alcohol LIKE '%none%' THEN 1 ELSE 0 END AS doesnt_serve_alcohol,
CASE WHEN attributes_Ambience LIKE '%True%' THEN 1 ELSE 0 END AS has_ambience,
CASE WHEN attributes_BestNights LIKE '%True%' THEN 1 ELSE 0 END AS has_specific_bestnight,
CASE WHEN attributes_Music LIKE '%True%' THEN 1 ELSE 0 END AS has_music,
CASE WHEN attributes_BusinessParking LIKE '%True%' THEN 1 ELSE 0 END AS has_parking,
CASE WHEN attributes_GoodForMeal LIKE '%True%' THEN 1 ELSE 0 END AS has_specific_goodmeal,
CASE WHEN attributes_AgesAllowed LIKE '%plus%' THEN 1 ELSE 0 END AS has_age_restrict,
CASE WHEN attributes_DietaryRestrictions LIKE '%True%' THEN 1 ELSE 0 END AS has_diet_option,
CASE WHEN regexp_matches(attributes_Smoking, 'yes|outdoor') THEN 1 ELSE 0 END AS allows_smoking,
CASE WHEN regexp_matches(attributes_WiFi, 'paid|free') THEN 1 ELSE 0 END AS has_wifi
"""

_CTES = [
    ("business", role_sql("business")),
    ("review", role_sql("review")),
    ("users", role_sql("users")),
    ("checkin", role_sql("checkin")),
    ("tip", role_sql("tip")),
    ("covid", role_sql("covid")),
    ("renamed", f"SELECT {_RENAMED} FROM business"),
    (
        "clean",
        "SELECT * FROM renamed WHERE categories LIKE '%Restaurants%' OR categories LIKE '%Food%' "
        "OR categories LIKE '%Bars%'",
    ),
    (
        "features",
        "SELECT business_id, city, is_open, review_count, stars, state, "
        f"{_SIMPLE}, {_PRICE} AS {V.PRICE}, {_SPECIAL} FROM clean",
    ),
    (
        "reviewers",
        "SELECT user_id, average_stars AS average_reviewer_stars, fans, review_count, "
        f"{tenure(FACT_DAY, 'user_since::TIMESTAMP')} AS user_LOR_months FROM users",
    ),
    (
        "checkins",
        f"SELECT business_id, count(date) AS count_checkins, {recency(EVENT_DAY, 'max(date)')} "
        "AS checkin_recency_months FROM checkin GROUP BY business_id",
    ),
    (
        "tips",
        f"SELECT business_id, count(date) AS count_tip, {recency(EVENT_DAY, 'max(date)')} "
        "AS tip_recency_months FROM tip GROUP BY business_id",
    ),
    (
        "reviews",
        "SELECT business_id, avg(stars) AS avg_business_stars, avg(useful) AS "
        "avg_useful_reviews_count, avg(fans) AS avg_reviewer_fanscount, avg(review_count) AS "
        "avg_reviewers_reviewcount, avg(user_LOR_months) AS avg_reviewers_LOR, count(useful) AS "
        "count_reviews, count(DISTINCT user_id) AS count_reviewers, "
        f"{recency(FACT_DAY, 'max(date)')} AS review_recency_months "
        "FROM review LEFT JOIN reviewers USING (user_id) GROUP BY business_id",
    ),
    (
        "open_labels",
        "SELECT business_id, delivery_or_takeout, label FROM (SELECT business_id, "
        '"delivery or takeout" AS delivery_or_takeout, CASE WHEN "delivery or takeout" = \'TRUE\' '
        "THEN 1 ELSE 0 END AS label, row_number() OVER (PARTITION BY business_id ORDER BY "
        '"delivery or takeout") AS rn FROM covid WHERE "Temporary Closed Until" = \'FALSE\') '
        "WHERE rn = 1",
    ),
    (
        "raw",
        "SELECT * FROM features LEFT JOIN checkins USING (business_id) LEFT JOIN reviews USING "
        "(business_id) LEFT JOIN tips USING (business_id) LEFT JOIN open_labels USING (business_id)",
    ),
    (
        "filled",
        "SELECT * REPLACE (coalesce(count_checkins, 0) AS count_checkins, coalesce(count_tip, 0) "
        "AS count_tip, coalesce(checkin_recency_months, (SELECT max(checkin_recency_months) FROM "
        "raw)) AS checkin_recency_months, coalesce(tip_recency_months, (SELECT "
        "max(tip_recency_months) FROM raw)) AS tip_recency_months) FROM raw",
    ),
    (
        "basetable",
        "SELECT * FROM filled WHERE label IS NOT NULL AND avg_business_stars IS NOT NULL AND "
        "avg_useful_reviews_count IS NOT NULL AND avg_reviewer_fanscount IS NOT NULL AND "
        "avg_reviewers_reviewcount IS NOT NULL AND avg_reviewers_LOR IS NOT NULL AND "
        "review_recency_months IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL AND stars IS "
        "NOT NULL",
    ),
    (
        "halves",
        f"SELECT *, CASE WHEN ('0x' || substr(md5('42:' || business_id), 1, 15))::BIGINT < {_LIMIT} "
        "THEN 'train' ELSE 'test' END AS part FROM basetable",
    ),
]

_RAW_COLUMNS = [
    "business_id", "city", "is_open", "review_count", "stars", "state", *V.SIMPLE_FLAGS, V.PRICE,
    "doesnt_serve_alcohol", "has_ambience", "has_specific_bestnight", "has_music", "has_parking",
    "has_specific_goodmeal", "has_age_restrict", "has_diet_option", "allows_smoking", "has_wifi",
    "count_checkins", "checkin_recency_months", "avg_business_stars", "avg_useful_reviews_count",
    "avg_reviewer_fanscount", "avg_reviewers_reviewcount", "avg_reviewers_LOR", "count_reviews",
    "count_reviewers", "review_recency_months", "count_tip", "tip_recency_months",
    "delivery_or_takeout", "label",
]


_NUMERIC = [
    n
    for n in _RAW_COLUMNS
    if n
    not in (
        "business_id", "city", "state", "label", "delivery_or_takeout", "count_reviews",
        "avg_business_stars",
    )
]


def _with(query: str) -> str:
    """Put the shared tables in front of a query."""
    tables = ",\n".join(f"{name} AS ({body})" for name, body in _CTES)
    return f"WITH {tables}\n{query}"


def _null_count(name: str) -> str:
    return f"count(*) FILTER (WHERE {name} IS NULL)"


def _incomplete_report() -> str:
    gaps = " + ".join(f"({name} IS NULL)::INT" for name in _RAW_COLUMNS)
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, {_null_count(name)} AS missing, "
        "count(*) AS rows_before, count(*) FILTER (WHERE gaps = 0) AS rows_after FROM counted"
        for name in _RAW_COLUMNS
    )
    return f"SELECT * FROM (WITH counted AS (SELECT *, {gaps} AS gaps FROM filled) {rows})"


def _quantiles() -> str:
    values = {"cool": "round(l_tax * 100)", "stars": "l_quantity", "useful": "round(l_discount * 100)"}
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, "
        + ", ".join(f"quantile_disc(({value})::DOUBLE, 0.{q}) AS q{q}" for q in (25, 50, 75))
        + " FROM lineitem"
        for name, value in values.items()
    )


def _distinct_profile() -> str:
    names = [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, count(DISTINCT {n}) AS distinct_count FROM lineitem"
        for n in names
    )


def _distinct_keys() -> str:
    keys = [
        ("business", "business_id"), ("checkin", "business_id"), ("covid", "business_id"),
        ("review", "business_id"), ("review", "review_id"), ("review", "user_id"),
        ("tip", "business_id"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{t}' AS source, '{k}' AS key, count(DISTINCT {k}) AS n_keys FROM {t}"
        for t, k in keys
    )


def _describe() -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, count({n}) AS n, round(avg({n}::DOUBLE), 6) AS mean, "
        f"round(stddev_samp({n}::DOUBLE), 6) AS stddev, min({n})::DOUBLE AS min, "
        f"max({n})::DOUBLE AS max FROM review"
        for n in ("cool", "stars", "useful")
    )


def _constant_columns() -> str:
    flags = f"SELECT {_SIMPLE} FROM renamed"
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, count(DISTINCT {n}) AS k FROM flags" for n in V.SIMPLE_FLAGS
    )
    return f"SELECT column_name FROM (WITH flags AS ({flags}) {rows}) WHERE k = 1"


def _slots(category: str) -> str:
    """Slot of each category by falling frequency in the training half."""
    return (
        f"SELECT {category} AS value, row_number() OVER (ORDER BY count(*) DESC, {category}) - 1 AS "
        f"slot FROM halves WHERE part = 'train' GROUP BY {category}"
    )


def _rformula() -> str:
    numeric = _NUMERIC
    parts = [
        f"SELECT part, business_id, {i} AS slot, {n}::DOUBLE AS value FROM halves WHERE {n} <> 0"
        for i, n in enumerate(numeric)
    ]
    width = len(numeric)
    parts.append(
        f"SELECT part, business_id, ({width} + s.slot)::INT, 1.0::DOUBLE FROM halves "
        "JOIN state_slots s ON state = s.value"
    )
    parts.append(
        f"SELECT part, business_id, ({width} + (SELECT count(*) FROM state_slots) + c.slot)::INT, "
        "1.0::DOUBLE FROM halves JOIN city_slots c ON city = c.value"
    )
    return (
        f"SELECT * FROM (WITH state_slots AS ({_slots('state')}), city_slots AS ({_slots('city')}) "
        + " UNION ALL ".join(parts)
        + ")"
    )


def _feature_slots() -> str:
    numeric = ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NUMERIC))
    return (
        f"SELECT slot::INT AS slot, feature FROM (WITH s AS ({_slots('state')}), c AS ({_slots('city')}) "
        f"SELECT * FROM (VALUES {numeric}) AS t(slot, feature) "
        f"UNION ALL SELECT {len(_NUMERIC)} + slot, 'state_ohe_' || value FROM s "
        f"UNION ALL SELECT {len(_NUMERIC)} + (SELECT count(*) FROM s) + slot, 'city_ohe_' || value FROM c)"
    )


_RULE = (
    "(SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, CASE WHEN "
    "l_quantity > 30 OR l_discount > 0.08 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM "
    "lineitem)"
)


_SCORED = (
    "SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_quantity * 100 + round(l_discount "
    "* 100) AS score FROM lineitem"
)


def _days(start: str) -> str:
    return f"date_diff('day', {start}::DATE, DATE '{FACT_DAY}')"


def _text_rollup(source: str, count: str, latest: str) -> str:
    """Every text that is there counts; only whole timestamps can be the latest."""
    last = "max(try_strptime(date, '%Y-%m-%d %H:%M:%S'))"
    return (
        f"SELECT business_id, count(date) AS {count}, {recency(EVENT_DAY, last)} AS {latest} "
        f"FROM ({role_sql(source)}) GROUP BY business_id"
    )


def _values(name: str, *values: object) -> str:
    return f"(VALUES {', '.join(f"('{v}')" for v in values)}) AS {name}({name})"


def _models() -> dict[str, str]:
    """Counts, names and grids; the checks beside them have to come out as true."""
    families = _values("model", "logistic_regression", "decision_tree", "random_forest")
    counts = "count(*) AS n_rows, sum(label)::BIGINT AS n_positive"
    grids = {
        "logistic_regression": {"maxIter": (50, 100, 150), "regParam": (0.1, 0.01)},
        "decision_tree": {"maxBins": (10, 20, 40, 80, 100), "maxDepth": (2, 5, 10, 20, 30)},
        "random_forest": {
            "impurity": ("gini", "entropy"), "maxDepth": (4, 8, 12), "numTrees": (100, 200, 300)
        },
    }
    points = " UNION ALL ".join(
        f"SELECT '{model}' AS model, "
        + " || ', ' || ".join(f"'{name}=' || {name}" for name in grid)
        + " AS params, 10::INT AS folds, true AS in_range FROM "
        + ", ".join(_values(name, *values) for name, values in grid.items())
        for model, grid in grids.items()
    )
    tuned = ", ".join(f"('{m}', '{name}', true, true)" for m, grid in grids.items() for name in grid)
    found = {
        f"fit_{short}": f"SELECT '{model}' AS model, part, {counts}, true AS metrics_hold, true AS "
        "model_holds FROM halves GROUP BY part"
        for short, model in (
            ("logistic", "logistic_regression"), ("decision_tree", "decision_tree"),
            ("random_forest", "random_forest"),
        )
    }
    width = len(_NUMERIC)
    names = " UNION ALL ".join(f"SELECT {i}::INT AS slot, '{n}' AS feature" for i, n in enumerate(_NUMERIC))
    return found | {
        "model_metrics": f"SELECT model, part, {counts}, true AS auc_agrees, true AS rates_agree FROM "
        f"halves, {families} GROUP BY model, part",
        "model_leaderboard": "SELECT model, part, count(*) AS n_rows, true AS in_order FROM halves, "
        f"{families} WHERE part = 'test' GROUP BY model, part",
        "cv_metrics": points,
        "best_params": f"SELECT * FROM (VALUES {tuned}) AS t(model, param, in_grid, is_best)",
        "score_table": "SELECT part, business_id, label, true AS raw_holds, true AS prediction_holds "
        "FROM halves",
        "feature_importance": f"SELECT slot, feature, true AS sum_is_one, true AS in_order FROM ({names} "
        f"UNION ALL SELECT ({width} + slot)::INT, 'state_ohe_' || value FROM ({_slots('state')}) UNION ALL "
        f"SELECT ({width} + (SELECT count(DISTINCT state) FROM halves WHERE part = 'train') + slot)::INT, "
        f"'city_ohe_' || value FROM ({_slots('city')}))",
        "fold_sizes": "SELECT (('0x' || substr(md5('43:' || business_id), 1, 8))::BIGINT % 10)::INT AS "
        f"fold, {counts} FROM halves WHERE part = 'train' GROUP BY fold",
    }


def oracle_sql() -> dict[str, str]:
    simple = ", ".join(V.SIMPLE_FLAGS)
    raw = ", ".join(_RAW_COLUMNS)
    order_day = f"TIMESTAMP '{FACT_DAY}'"
    order_months = months(order_day, "o_orderdate")
    order_days = f"date_diff('day', o_orderdate::DATE, DATE '{FACT_DAY}')"
    shared = {
        "rename_columns": "SELECT * FROM renamed",
        "select_matching_columns": "SELECT hours_Monday, hours_Sunday, business_id, name FROM renamed",
        "project_keep_list": f"SELECT {', '.join(_KEPT)} FROM renamed",
        "project_drop_list": "SELECT business_id, user_id, stars, useful FROM review",
        "key_first": f"SELECT business_id, {simple}, {V.PRICE} FROM renamed",
        "filter_any_contains": "SELECT business_id, categories FROM clean",
        "filter_open": 'SELECT business_id, "Temporary Closed Until" AS Temporary_Closed_Until, '
        '"delivery or takeout" AS delivery_or_takeout FROM covid '
        "WHERE \"Temporary Closed Until\" = 'FALSE'",
        "flag_equals": f"SELECT business_id, {_SIMPLE} FROM renamed",
        "flag_match": f"SELECT business_id, {_SPECIAL} FROM renamed",
        "numeric_default": f"SELECT business_id, {_PRICE} AS price FROM renamed",
        "binary_label": "SELECT business_id, CASE WHEN \"delivery or takeout\" = 'TRUE' THEN 1 "
        "ELSE 0 END AS label FROM covid",
        "covid_labels": "SELECT * FROM open_labels",
        "tenure_months": "SELECT user_id, user_LOR_months FROM reviewers",
        "fact_join_dim": "SELECT user_id, business_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, "
        "stars, useful, average_reviewer_stars, fans, review_count, user_LOR_months "
        "FROM review LEFT JOIN reviewers USING (user_id)",
        "business_features": "SELECT * FROM features",
        "rollup_checkin": "SELECT * FROM checkins",
        "rollup_tip": "SELECT * FROM tips",
        "rollup_review": "SELECT * FROM reviews",
        "rollup_incremental": "SELECT * FROM reviews",
        "basetable_raw": f"SELECT {raw} FROM raw",
        "basetable": f"SELECT {raw} FROM basetable",
        "basetable_roundtrip": f"SELECT {raw} FROM basetable",
        "impute_constant": "SELECT business_id, count_checkins, count_tip FROM filled",
        "impute_max": "SELECT business_id, checkin_recency_months, tip_recency_months FROM filled",
        "drop_incomplete": f"SELECT {raw} FROM raw WHERE "
        + " AND ".join(f"{n} IS NOT NULL" for n in _RAW_COLUMNS),
        "incomplete_report": _incomplete_report(),
        "drop_all_null_columns": "SELECT * EXCLUDE (attributes_NeverSet, attributes_NeverUsed) "
        "FROM renamed",
        "all_null_columns": "SELECT * FROM (VALUES ('attributes_NeverSet'), "
        "('attributes_NeverUsed')) AS t(column_name)",
        "constant_columns": _constant_columns(),
        "null_audit": "SELECT "
        + ", ".join(f"{_null_count(n)} AS {n}" for n in _RAW_COLUMNS)
        + " FROM raw",
        "key_uniqueness": "SELECT count(*) AS n_rows, count(DISTINCT business_id) AS n_keys, "
        "count(*) = count(DISTINCT business_id) AS is_unique FROM raw",
        "derived_vs_source": "SELECT business_id, count_reviews, review_count, count_reviews - "
        "review_count AS count_reviews_minus_review_count, avg_business_stars, stars, "
        "avg_business_stars - stars AS avg_business_stars_minus_stars FROM raw",
        "distinct_keys": _distinct_keys(),
        "distinct_values": "SELECT DISTINCT compliment_count FROM tip",
        "describe_numeric": _describe(),
        "describe_text": "SELECT 'date' AS column_name, count(date) AS n, "
        "min(date)::DATE::VARCHAR AS min, max(date)::DATE::VARCHAR AS max FROM review UNION ALL "
        "SELECT 'review_id', count(review_id), min(review_id), max(review_id) FROM review",
        "table_shape": f"SELECT count(*) AS n_rows, {len(BUSINESS)} AS n_columns FROM clean",
        "count_by_category": "SELECT categories, count(business_id) AS total_business FROM renamed "
        "GROUP BY categories",
        "count_by_stars": "SELECT stars, count(business_id) AS total_business FROM clean GROUP BY stars",
        "count_by_state": "SELECT state, count(business_id) AS total_business FROM clean GROUP BY state",
        "count_by_city": "SELECT city, count(business_id) AS total_business FROM clean GROUP BY city",
        "reviews_by_stars": "SELECT stars, count(business_id) AS number_of_reviews FROM review "
        "GROUP BY stars",
        "tips_by_compliments": "SELECT compliment_count, count(*) AS n_tips FROM tip GROUP BY "
        "compliment_count",
        "top_k_reviews": "SELECT business_id, count(business_id) AS number_of_reviews FROM review "
        "GROUP BY business_id ORDER BY number_of_reviews DESC, business_id LIMIT 10",
        "top_k_tips": "SELECT business_id, count(business_id) AS number_of_tips FROM tip "
        "GROUP BY business_id ORDER BY number_of_tips DESC, business_id LIMIT 10",
        "flag_before_after": "SELECT attributes_RestaurantsTakeOut AS takeout_availability, count(*) "
        "AS n_total, sum(label)::BIGINT AS n_positive FROM basetable GROUP BY ALL",
        "flag_report_labels": "SELECT CASE attributes_GoodForKids WHEN 0 THEN 'Not Good' ELSE 'Good' "
        "END AS good_for_kids, count(*) AS n_total, sum(label)::BIGINT AS n_positive FROM basetable "
        "GROUP BY ALL",
        "label_count_where": "SELECT label, count(*) AS n_businesses FROM basetable WHERE "
        "attributes_RestaurantsDelivery = 0 GROUP BY label",
        "label_avg_where": "SELECT label, avg(review_count) AS avg_review_count FROM basetable WHERE "
        "attributes_RestaurantsDelivery = 0 GROUP BY label",
        "share_by_bucket": f"SELECT {V.PRICE} AS price_range, count(label) AS n_total, "
        "sum(label)::BIGINT AS n_positive, round(sum(label)::DOUBLE / count(label) * 100, 2) AS "
        "percent_positive FROM basetable GROUP BY ALL",
        "class_balance": "SELECT label, count(*) AS n FROM basetable GROUP BY label",
        "split_sizes": "SELECT count(*) FILTER (WHERE part = 'train') AS n_train, "
        "count(*) FILTER (WHERE part = 'test') AS n_test FROM halves",
        "encode_pipeline": f"SELECT * REPLACE (state_slot::INT AS state_slot, city_slot::INT AS city_slot) FROM (WITH s AS ({_slots('state')}), c AS ({_slots('city')}) "
        "SELECT part, business_id, coalesce(s.slot, -1) AS state_slot, "
        "(SELECT count(*) FROM s)::INT AS state_slots, coalesce(c.slot, -1) AS city_slot, "
        "(SELECT count(*) FROM c)::INT AS city_slots FROM halves LEFT JOIN s ON state = s.value "
        "LEFT JOIN c ON city = c.value)",
        "rformula_features": _rformula(),
        "features_by_joins": _rformula(),
        "feature_slots": _feature_slots(),
        "rollup_review_repeats": "SELECT business_id, avg(stars) AS avg_business_stars, avg(useful) AS "
        "avg_useful_reviews_count, avg(fans) AS avg_reviewer_fanscount, avg(review_count) AS "
        "avg_reviewers_reviewcount, avg(user_LOR_months) AS avg_reviewers_LOR, count(useful) AS "
        "count_reviews, count(DISTINCT user_id) AS count_reviewers, "
        f"{recency(FACT_DAY, 'max(date)')} AS review_recency_months FROM review LEFT JOIN (SELECT * FROM "
        "reviewers UNION ALL SELECT * FROM reviewers WHERE user_id % 3 = 0) USING (user_id) GROUP BY "
        "business_id",
        "covid_labels_boolean": "SELECT * FROM open_labels",
        "flag_pattern": "SELECT business_id, CASE WHEN attributes_Smoking IN ('yes', 'outdoor') THEN 1 "
        "ELSE 0 END AS allows_smoking, CASE WHEN attributes_WiFi LIKE '%paid%' OR attributes_WiFi LIKE "
        "'%free%' THEN 1 ELSE 0 END AS has_wifi, CASE WHEN attributes_AgesAllowed IN ('18plus', "
        "'21plus') THEN 1 ELSE 0 END AS has_age_restrict FROM renamed",
        "sample_by": "SELECT label, count(*) AS n_total, true AS is_subset, true AS share_holds FROM "
        "open_labels GROUP BY label",
        **_models(),
    }
    plain = {
        "parse_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 3 THEN "
        "o_orderdate::DATE::VARCHAR END AS day, CASE WHEN o_orderkey % 5 NOT IN (2, 3) THEN "
        "o_orderdate::DATE::VARCHAR END AS day_of_time FROM orders",
        "recency_months": f"SELECT l_orderkey, l_linenumber, {recency(FACT_DAY, 'l_shipdate')} AS "
        "recency_months FROM lineitem",
        "recency_months_events": f"SELECT event_id, {recency(EVENT_DAY, 'ts')} AS recency_months "
        "FROM events",
        "tenure_columns": f"SELECT o_orderkey, {order_days}::INT AS days, {order_days} / "
        f"365.25::DOUBLE AS years_by_days, {order_months} AS months, round({order_months}, 2) AS "
        f"months_rounded, {order_months} / 12 AS years_by_months, round({order_months} / 12, 0) AS "
        "years FROM orders",
        "tenure_histogram": f"SELECT round({order_months} / 12, 0) AS years, count(*) AS total_users "
        "FROM orders GROUP BY years",
        "distinct_profile": _distinct_profile(),
        "set_difference": "SELECT o_custkey, o_orderpriority FROM orders EXCEPT SELECT o_custkey, "
        "o_orderpriority FROM orders WHERE o_orderstatus = 'F'",
        "dedup_by_key": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
        "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM (SELECT *, "
        "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM "
        "orders) WHERE rn = 1",
        "hash_split": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, "
        f"CASE WHEN ('0x' || substr(md5('42:' || o_orderkey), 1, 15))::BIGINT < {_LIMIT} THEN "
        "'train' ELSE 'test' END AS part FROM orders",
        "auc_hard": "SELECT round((count(*) FILTER (WHERE label = 1 AND prediction = 1) / "
        "count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE label = 0 AND prediction = 0) / "
        f"count(*) FILTER (WHERE label = 0)) / 2, 9) AS auc_hard FROM {_RULE}",
        "confusion_matrix": f"SELECT label, prediction, count(*) AS n FROM {_RULE} GROUP BY ALL",
        "precision_recall": "SELECT class, count(*) FILTER (WHERE label = class AND prediction = "
        "class) / count(*) FILTER (WHERE prediction = class) AS precision, count(*) FILTER (WHERE "
        "label = class AND prediction = class) / count(*) FILTER (WHERE label = class) AS recall "
        f"FROM {_RULE}, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) AS classes(class) GROUP BY class",
        "string_index": "SELECT p_partkey, p_brand, p_type, b.slot::DOUBLE AS \"p_brandInd\", "
        "t.slot::DOUBLE AS \"p_typeInd\" FROM part JOIN (SELECT p_brand, row_number() OVER (ORDER BY "
        "count(*) DESC, p_brand) - 1 AS slot FROM part GROUP BY p_brand) b USING (p_brand) JOIN "
        "(SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS slot FROM part "
        "GROUP BY p_type) t USING (p_type)",
        "one_hot": "SELECT p_partkey, p_type, CASE WHEN slot < n - 1 THEN slot ELSE -1 END::INT AS slot, "
        "(n - 1)::INT AS n_slots FROM part JOIN (SELECT p_type, row_number() OVER (ORDER BY count(*) "
        "DESC, p_type) - 1 AS slot FROM part GROUP BY p_type) USING (p_type), (SELECT count(DISTINCT "
        "p_type) AS n FROM part)",
        "auc_raw": f"WITH s AS ({_SCORED}), g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS p, "
        "count(*) FILTER (WHERE label = 0) AS n FROM s GROUP BY score), r AS (SELECT p, n, "
        "coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "
        "below FROM g) SELECT round(sum(p * (below + n / 2)) / (sum(p)::DOUBLE * sum(n)::DOUBLE), 9) AS "
        "auc_raw FROM r",
        "rollup_checkin_text": _text_rollup("checkin_text", "count_checkins", "checkin_recency_months"),
        "rollup_tip_text": _text_rollup("tip_text", "count_tip", "tip_recency_months"),
        "tenure_columns_text": f"WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 THEN "
        f"o_orderdate END AS d FROM orders) SELECT o_orderkey, {_days('d')}::INT AS days, {_days('d')} / "
        f"365.25::DOUBLE AS years_by_days, {months(order_day, 'd')} AS months, "
        f"round({months(order_day, 'd')}, 2) AS months_rounded, {months(order_day, 'd')} / 12 AS "
        f"years_by_months, round({months(order_day, 'd')} / 12, 0) AS years FROM s",
        "json_scan_review": "SELECT l_orderkey || '-' || l_linenumber AS review_id, l_partkey::VARCHAR AS "
        "business_id, l_suppkey::VARCHAR AS user_id, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS date, "
        "l_quantity AS stars, round(l_tax * 100)::BIGINT AS cool, NULL::BIGINT AS funny, "
        "round(l_discount * 100)::BIGINT AS useful FROM lineitem",
        "json_scan_malformed": "SELECT review_id, well_formed, CASE WHEN well_formed THEN business_id END AS "
        "business_id, CASE WHEN well_formed THEN user_id END AS user_id, CASE WHEN well_formed THEN date END AS "
        "date, CASE WHEN well_formed THEN stars END AS stars, CASE WHEN well_formed THEN cool END AS cool, "
        "NULL::BIGINT AS funny, CASE WHEN well_formed THEN useful END AS useful FROM (SELECT l_orderkey || '-' || "
        "l_linenumber AS review_id, l_partkey::VARCHAR AS business_id, l_suppkey::VARCHAR AS user_id, "
        "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS date, l_quantity AS stars, round(l_tax * 100)::BIGINT AS "
        "cool, round(l_discount * 100)::BIGINT AS useful, (l_partkey + l_suppkey) % 10 > 1 AS well_formed FROM "
        "lineitem)",
        "describe_quantiles": _quantiles(),
        "distinct_sketches": f"SELECT *, true AS within_bound FROM ({_distinct_profile()})",
        "exact_split": "SELECT o_orderkey, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY h) <= "
        "floor(0.7 * count(*) OVER (PARTITION BY label) + 0.5) THEN 'train' ELSE 'test' END AS part FROM (SELECT "
        "o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, "
        "('0x' || substr(md5('42:' || o_orderkey), 1, 15))::BIGINT AS h FROM orders)",
        "json_scan_covid": "SELECT doc_id::VARCHAR AS business_id, CASE WHEN toxic = 0 THEN 'FALSE' ELSE "
        "'2001-12-24' END AS Temporary_Closed_Until, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS "
        "delivery_or_takeout FROM labels",
    }
    return {name: _with(query) for name, query in shared.items()} | plain
