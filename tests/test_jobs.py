"""The whole way on hand-made JSON files, with the raw column names."""

from __future__ import annotations

import json
from types import SimpleNamespace

import pytest
from helpers import rows

from featuretable import fixed_values as V
from featuretable.plans import basetable as B
from featuretable.sources import scratch
from featuretable.sources import tables as S
from featuretable.sources.tables import read_table, write_table
from jobs import build_basetable, common, ingest, write_reports

VISITS = [
    ("a", "2020-03-01 10:00:00"), ("a", "2019-12-31 09:00:00"), ("b", "2019-04-01 00:00:00"),
]


def save(folder, name, records):
    path = folder / f"{name}.json"
    path.write_text("".join(json.dumps(r) + "\n" for r in records))
    return str(path)


def business(key, categories="Restaurants", **attributes):
    found = {
        "business_id": key, "name": key.upper(), "categories": categories, "city": "X",
        "state": "Y", "is_open": 1, "review_count": 7, "stars": 3.5,
    }
    return found | {f"attributes.{name}": value for name, value in attributes.items()}


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("json")
    tables = {
        "business": [
            business("a", "Food, Shops", GoodForKids="True", WiFi="u'free'", RestaurantsPriceRange2="1"),
            business("b", "Sports Bars", GoodForKids="None", Alcohol="u'none'", RestaurantsPriceRange2="None"),
            business("c", "Shoes", GoodForKids="True"),  # out of scope
            business("d"),  # closed
            business("e"),  # never reviewed
            business("f", HasTV="True"),  # no visit, no tip
        ],
        "checkin": [{"business_id": k, "date": d} for k, d in VISITS],
        "covid": [
            {"business_id": k, "Temporary Closed Until": closed, "delivery or takeout": delivers}
            for k, closed, delivers in [
                ("a", "FALSE", "TRUE"), ("a", "FALSE", "TRUE"), ("b", "FALSE", "FALSE"),
                ("d", "2020-05-01", "TRUE"), ("e", "FALSE", "TRUE"), ("f", "FALSE", "TRUE"),
            ]
        ],
        "user": [
            {"user_id": "u1", "average_stars": 4.0, "fans": 2, "review_count": 10,
             "joined": "2019-04-01 00:00:00"},
            {"user_id": "u2", "average_stars": 3.0, "fans": 4, "review_count": 20,
             "joined": "2018-04-01 00:00:00"},
        ],
        "review": [
            {"review_id": str(i), "business_id": k, "user_id": u, "date": d, "stars": s, "useful": n,
             "cool": 0, "funny": 0}
            for i, (k, u, d, s, n) in enumerate([
                ("a", "u1", "2020-01-01 12:00:00", 5.0, 1), ("a", "u1", "2020-02-01 12:00:00", 3.0, 0),
                ("a", "u2", "2018-02-01 12:00:00", 1.0, 2), ("b", "u2", "2020-03-31 00:00:00", 4.0, 0),
                ("d", "u1", "2020-01-01 00:00:00", 4.0, 0), ("f", "u1", "2019-04-01 00:00:00", 2.0, 1),
            ])
        ],
        "tip": [{"business_id": "b", "date": "2020-02-15 01:00:00", "compliment_count": 1}],
    }
    return {name: save(folder, name, records) for name, records in tables.items()}


@pytest.fixture(scope="module")
def stored(spark, inputs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out") / "basetable")
    paths = [arg for name, path in inputs.items() for arg in (f"--{name}", path)]
    build_basetable.main([*paths, "--since", "joined", "--output", out])
    return out, paths


def test_basetable_from_json(spark, stored):
    table = {r.business_id: r for r in read_table(spark, stored[0], fmt="parquet").collect()}
    assert sorted(table) == ["a", "b", "f"]
    a, b, f = table["a"], table["b"], table["f"]
    assert (a.attributes_GoodForKids, a.has_wifi, a.attributes_RestaurantsPriceRange2) == (1, 1, 1.0)
    assert (b.attributes_GoodForKids, b.doesnt_serve_alcohol, b.attributes_RestaurantsPriceRange2) == (0, 1, 2.5)
    assert (f.attributes_HasTV, f.attributes_RestaurantsPriceRange2) == (1, 2.5)
    assert (a.count_checkins, a.checkin_recency_months) == (2, 1.0)
    assert (b.count_checkins, b.checkin_recency_months) == (1, 12.0)
    assert (f.count_checkins, f.checkin_recency_months) == (0, 12.0)
    assert [(r.count_tip, r.tip_recency_months) for r in (a, b, f)] == [(0, 2.0), (1, 2.0), (0, 2.0)]
    assert (a.avg_business_stars, a.avg_useful_reviews_count) == (3.0, 1.0)
    assert (a.count_reviews, a.count_reviewers, a.review_recency_months) == (3, 2, 2.0)
    assert a.avg_reviewer_fanscount == pytest.approx((2 + 2 + 4) / 3)
    assert a.avg_reviewers_reviewcount == pytest.approx((10 + 10 + 20) / 3)
    assert a.avg_reviewers_LOR == pytest.approx((12 + 12 + 24) / 3)
    assert [r.label for r in (a, b, f)] == [1, 0, 1]


def test_reports_from_json(spark, stored, tmp_path):
    out, paths = stored
    write_reports.main([*paths, "--since", "joined", "--basetable", out, "--output", str(tmp_path)])

    def report(name):
        return rows(read_table(spark, str(tmp_path / name), fmt="parquet"))

    assert report("business_per_city") == [("X", 5)]
    assert ("Shoes", 1) in report("business_per_category")
    assert report("most_reviewed")[0] == ("a", 3)
    assert report("users_per_year") == [(1.0, 1), (2.0, 1)]
    assert report("kids_before_after") == [("Good", 1, 1), ("Not Good", 2, 1)]
    assert report("share_by_price") == [(1.0, 1, 1, 100.0), (2.5, 2, 1, 50.0)]
    assert report("new_deliveries") == [(0, 1), (1, 2)]
    assert report("average_reviews_of_new_deliveries") == [(0, 7.0), (1, 7.0)]


def test_all_null_column_survives_json_with_a_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "id int, gone string")
    write_table(df, str(tmp_path / "t"), "json")
    assert read_table(spark, str(tmp_path / "t")).columns == ["id"]
    assert rows(read_table(spark, str(tmp_path / "t"), df.schema)) == [(1, None)]
    write_table(df.union(df), str(tmp_path / "t"), "json")
    assert read_table(spark, str(tmp_path / "t"), df.schema).count() == 2
    with pytest.raises(ValueError, match="format"):
        write_table(df, str(tmp_path / "t"), "csv")


def stub_session(setting, master):
    conf = SimpleNamespace(get=lambda name, default: setting if name == scratch.SETTING else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_scratch_follows_the_session_setting():
    path = scratch.scratch_path(stub_session("hdfs://shared/dir/", "yarn"), "one")
    assert path.startswith("hdfs://shared/dir/one-")
    assert path != scratch.scratch_path(stub_session("hdfs://shared/dir/", "yarn"), "one")


def test_scratch_is_refused_on_a_cluster_without_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_path(stub_session(None, "yarn"), "one")
    assert "featuretable-" in scratch.scratch_path(stub_session(None, "local[2]"), "one")


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, gone string")
    for fmt in ("json", "parquet"):
        stored = scratch.materialize(df, "one", fmt)
        assert stored.schema == df.schema
        assert rows(stored) == rows(df)


def test_keep_list_covers_the_raw_attributes():
    assert len(common.RAW_ATTRIBUTES) == 38
    assert len(V.SIMPLE_FLAGS) == 24
    assert len(V.SPECIAL_FLAGS) == 10


def test_scratch_warns_of_a_folder_of_one_machine():
    with pytest.warns(UserWarning, match="share that folder"):
        scratch.scratch_path(stub_session("file:///data/dir", "yarn"), "one")


def test_remove_written_leaves_nothing(spark):
    import os

    stored = scratch.materialize(spark.range(3).toDF("id"), "gone")
    path = stored.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    before = list(scratch._written)
    scratch._written[:] = [p for p in before if "/gone-" in p]
    scratch.remove_written(spark)
    assert not os.path.exists(path) and not scratch._written


def test_a_declared_column_without_values_is_refused(spark, tmp_path):
    path = save(tmp_path, "user", [{"user_id": "u", "joined": "2019-04-01 00:00:00"}])
    schema = S.user_schema("user_since")
    assert read_table(spark, path, schema).count() == 1
    with pytest.raises(ValueError, match="user_since"):
        read_table(spark, path, schema, required=["user_id", "user_since"])


def test_since_has_to_be_named(stored):
    with pytest.raises(SystemExit):
        build_basetable.main([*stored[1], "--output", "nowhere"])


def test_loss_report_stands_beside_the_table(spark, stored):
    losses = {r.column_name: r for r in read_table(spark, stored[0] + "-losses", fmt="parquet").collect()}
    assert (losses["label"].missing, losses["label"].rows_before, losses["label"].rows_after) == (1, 5, 3)


def test_repeated_businesses_are_refused(spark, inputs, tmp_path):
    twice = dict(inputs, business=save(tmp_path, "business", [business("a"), business("a")]))
    paths = [arg for name, path in twice.items() for arg in (f"--{name}", path)]
    args = [*paths, "--since", "joined", "--output", str(tmp_path / "out")]
    with pytest.raises(ValueError, match="not unique"):
        build_basetable.main(args)


def test_text_dates_count_even_if_they_are_none(spark):
    rows_ = [("a", "2020-01-01 10:00:00"), ("a", "2020-02-01"), ("a", "junk"), ("b", "2020-02-01"), ("b", None)]
    visits = spark.createDataFrame(rows_, "business_id string, date string")
    found = {r.business_id: (r.count_checkins, r.checkin_recency_months) for r in B.rollup_checkin(visits, "2020-04-01").collect()}
    assert found == {"a": (3, 3.0), "b": (1, None)}


def test_booleans_and_texts_close_a_business_alike(spark):
    texts = spark.createDataFrame(
        [("a", "FALSE", "TRUE"), ("b", "false", "true"), ("c", "False", "TRUE"), ("d", "true", "TRUE")],
        "business_id string, `Temporary Closed Until` string, `delivery or takeout` string",
    )
    assert rows(B.covid_labels(texts)) == [("a", "TRUE", 1), ("b", "TRUE", 1)]
    flags = spark.createDataFrame(
        [("a", False, True), ("b", True, True)],
        "business_id string, `Temporary Closed Until` boolean, `delivery or takeout` boolean",
    )
    assert rows(B.covid_labels(flags)) == [("a", "TRUE", 1)]


def test_a_repeated_user_is_one_reviewer(spark):
    reviews = spark.createDataFrame(
        [("x", "u", "2020-01-01 00:00:00", 4.0, 1), ("x", "v", "2020-01-01 00:00:00", 1.0, 0)],
        "business_id string, user_id string, date string, stars double, useful long",
    )
    users = spark.createDataFrame(
        [("u", 4.0, 3, 10, 5.0), ("u", 4.0, 6, 10, 5.0), ("v", 4.0, 0, 10, 5.0)],
        "user_id string, average_reviewer_stars double, fans long, review_count long, user_LOR_months double",
    )
    row = B.rollup_review(reviews, users, "2020-04-01").first()
    assert (row.count_reviewers, row.count_reviews) == (2, 3)
    assert row.avg_business_stars == pytest.approx(3.0) and row.avg_reviewer_fanscount == pytest.approx(3.0)


def test_ingested_tables_give_the_same_base_table(spark, stored, tmp_path):
    out, paths = stored
    ingest.main([*paths, "--since", "joined", "--output", str(tmp_path)])
    names = ("business", "checkin", "covid", "user", "review", "tip")
    again = [arg for name in names for arg in (f"--{name}", str(tmp_path / name))]
    build_basetable.main(
        [*again, "--format", "parquet", "--since", "joined", "--output", str(tmp_path / "base")]
    )
    read = lambda path: rows(read_table(spark, path, fmt="parquet"))
    assert read(str(tmp_path / "base")) == read(out)
