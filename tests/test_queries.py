"""Every registered query against DuckDB; the rest at least runs to the end."""

from __future__ import annotations

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry_point

# Tuning trees and forests on their full grids takes minutes; FULL_FITS=1 runs these here as well.
# The checks they make are tested on small grids in test_model_checks.py.
LONG = {
    "fit_decision_tree", "fit_random_forest", "cv_metrics", "best_params", "feature_importance",
    "model_metrics", "model_leaderboard",
}

QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = connect(sf_dir)
    yield con
    con.close()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result_as_sql(spark, sf_dir, duck, name):
    if name in LONG and not os.environ.get("FULL_FITS"):
        pytest.skip("full grids")
    assert differences(QUERIES[name](spark, sf_dir), duck, SQL[name]) == []


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_regression_counts_without_category_filter(spark, sf_dir):
    from featuretable.plans.basetable import basetable
    from workload.roles import DAYS, sources

    expected = {"sf0.001": (76, 67), "sf0.01": (348, 299), "sf0.1": (3531, 3027)}
    scale = sf_dir.rstrip("/").rsplit("/", 1)[-1]
    if scale not in expected:
        pytest.skip("no count on record for this scale")
    found = basetable(sources(spark, sf_dir), DAYS, terms=None).selectExpr("count(*)", "sum(label)")
    assert tuple(found.first()) == expected[scale]


def test_stored_rollups_change_nothing(spark, sf_dir):
    from helpers import rows
    from featuretable.plans.basetable import basetable
    from workload.roles import DAYS, sources

    lazy = basetable(sources(spark, sf_dir), DAYS)
    stored = basetable(sources(spark, sf_dir), DAYS, store_rollups=True)
    assert lazy.dtypes == stored.dtypes
    assert rows(lazy) == rows(stored)


def test_entry_works_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry_point.__file__))
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".hypothesis")
    shutil.copytree(root, tmp_path / "repo", ignore=skip)
    code = (
        "import __spark_entry__ as e, workload; "
        "assert not [n for n in {**e.queries(), **e.oracle_sql()} if n.startswith('op') or n == 'pipeline']"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
