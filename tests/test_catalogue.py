"""The catalogue against DuckDB on the smallest tables."""

import importlib.util
from dataclasses import replace
from pathlib import Path

import duckdb
import pytest

from kerbside.catalogue.oracle import ORACLE
from kerbside.catalogue.queries import QUERIES
from kerbside.plans import learners

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
LEARNERS = {
    "run_predictions", "horizon_predictions", "train_gbt", "train_hist_gbt", "train_horizon", "train_one_horizon",
    "train_all_horizons", "ablation_calendar", "ablation_weather", "ablation_road", "ablation_events", "ablation_all",
    "model_comparison", "train_report", "refresh_job",
}
#: Learner queries that run here, with two rounds; the others take the same paths.
QUICK = ["train_gbt", "train_hist_gbt", "train_all_horizons", "ablation_all", "ablation_weather", "horizon_predictions", "run_predictions",
         "refresh_job"]


def load(name, path):
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


entry = load("spark_entry", ROOT / "__spark_entry__.py")
check = load("check_oracle", ROOT / "tools" / "check_oracle.py")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and LEARNERS < set(QUERIES)


@pytest.mark.parametrize("name", QUICK)
def test_learner_query_equals_sql(spark, db, monkeypatch, name):
    """What SQL can say of a learner query doesn't depend on how long it trains."""
    def few_rounds(matrix, features, fit, real=learners._fit):
        return real(matrix, features, replace(fit, settings=replace(fit.settings, rounds=2)))

    monkeypatch.setattr(learners, "_fit", few_rounds)
    test_query_equals_sql(spark, db, name)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - LEARNERS))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    relation = db.sql(ORACLE[name])
    assert check.difference(df.columns, rows, relation.columns, relation.fetchall()) is None
    assert check.kinds(df.schema, relation.types, relation.columns) == ""


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0


def test_every_query_has_its_operator():
    from kerbside import api

    assert [name for name in QUERIES if not callable(getattr(api, name, None))] == []
