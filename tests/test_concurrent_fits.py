"""Fits that share a matrix and run at the same time give the models of fits one after the other."""

import numpy as np
import pytest
from times import at

from kerbside.plans.learners import BoostSettings, fit_all, gbt_fit, hist_gbt_fit, score
from kerbside.plans.training import Registry, compare, train_all_horizons
from kerbside.schemas import FEATURES_CORE

FAST = BoostSettings(rounds=4, learning_rate=0.3, depth=3, min_leaf_rows=2)


@pytest.fixture(scope="module")
def rows(spark):
    pick = np.random.default_rng(2)
    data = [(str(i % 5), at(f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00"), float(i % 7), None if i % 9 == 0 else float(pick.normal()),
             float(i % 7 + pick.normal() / 9), None if i % 4 == 0 else float(i % 3)) for i in range(600)]
    return spark.createDataFrame(data, "iu_ac string, timestamp_utc timestamp, a double, b double, target_k_1h double, target_k_2h double")


def predicted(models, rows, fits):
    out = []
    for model, fit in zip(models, fits):
        out.append([r[0] for r in score(model, rows, fit.prediction).orderBy("timestamp_utc").select(fit.prediction).collect()])
    return out


def test_same_models_as_in_sequence(spark, rows):
    fits = [gbt_fit(["a", "b"], settings=FAST), gbt_fit(["b"], "target_k_2h", FAST), hist_gbt_fit(["a", "b"], settings=FAST),
            gbt_fit(["b", "a"], "target_k_2h", FAST, prediction="other")]
    together = predicted(fit_all(rows, fits), rows, fits)
    assert together == predicted(fit_all(rows, fits, at_once=1), rows, fits)
    assert together == [predicted(fit_all(rows, [fit]), rows, [fit])[0] for fit in fits]


def test_a_fit_without_rows_is_an_error(rows):
    with pytest.raises(ValueError, match="nothing to train on"):
        fit_all(rows.where("target_k_2h is null"), [gbt_fit(["a"], settings=FAST), gbt_fit(["a"], "target_k_2h", FAST)])
    with pytest.raises(ValueError, match="Missing"):
        fit_all(rows, [gbt_fit(["a", "no such column"], settings=FAST)])


def test_nothing_stays_in_memory(spark, rows):
    fit_all(rows, [gbt_fit(["a"], settings=FAST), gbt_fit(["b"], settings=FAST)])
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_compare_lines(rows):
    lines = compare(rows.withColumnRenamed("b", "k"), rows.withColumnRenamed("b", "k"), {
        "one": gbt_fit(["a"], settings=FAST), "two": gbt_fit(["a", "k"], settings=FAST)}, reference="one").collect()
    assert {r["model"]: r["n_features"] for r in lines} == {"Persistence": 1, "one": 1, "two": 2}
    assert sum(r["is_best"] for r in lines) == 1 and {r["model"]: r["mae_gain_pct"] for r in lines}["one"] == 0.0


def test_two_runs_from_the_same_state_get_two_versions(spark, rows, tmp_path, monkeypatch):
    registry = Registry(spark, str(tmp_path))
    (model,) = fit_all(rows, [gbt_fit(["a"], settings=FAST)])
    before = registry.versions()
    monkeypatch.setattr(Registry, "versions", lambda self: before)
    record = {"model_name": "congestion-1h", "horizon_hours": 1}
    assert [registry.add(model, record) for _ in range(3)] == [1, 2, 3]
    monkeypatch.undo()
    assert sorted(r["version"] for r in registry.versions().collect()) == [1, 2, 3]
    assert registry.add(model, record) == 4 and registry.claim("congestion-2h") == 1


def test_a_failed_run_leaves_its_version_unused(spark, tmp_path):
    registry = Registry(spark, str(tmp_path))
    assert registry.claim("m") == 1 and registry.claim("m") == 2


def test_all_horizons(spark, tmp_path, rows):
    from pyspark.sql import functions as F

    data = rows.withColumn("target_k_3h", F.col("target_k_1h") + 1)
    for c in FEATURES_CORE:
        data = data if c in data.columns else data.withColumn(c, F.col("a"))
    made = train_all_horizons(Registry(spark, str(tmp_path)), data, at("2024-02-01 00:00:00"), settings=FAST).orderBy("horizon_hours").collect()
    cut = data.select("timestamp_utc").distinct().orderBy("timestamp_utc").collect()[480][0]
    for r in made:
        target = f"target_k_{r['horizon_hours']}h"
        assert r["version"] == 1 and r["train_rows"] == data.where((F.col("timestamp_utc") < cut) & F.col(target).isNotNull()).count()
        assert r["test_rows"] == data.where((F.col("timestamp_utc") >= cut) & F.col(target).isNotNull()).count()
