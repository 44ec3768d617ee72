import math
import random
from datetime import datetime, timedelta

import pytest
from times import at
from pyspark.sql import functions as F

from kerbside.operators.evaluate import regression_metrics
from kerbside.plans.inference import run_predictions
from kerbside.plans.learners import BoostSettings, GBT, HIST_GBT, score, train_gbt
from kerbside.plans.jobs import inference_job, pending_files, refresh_job, training_job
from kerbside.plans.training import (
    CANDIDATE, CHAMPION, Registry, _split, ablation_all, model_comparison, model_name, promote_candidates, train_all_horizons, train_one_horizon,
)
from kerbside.plans.features import build_prediction_features, build_training_features
from kerbside.schemas import BULK_EXPORT, FEATURES_CORE, FEATURES_TRAFFIC, OBSERVATIONS
from kerbside.operators.keyed import upsert_traffic
from kerbside.sources.tables import read_store, scan_parquet, sink_parquet, write_keyed

T0 = at("2024-01-01T00:00:00")
FAST = BoostSettings(rounds=5, learning_rate=0.3, depth=4, min_leaf_rows=5)
NOW = datetime(2024, 1, 10)


def cells(hours=200):
    """A daily cycle per road with holes."""
    rnd = random.Random(1)
    for road in ("1", "2", "3"):
        for h in range(hours):
            if rnd.random() < 0.95:
                k = 20 + 15 * math.sin(2 * math.pi * h / 24) + int(road) + rnd.uniform(-1, 1)
                yield road, T0 + timedelta(hours=h), None if rnd.random() < 0.05 else 100 + k, k


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame(list(cells()), OBSERVATIONS)


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame([(str(r), 48.0 + r / 100, None if r == 2 else 2.0, 100.0 * r) for r in (1, 2, 3)],
                                 "iu_ac string, latitude double, longitude double, road_length_m double")


@pytest.fixture(scope="module")
def features(spark, obs, reference, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features") / "t")
    return scan_parquet(spark, sink_parquet(build_training_features(obs, reference), path))


def test_defaults():
    assert (GBT.rounds, GBT.learning_rate, GBT.seed, HIST_GBT.rounds) == (300, 0.05, 42, 200)


def test_learner_beats_the_mean_and_takes_missing_values(features):
    train, test = _split(features)
    empty_column = train.withColumn("k_lag_24h", F.lit(None).cast("double"))
    model = train_gbt(empty_column, FEATURES_CORE, settings=FAST)
    rows = test.where("target_k_1h is not null")
    mean = train.agg(F.avg("target_k_1h")).first()[0]
    ours = regression_metrics(score(model, rows), "target_k_1h", "predicted_k").first()["mae"]
    flat = regression_metrics(rows.withColumn("p", F.lit(mean)), "target_k_1h", "p").first()["mae"]
    assert ours < 0.6 * flat
    with pytest.raises(ValueError, match="nothing to train on"):
        train_gbt(train.limit(0), FEATURES_CORE, settings=FAST)


def test_train_promote_predict(spark, obs, reference, features, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry"))
    first = train_all_horizons(registry, features, NOW, settings=FAST).collect()
    assert [(r["horizon_hours"], r["version"]) for r in first] == [(1, 1), (2, 1), (3, 1)]
    assert all(r["train_rows"] > r["test_rows"] > 0 and r["mae"] >= 0 for r in first)
    assert registry.current(CANDIDATE) == {model_name(h): 1 for h in (1, 2, 3)} and registry.current(CHAMPION) == {}

    gates = {r["horizon_hours"]: r for r in promote_candidates(registry, features).collect()}
    assert all(g["reason"] == "initial_champion" for g in gates.values())
    assert registry.current(CHAMPION) == {model_name(h): 1 for h in (1, 2, 3)}
    assert {r["reason"] for r in promote_candidates(registry, features).collect()} == {"candidate_already_champion"}

    train_one_horizon(registry, features, NOW, 1, settings=BoostSettings(rounds=1, depth=1, learning_rate=0.3))
    gate = promote_candidates(registry, features, (1,), min_improvement_pct=0.5).first()
    assert gate["promoted"] is False and gate["candidate_version"] == "2"
    assert registry.current(CHAMPION)[model_name(1)] == 1 and registry.current(CANDIDATE)[model_name(1)] == 2
    with pytest.raises(ValueError):
        train_one_horizon(registry, features, NOW, 7)

    store = str(tmp_path / "predictions")
    assert run_predictions(obs, reference, registry, store) == 9
    assert run_predictions(obs, reference, registry, store) == 9
    rows = read_store(spark, store).collect()
    assert len(rows) == 9 and {r["first_write"] for r in rows} == {1}
    assert {(r["horizon_hours"], r["model_version"]) for r in rows} == {(h, "1") for h in (1, 2, 3)}


def test_prediction_features_have_the_training_columns(obs, reference, features):
    latest = build_prediction_features(obs, reference)
    assert set(FEATURES_CORE) <= set(latest.columns) and "target_k_1h" not in latest.columns
    assert latest.where("k_lag_24h is not null").count() > 0


def test_all_feature_sets_share_their_rows(features):
    rich = features.withColumns({c: F.col("k") for c in [
        "temperature_2m_target_1h", "relative_humidity_2m_target_1h", "precipitation_target_1h", "rain_target_1h",
        "wind_speed_10m_target_1h", "weather_code_target_1h", "event_count_nearby_target_1h", "has_event_nearby_target_1h",
        "is_public_holiday", "is_day_before_public_holiday", "is_day_after_public_holiday", "is_school_holiday"]})
    rows = ablation_all(rich, "2024-01-07 00:00:00", BoostSettings(rounds=1, depth=2)).collect()
    assert len(rows) == 7 and len({r["n_samples"] for r in rows}) == 1
    assert [r["model"] for r in rows if r["is_best"]] != ["Persistence"] and sum(r["is_best"] for r in rows) == 1
    assert next(r for r in rows if r["model"] == "flow")["mae_gain_pct"] == 0.0


def test_the_two_learners_differ(features):
    rows = {r["model"]: r for r in model_comparison(features.withColumns({
        c: F.col("k") for c in FEATURES_TRAFFIC if c not in features.columns}), FAST, FAST).collect()}
    assert len(rows) == 3 and len({r["mae"] for r in rows.values()}) == 3


def test_refresh_job_runs_once_per_delivery(spark, reference, tmp_path):
    inbox, archive = tmp_path / "inbox", tmp_path / "archive"
    registry = Registry(spark, str(tmp_path / "registry"))

    def run():
        return refresh_job(spark, str(inbox), str(archive), str(tmp_path / "store"), str(tmp_path / "features"),
                           reference, registry, NOW, settings=FAST)

    assert run() is None
    rows = [(r, t.strftime("%Y-%m-%dT%H:%M:%SZ"), q, k) for r, t, q, k in cells(120)]
    spark.createDataFrame(rows, BULK_EXPORT).coalesce(1).write.parquet(str(inbox))
    names = pending_files(spark, str(inbox))
    got = {r["horizon_hours"]: r for r in run().collect()}
    assert set(got) == {1, 2, 3} and all(r["promoted"] for r in got.values())
    assert pending_files(spark, str(inbox)) == [] and [pending_files(spark, str(f)) for f in archive.iterdir()] == [names]
    assert read_store(spark, str(tmp_path / "store")).count() == len(rows)
    assert run() is None


def test_weekly_and_hourly_jobs(spark, obs, reference, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry"))
    store, features, predictions = (str(tmp_path / n) for n in ("store", "features", "predictions"))
    now = datetime(2024, 1, 9, 8)

    def train(arrivals, at_time):
        return training_job(spark, arrivals, store, features, reference, registry, at_time, settings=FAST)

    history = obs.where("timestamp_utc < timestamp '2024-01-07 00:00:00'")
    write_keyed(spark, store, history, upsert_traffic)
    with pytest.raises(RuntimeError, match="hours old"):
        train(history, now)
    got = train(obs, now).collect()
    assert read_store(spark, store).count() == obs.count()
    assert {r["reason"] for r in got} == {"initial_champion"}
    assert train(obs, now) is None
    later = spark.createDataFrame([(r, at("2024-01-09T08:00:00"), 100.0, 20.0) for r in ("1", "2", "3")], OBSERVATIONS)
    assert inference_job(spark, later, store, reference, registry, predictions, now) == 9
    assert {r["prediction_timestamp_utc"].hour for r in read_store(spark, predictions).collect()} == {8}
    assert train(later, now) is not None
