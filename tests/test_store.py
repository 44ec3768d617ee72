from datetime import date, timedelta

import pytest
from times import at, utc

from kerbside.operators.keyed import (
    constraint_checks, dataset_invariants, ids_complete, migrate_horizon, repeated_keys, sync_roads, traffic_batch,
    upsert_predictions, upsert_roads, upsert_traffic, weather_hour_checks,
)
from kerbside.operators.monitoring import alert_evaluations, alerts, champion_version_metric, observation_freshness, prediction_age, prediction_coverage
from kerbside.operators.serving import (
    latest_n_for_road, latest_observation_per_road, latest_prediction_for_road, latest_predictions, latest_timestamp_by_road,
    persistence_predictions, recent_window, road_history,
)
from kerbside.plans.ingest import incremental_ingest, load_traffic_table, sync_road_store, upsert_road_store
from kerbside.schemas import OBSERVATIONS, ROAD_SEGMENTS
from kerbside.sources.tables import read_store, write_keyed

T0 = at("2024-01-01T00:00:00")
PREDICTIONS = ("iu_ac string, prediction_timestamp_utc timestamp, target_timestamp_utc timestamp, horizon_hours int, "
               "predicted_k double, model_version string, first_write long")


def obs(spark, rows):
    return spark.createDataFrame([(r, T0 + timedelta(hours=h), q, k) for r, h, q, k in rows], OBSERVATIONS)


def predictions(spark, rows):
    return spark.createDataFrame(
        [(r, T0 + timedelta(hours=t), T0 + timedelta(hours=t + h), h, k, v, w) for r, t, h, k, v, w in rows], PREDICTIONS)


def facts(df):
    return sorted((r["iu_ac"], int((utc(r["timestamp_utc"]) - utc(T0)).total_seconds() // 3600), r["q"], r["k"]) for r in df.collect())


def test_upsert_replaces_also_by_null(spark):
    old = obs(spark, [("1", 0, 1.0, 1.0), ("1", 1, 2.0, 2.0)])
    new = obs(spark, [("1", 1, None, 9.0), ("2", 0, 5.0, 5.0)])
    want = [("1", 0, 1.0, 1.0), ("1", 1, None, 9.0), ("2", 0, 5.0, 5.0)]
    once = upsert_traffic(old, new)
    assert facts(once) == want and facts(upsert_traffic(once, new)) == want


def test_one_row_per_key_within_a_batch(spark):
    batch = spark.createDataFrame([("1", T0, 1.0, 1.0, 1), ("1", T0, 2.0, None, 2), ("1", None, 3.0, 3.0, 3)],
                                  "iu_ac string, timestamp_utc timestamp, q double, k double, n int")
    assert facts(traffic_batch(batch, "n")) == [("1", 0, 2.0, None)]
    assert repeated_keys(batch.na.drop(subset=["timestamp_utc"]), ["iu_ac", "timestamp_utc"]).first()[0] == 1


def test_store_on_disk(spark, tmp_path):
    store = str(tmp_path / "store")
    assert read_store(spark, store) is None
    first = obs(spark, [("1", 0, 1.0, 1.0), ("1", 30, 2.0, 2.0), ("2", 60, 3.0, 3.0)])
    assert write_keyed(spark, store, first, upsert_traffic) == 3
    untouched = sorted(p.name for p in (tmp_path / "store" / "day=2024-01-03").glob("*.parquet"))
    second = obs(spark, [("1", 0, None, 7.0), ("3", 31, 4.0, 4.0)])
    for _ in range(2):
        assert write_keyed(spark, store, second, upsert_traffic) == 2
        assert facts(read_store(spark, store)) == [
            ("1", 0, None, 7.0), ("1", 30, 2.0, 2.0), ("2", 60, 3.0, 3.0), ("3", 31, 4.0, 4.0)]
    assert untouched == sorted(p.name for p in (tmp_path / "store" / "day=2024-01-03").glob("*.parquet"))
    assert write_keyed(spark, store, first.limit(0), upsert_traffic) == 0
    days = spark.read.parquet(store).where(f"day = date '{date(2024, 1, 2)}'").count()
    assert days == 2


def test_updated_prediction_keeps_its_first_write(spark):
    old = predictions(spark, [("1", 0, 1, 5.0, "1", 10), ("1", 0, 1, 6.0, "2", 20)])
    new = predictions(spark, [("1", 0, 1, 7.0, "1", 30), ("2", 0, 1, 8.0, "1", 30)])
    got = {(r["iu_ac"], r["model_version"]): (r["predicted_k"], r["first_write"]) for r in upsert_predictions(old, new).collect()}
    assert got == {("1", "1"): (7.0, 10), ("1", "2"): (6.0, 20), ("2", "1"): (8.0, 30)}


def segments(spark, rows):
    return spark.createDataFrame([(r, n, 48.0, 2.0, 1.0, None) for r, n in rows], ROAD_SEGMENTS)


def test_road_sync(spark, tmp_path):
    old, new = segments(spark, [("1", "a"), ("2", "b")]), segments(spark, [("2", "B"), ("3", "c")])

    def names(df):
        return sorted((r["iu_ac"], r["libelle"]) for r in df.collect())

    assert names(upsert_roads(old, new)) == [("1", "a"), ("2", "B"), ("3", "c")]
    assert names(sync_roads(old, new)) == [("2", "B"), ("3", "c")]
    assert names(sync_roads(old, new.limit(0))) == [("1", "a"), ("2", "b")]
    store = str(tmp_path / "roads")
    sync_road_store(spark, old, store)
    upsert_road_store(spark, segments(spark, [("9", "z")]), store)
    assert names(read_store(spark, store)) == [("1", "a"), ("2", "b"), ("9", "z")]
    sync_road_store(spark, new, store)
    sync_road_store(spark, new.limit(0), store)
    assert names(read_store(spark, store)) == [("2", "B"), ("3", "c")]


def test_checks(spark):
    bad = obs(spark, [("1", 0, 1.0, 1.0), ("1", 0, 2.0, 2.0)])
    lost = predictions(spark, [("1", 0, 0, 1.0, "1", 1), ("1", 0, 1, None, "1", 1)])
    got = {r["rule"]: r["n_violations"] for r in constraint_checks(bad, segments(spark, [("1", "a")]), lost).collect()}
    assert got == {"observations unique key": 1, "observations not null": 0, "segments unique key": 0, "segments not null": 0,
                   "predictions unique key": 0, "predictions not null": 1, "predictions horizon above zero": 1}
    data = spark.createDataFrame([("1", 1.0, 48.0, 2.0, 1.0), ("2", 1.0, 48.0, 2.0, None)],
                                 "iu_ac string, target_k_1h double, latitude double, longitude double, road_length_m double")
    checks = dataset_invariants(data, data, data).first()
    assert checks["not_empty"] and checks["several_roads"] and checks["target_complete"] and not checks["road_complete"]
    assert ids_complete(data, data).first()["same_ids"] and not ids_complete(data, data.limit(1)).first()["same_ids"]
    hours = obs(spark, [("w", 0, 1.0, 1.0), ("w", 0, 1.0, 1.0)])
    assert weather_hour_checks(hours).first()["hours_unique"] is False
    assert migrate_horizon(lost.drop("horizon_hours")).first()["horizon_hours"] == 1


def test_windows_include_their_start(spark):
    df = obs(spark, [("1", 0, 1.0, 1.0), ("1", 47, 1.0, 1.0), ("1", 48, 1.0, 1.0), ("2", 24, 1.0, 1.0), ("2", 23, 1.0, 1.0), ("2", -1, 1.0, 1.0)])
    assert [f[1] for f in facts(recent_window(df, 48))] == [0, 47, 48, 23, 24]
    none = predictions(spark, [])
    assert [f[1] for f in facts(road_history(df, none, "2", 25))] == [-1, 23, 24]
    assert [f[1] for f in facts(road_history(df, none, None, 1))] == [47, 48, 23, 24]
    with pytest.raises(ValueError):
        road_history(df, none, "2", 169)
    with pytest.raises(ValueError):
        road_history(df, none, "2", 24, 5)


def test_newest_rows(spark):
    df = obs(spark, [("1", 0, 1.0, 1.0), ("1", 5, 1.0, None), ("2", 3, 1.0, 1.0)])
    assert [f[:2] for f in facts(latest_observation_per_road(df))] == [("1", 5), ("2", 3)]
    assert [f[1] for f in facts(latest_n_for_road(df, "1", 1))] == [5]
    assert latest_timestamp_by_road(df, df.limit(0)).count() == 0
    assert latest_timestamp_by_road(df).count() == 2
    ahead = persistence_predictions(latest_observation_per_road(df), (1, 3)).collect()
    assert len(ahead) == 4 and {(r["iu_ac"], r["predicted_k"]) for r in ahead} == {("1", None), ("2", 1.0)}


ROWS = [("1", 5, 1, 1.0, "1", 1), ("1", 5, 1, 2.0, "2", 2), ("2", 4, 1, 3.0, "1", 3), ("3", 5, 1, 4.0, "1", 4), ("1", 9, 2, 9.0, "beta", 5)]


def test_latest_predictions(spark):
    p = predictions(spark, ROWS)
    assert sorted((r["iu_ac"], r["predicted_k"]) for r in latest_predictions(p, 1).collect()) == [("1", 2.0), ("3", 4.0)]
    assert latest_predictions(p, 3).count() == 0
    assert latest_predictions(p, None).count() == 3
    assert latest_prediction_for_road(p, "2", 1).first()["predicted_k"] == 3.0
    history = road_history(obs(spark, [("1", 5, 1.0, 1.0), ("4", 5, 1.0, 1.0)]), p)
    assert {r["iu_ac"]: r["predicted_k"] for r in history.collect()} == {"1": 2.0, "4": None}


def test_monitoring(spark):
    p, now = predictions(spark, ROWS), "2024-01-01 15:00:00"
    roads = segments(spark, [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")])
    coverage = {r["horizon_hours"]: (r["predicted_roads"], r["coverage_ratio"]) for r in prediction_coverage(p, roads).collect()}
    assert coverage == {1: (2, 0.5), 2: (1, 0.25), 3: (0, 0.0)}
    assert all(r["coverage_ratio"] == 0.0 for r in prediction_coverage(p, roads.limit(0)).collect())
    assert {r["horizon_hours"]: r["prediction_age_seconds"] for r in prediction_age(p, now).collect()} == {1: 36000.0, 2: 21600.0}
    assert {r["horizon_hours"]: r["champion_version"] for r in champion_version_metric(p).collect()} == {1: 2.0}
    fresh = observation_freshness(obs(spark, [("1", 5, 1.0, 1.0)]), now)
    assert fresh.first()["observation_age_seconds"] == 36000.0
    assert observation_freshness(obs(spark, [("1", 20, 1.0, 1.0)]), now).first()["observation_age_seconds"] == 0.0
    assert observation_freshness(obs(spark, []), now).count() == 0
    seen = alert_evaluations(obs(spark, [("1", 5, 1.0, 1.0)]), p, roads, now)
    fired = {(r["alert"], r["horizon_hours"]) for r in alerts(seen).collect()}
    assert fired == {("stale observations", None), *(("low prediction coverage", h) for h in (1, 2, 3))}


def test_the_last_row_of_a_delivery_stays(spark, tmp_path):
    """40, then 30, then null for one key: null was delivered last, whatever its size."""
    source, delivered = str(tmp_path / "in"), obs(spark, [("1", 0, 1.0, 40.0), ("1", 0, 1.0, 30.0), ("1", 0, 1.0, None)])
    delivered.coalesce(1).write.parquet(source)
    load_traffic_table(spark, source, str(tmp_path / "a"))
    assert facts(read_store(spark, str(tmp_path / "a"))) == [("1", 0, 1.0, None)]
    arrivals = spark.read.parquet(source).select("*", "_metadata.file_name", "_metadata.row_index")
    roads = spark.createDataFrame([("1",)], "iu_ac string")
    assert incremental_ingest(spark, arrivals, roads, str(tmp_path / "b"), "2024-01-01 06:00:00") == 1
    assert facts(read_store(spark, str(tmp_path / "b"))) == [("1", 0, 1.0, None)]


def test_migration_refuses_repeated_keys(spark):
    twice = predictions(spark, [("1", 0, 1, 1.0, "a", 1), ("1", 0, 1, 2.0, "a", 2)])
    with pytest.raises(Exception, match="repeat a key"):
        migrate_horizon(twice.drop("horizon_hours"), strict=True).collect()
