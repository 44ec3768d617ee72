import math
from datetime import timedelta

import pytest
from times import at, utc

from kerbside.operators.evaluate import (
    evaluation_rows, fixed_cutoff_split, improvement_pct, last_training_timestamp, model_version_lookup,
    persistence_baseline, promote_all, quality_gate, regression_metrics, split_cutoff, temporal_split, version_with_alias,
)

T0 = at("2024-01-01T00:00:00")


def times(spark, hours):
    return spark.createDataFrame([(str(i), None if h is None else T0 + timedelta(hours=h)) for i, h in enumerate(hours)],
                                 "iu_ac string, timestamp_utc timestamp")


@pytest.mark.parametrize("n, test_size", [(2, 0.2), (3, 0.2), (10, 0.2), (10, 0.3), (77, 0.2), (10, 0.9), (10, 0.99), (100, 0.29)])
def test_cutoff_index(spark, n, test_size):
    hours = [h * 7 for h in range(n)]
    want = min(max(int(n * (1 - test_size)), 1), n - 1)
    got = split_cutoff(times(spark, hours + hours + [None]), test_size).first()[0]
    assert utc(got) == utc(T0) + timedelta(hours=hours[want])


def test_split_sides(spark):
    df = times(spark, [0, 0, 1, 2, 3, 4, None])
    train, test = temporal_split(df)
    assert (train.count(), test.count()) == (5, 1)  # the cutoff hour is tested, no time is in neither
    train, test = fixed_cutoff_split(df, "2024-01-01 02:00:00")
    assert (train.count(), test.count()) == (4, 2)  # the cutoff hour trains


def test_split_needs_two_times(spark):
    with pytest.raises(Exception, match="At least 2 distinct"):
        split_cutoff(times(spark, [1, 1, None])).collect()
    with pytest.raises(Exception, match="At least 2 distinct"):
        split_cutoff(times(spark, [None])).collect()
    with pytest.raises(ValueError):
        split_cutoff(times(spark, [1, 2]), 1.0)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 3.0, 2.0), (2.0, 2.0, None), (None, 1.0, 5.0), (4.0, 0.0, 4.0)],
                               "k double, target_k_1h double, target_k_2h double")
    one, two = sorted(persistence_baseline(df, (1, 2)).collect(), key=lambda r: r["horizon_hours"])
    assert (one["mae"], one["n_samples"]) == (2.0, 3) and one["rmse"] == pytest.approx(math.sqrt(20 / 3))
    assert (two["mae"], two["n_samples"]) == (0.5, 2)
    assert regression_metrics(df, "target_k_1h", "k").first()["n_samples"] == 3
    with pytest.raises(Exception, match="Cannot evaluate empty"):
        persistence_baseline(df.where("k is null")).collect()
    with pytest.raises(Exception, match="Cannot evaluate empty"):
        regression_metrics(df.where("k is null"), "target_k_1h", "k").collect()


def test_evaluation_rows_need_target_and_k(spark):
    df = spark.createDataFrame([("1", T0, 1.0, 1.0), ("1", T0 + timedelta(hours=1), 1.0, None), ("2", T0 + timedelta(hours=1), None, 1.0),
                                ("3", T0 + timedelta(hours=1), 1.0, 1.0)], "iu_ac string, timestamp_utc timestamp, k double, target_k_2h double")
    assert [r["iu_ac"] for r in evaluation_rows(df, 2).collect()] == ["3"]


def test_improvement(spark):
    df = spark.createDataFrame([(2.0, 1.0), (0.0, 0.0), (0.0, 1.0), (1.0, 2.0)], "r double, c double")
    assert [r["improvement_pct"] for r in improvement_pct(df, "r", "c").collect()] == [50.0, 0.0, float("-inf"), -100.0]


SCORES = [("1", 1.0), ("2", 0.9), ("3", 0.895), ("4", 2.0), ("5", 0.0)]


def decide(spark, candidate, champion, base=1.0, **options):
    aliases = spark.createDataFrame([("m", 1, candidate, champion)],
                                    "model_name string, horizon_hours int, candidate_version string, champion_version string")
    scores = spark.createDataFrame([("m", v, m, m * 2) for v, m in SCORES], "model_name string, version string, mae double, rmse double")
    baseline = spark.createDataFrame([(1, base, base * 2, 10)], "horizon_hours int, mae double, rmse double, n_samples long")
    return quality_gate(aliases, scores, baseline, **options).first()


def test_five_outcomes(spark):
    r = decide(spark, "4", "2")
    assert (r["reason"], r["promoted"], r["champion_version"], r["champion_mae"]) == ("baseline_gate_failed", False, None, None)
    r = decide(spark, "2", None)
    assert (r["reason"], r["promoted"], r["champion_version"]) == ("initial_champion", True, "2")
    r = decide(spark, "2", "2")
    assert (r["reason"], r["promoted"], r["champion_improvement_pct"], r["champion_mae"]) == ("candidate_already_champion", False, 0.0, 0.9)
    r = decide(spark, "3", "2", min_improvement_pct=0.5)
    assert (r["reason"], r["promoted"], r["champion_version"]) == ("quality_gate_passed", True, "3")
    r = decide(spark, "3", "2", min_improvement_pct=0.6)
    assert (r["reason"], r["promoted"], r["champion_version"]) == ("champion_gate_failed", False, "2")


def test_gate_margins(spark):
    assert decide(spark, "1", None)["reason"] == "initial_champion"  # no gain meets a margin of none
    assert decide(spark, "1", None, min_baseline_improvement_pct=0.1)["reason"] == "baseline_gate_failed"
    assert decide(spark, "1", None, base=0.0)["reason"] == "baseline_gate_failed"
    assert decide(spark, "5", None, base=0.0)["reason"] == "initial_champion"
    assert decide(spark, "4", "4")["reason"] == "baseline_gate_failed"  # the baseline is tested first
    with pytest.raises(ValueError):
        decide(spark, "1", None, metric="r2")


def test_promote_all_reports_status(spark):
    aliases = spark.createDataFrame([("m", 1, "2", None), ("n", 2, "4", None), ("o", 9, "2", None)],
                                    "model_name string, horizon_hours int, candidate_version string, champion_version string")
    scores = spark.createDataFrame([(m, v, s, s) for m in "mno" for v, s in SCORES], "model_name string, version string, mae double, rmse double")
    baseline = spark.createDataFrame([(h, 1.0, 1.0, 10) for h in (1, 2, 9)], "horizon_hours int, mae double, rmse double, n_samples long")
    got = {r["model_name"]: r["status"] for r in promote_all(aliases, scores, baseline).collect()}
    assert got == {"m": "PROMOTED", "n": "NOT PROMOTED"}


def test_run_log_lookups(spark):
    runs = spark.createDataFrame([
        ("m", 1, 1, "a", "champion", "FINISHED", T0, T0), ("m", 1, 2, "b", "champion", "FINISHED", T0 + timedelta(hours=1), None),
        ("m", 1, 3, "c", None, "FAILED", T0 + timedelta(hours=2), T0 + timedelta(hours=9)),
        ("m", 2, 4, "d", None, "FINISHED", T0 + timedelta(hours=3), T0 + timedelta(hours=8))],
        "model_name string, horizon_hours int, version int, run_id string, alias string, status string, started_at timestamp, dataset_max_timestamp timestamp")
    assert utc(last_training_timestamp(runs).first()[0]) == utc(T0)
    later = runs.selectExpr("model_name", "horizon_hours", "version + 10 AS version", "run_id || 'x' AS run_id", "alias", "status",
                            "started_at + INTERVAL 9 DAYS AS started_at", "cast(null as timestamp) AS dataset_max_timestamp")
    assert utc(last_training_timestamp(runs.union(later)).first()[0]) == utc(T0)
    assert model_version_lookup(runs, "champion").first()["version"] == 2
    log = spark.createDataFrame([("m", 1, "champion", 2, 1), ("m", 1, "champion", 1, 2)],
                                "model_name string, horizon_hours int, alias string, version int, assigned_at long")
    assert version_with_alias(log, "champion").first()["version"] == 1
