"""Alerts fire after they have been breached for a while; runs against a loop over the evaluations."""

from datetime import timedelta

import numpy as np
import pytest
from times import at, utc

from kerbside.operators.monitoring import alert_evaluations, alerts, breach_runs

EVALUATIONS = "alert string, horizon_hours int, evaluated_at timestamp, value double, breached boolean"
START = at("2024-01-01 23:00:00")


def series(spark, name, horizon, flags, step=300):
    return [(name, horizon, START + timedelta(seconds=step * i), float(i), f) for i, f in enumerate(flags) if f is not None]


def brute(rows, hold):
    out = []
    for key in sorted({r[:2] for r in rows}, key=repr):
        run = []
        for r in [*sorted(r for r in rows if r[:2] == key), (*key, None, None, False)]:
            if r[4]:
                run.append(r)
                continue
            if run:
                late = [x[2] for x in run if (x[2] - run[0][2]).total_seconds() >= hold]
                out.append((*key, utc(run[0][2]), utc(run[-1][2]), utc(late[0]) if late else None, len(run), run[-1][3]))
            run = []
    return sorted(out, key=repr)


def got(df, **options):
    return sorted(((r[0], r[1], utc(r[2]), utc(r[3]), utc(r[4]), r[5], r[6]) for r in breach_runs(df, **options).collect()), key=repr)


@pytest.mark.parametrize("bucket_s", [600, 3600, 86_400])
def test_runs_against_brute_force(spark, bucket_s):
    pick = np.random.default_rng(1)
    rows = series(spark, "a", None, [True] * 40) + series(spark, "a", 1, [False, *[True] * 4, False, *[True] * 3, False, True])
    rows += series(spark, "b", None, [None, True, None, None, True, True, None, True, False])
    for k in range(8):
        rows += series(spark, "c", k, [bool(x) for x in pick.random(60) < 0.1 * (k + 2)])
    df = spark.createDataFrame(rows, EVALUATIONS).repartition(5)
    assert got(df, hold_s=900, bucket_s=bucket_s) == brute(rows, 900)


def test_exactly_as_long_as_the_hold_fires(spark):
    rows = series(spark, "a", 1, [True, True, True, True]) + series(spark, "a", 2, [True, True, True]) + series(spark, "a", 3, [True] * 9 + [False])
    df = spark.createDataFrame(rows, EVALUATIONS)
    assert [(r["horizon_hours"], r["value"]) for r in alerts(df).collect()] == [(1, 3.0)]


def test_no_evaluations(spark):
    df = spark.createDataFrame([], EVALUATIONS)
    assert breach_runs(df).collect() == [] and alerts(df).collect() == []


def test_evaluations_know_what_was_known_then(spark):
    obs = spark.createDataFrame([("1", at("2024-01-01 00:02:00")), ("1", at("2024-01-01 00:12:00"))], "iu_ac string, timestamp_utc timestamp")
    made = spark.createDataFrame([("1", at("2024-01-01 00:05:00"), 1)], "iu_ac string, prediction_timestamp_utc timestamp, horizon_hours int")
    roads = spark.createDataFrame([("1",), ("2",)], "iu_ac string")
    rows = alert_evaluations(obs, made, roads, "2024-01-01 00:20:00", horizons=(1, 2), max_age_s=400).collect()
    seen = {(r["alert"][:3], r["horizon_hours"], utc(r["evaluated_at"]).minute): (r["value"], r["breached"]) for r in rows}
    assert {k[2]: v for k, v in seen.items() if k[0] == "sta"} == {5: (180.0, False), 10: (480.0, True), 15: (180.0, False), 20: (480.0, True)}
    assert {k[2]: v[0] for k, v in seen.items() if k[1] == 1} == {5: 0.5, 10: 0.5, 15: 0.5, 20: 0.5}
    assert {k[2]: v[0] for k, v in seen.items() if k[1] == 2} == {5: 0.0, 10: 0.0, 15: 0.0, 20: 0.0}
