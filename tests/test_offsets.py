import random
from datetime import timedelta

import pytest
from times import at, utc
from pyspark.sql import functions as F

from kerbside.operators.offsets import (
    exact_offsets, gap_context, gap_histogram, gaps_over_1h, lags_and_targets, traffic_lags, traffic_targets,
    with_previous_time,
)

T0 = at("2024-01-01T00:00:00")
SCHEMA = "iu_ac string, timestamp_utc timestamp, q double, k double"


def series(spark, rows):
    return spark.createDataFrame([(r, T0 + timedelta(hours=h), q, k) for r, h, q, k in rows], SCHEMA)


def key(row):
    return row["iu_ac"], int((utc(row["timestamp_utc"]) - utc(T0)).total_seconds() // 3600)


def test_lags_go_by_time_not_position(spark):
    df = series(spark, [("a", 0, 1.0, 10.0), ("a", 1, None, 11.0), ("a", 3, 3.0, 13.0), ("a", 24, 4.0, None),
                        ("a", 49, 5.0, 15.0), ("b", 0, 7.0, 70.0), ("b", 1, 8.0, 80.0)])
    got = {key(r): r for r in traffic_lags(df).collect()}
    assert len(got) == 7
    assert got["a", 1]["k_lag_1h"] == 10.0 and got["a", 1]["q_lag_1h"] == 1.0
    assert got["a", 3]["k_lag_1h"] is None  # hour 2 is missing
    assert got["a", 3]["k_lag_2h"] == 11.0 and got["a", 3]["q_lag_2h"] is None  # a null row is data
    assert got["a", 24]["k_lag_24h"] == 10.0
    assert got["a", 49]["k_lag_24h"] is None
    assert got["b", 1]["k_lag_1h"] == 70.0


@pytest.mark.parametrize("bucket_hours", [24, 31, 336])
def test_lookups_match_brute_force_across_buckets(spark, bucket_hours):
    rnd = random.Random(bucket_hours)
    cells = {(r, h): (rnd.choice([None, float(h)]), rnd.choice([None, float(h) + 0.5]))
             for r in "ab" for h in range(-200, 200) if rnd.random() < 0.7}
    df = series(spark, [(r, h, q, k) for (r, h), (q, k) in cells.items()])
    shifts = {"q_1": ("q", -1), "k_24": ("k", -24), "k_up": ("k", 3), "k_two": ("k", 2)}
    rows = exact_offsets(df, shifts, bucket_hours=bucket_hours).collect()
    assert len(rows) == len(cells)
    for row in rows:
        road, hour = key(row)
        for name, (source, shift) in shifts.items():
            want = cells.get((road, hour + shift), (None, None))[0 if source == "q" else 1]
            assert row[name] == want


def test_repeated_key_is_an_error(spark):
    df = series(spark, [("a", 0, 1.0, 1.0), ("a", 0, 2.0, 2.0), ("a", 1, 1.0, 1.0)])
    with pytest.raises(Exception, match="Duplicate key and time"):
        traffic_lags(df).collect()
    with pytest.raises(Exception, match="Duplicate key and time"):
        traffic_lags(df).select("iu_ac").collect()


def test_rows_without_a_time_stay_without_lookups(spark):
    df = spark.createDataFrame([("a", None, 1.0, 1.0), ("a", None, 2.0, 2.0), ("a", T0, 3.0, 3.0)], SCHEMA)
    rows = lags_and_targets(df).collect()
    assert len(rows) == 3
    assert all(r["k_lag_1h"] is None and r["target_k_1h"] is None for r in rows)


@pytest.mark.parametrize("call", [
    lambda df: traffic_lags(df, (0,)), lambda df: traffic_targets(df, ()), lambda df: traffic_targets(df, (1, 1)),
    lambda df: traffic_targets(df, (-1,)), lambda df: traffic_lags(df.drop("q"))])
def test_bad_arguments(spark, call):
    with pytest.raises(ValueError):
        call(series(spark, [("a", 0, 1.0, 1.0)]))


def test_one_shuffle_for_all_lookups(spark, tmp_path):
    series(spark, [("a", h, 1.0, 1.0) for h in range(50)]).write.parquet(str(tmp_path / "t"))
    plan = lags_and_targets(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "_bucket" in plan.split("Exchange")[1]


def test_a_road_is_split_even_after_a_shuffle_by_road(spark):
    df = series(spark, [("hot", h, 1.0, 1.0) for h in range(2000)]).repartition("iu_ac")
    spread = traffic_lags(df).select("timestamp_utc", F.spark_partition_id().alias("p"))
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(iu_ac" in plan and "_bucket" in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert spread.select("p").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_previous_time_across_buckets(spark):
    rnd = random.Random(3)
    hours = sorted(rnd.sample(range(0, 5000), 60))
    df = series(spark, [("a", h, 1.0, 1.0) for h in hours] + [("b", 7, 1.0, 1.0)])
    got = {key(r): r["previous_time"] for r in with_previous_time(df, bucket_hours=24).collect()}
    want = {("a", h): T0 + timedelta(hours=p) if p is not None else None for p, h in zip([None, *hours], hours)}
    assert {k: utc(v) for k, v in got.items()} == {**{k: utc(v) for k, v in want.items()}, ("b", 7): None}


def test_gaps(spark):
    hours = [0, 1, 2, 5, 6, 7, 20]
    df = series(spark, [("a", h, 1.0, 1.0) for h in hours])
    assert {r["gap_hours"]: r["n"] for r in gap_histogram(df).collect()} == {1.0: 4, 3.0: 1, 13.0: 1}
    assert sorted(key(r)[1] for r in gaps_over_1h(df).collect()) == [5, 20]
    around = {r["position"]: key(r)[1] for r in gap_context(df).collect()}
    assert around == {-2: 1, -1: 2, 0: 5, 1: 6, 2: 7}
