from datetime import timedelta

import pytest
from times import at, utc
from pyspark.sql import functions as F

from kerbside.operators.profiles import (
    candidate_roads, capped_per_road, coverage_ratio, describe_numeric, eligible_roads, excluded_roads, null_profile,
    page_overlap, road_statistics, rows_without_match, systematic_sample, threshold_counts, top_roads_by_coverage,
)
from kerbside.operators.reference import (
    latest_version_per_road, missing_road_ids, normalize_road_reference, reference_for_eligible, roads_not_in_reference,
    sync_reference_projection,
)
from kerbside.schemas import ROAD_RECORD

T0 = at("2024-01-01T00:00:00")
STATS = "iu_ac string, n_observations long, n_valid_q long, n_valid_k long"
REFERENCE = "iu_ac string, libelle string, latitude double, longitude double, road_length_m double, geo_shape string"


def test_statistics_leave_out_broken_ids(spark):
    df = spark.createDataFrame([("1", 1.0, None), ("1", None, 2.0), ("*", 1.0, 1.0), (None, 1.0, 1.0), ("ORA-1", 1.0, 1.0)],
                               "iu_ac string, q double, k double")
    assert [tuple(r) for r in road_statistics(df).collect()] == [("1", 2, 1, 1)]


def test_eligibility_limits_are_inclusive(spark):
    stats = spark.createDataFrame([
        ("1", 2160, 2160, 2052), ("2", 2159, 2159, 2159), ("3", 2160, 2160, 2051), ("4", 0, 0, 0),
        ("5", 9000, 9000, 9000), ("6", 2160, 2160, 2160), ("7", 2160, 2160, 2160)], STATS)
    assert sorted(r["iu_ac"] for r in candidate_roads(stats).collect()) == ["1", "5", "6", "7"]
    reference = spark.createDataFrame([
        ("1", "a", 48.0, 2.0, 10.0, "s"), ("1", "a", 48.0, 2.0, 10.0, "s"), ("5", "b", 48.0, 2.0, 5.0, "s"),
        ("6", "c", 48.0, 2.0, None, "s"), ("9", "d", 48.0, 2.0, 1.0, "s")], REFERENCE)
    assert [r["iu_ac"] for r in eligible_roads(stats, reference).collect()] == ["5", "1"]
    assert candidate_roads(stats, min_observations=0).where("iu_ac = '4'").count() == 0


def test_top_roads_looks_at_every_group(spark):
    rows = [(r, 1.0 if i < k else None) for r, n, k in [("*", 9, 9), ("1", 8, 8), ("2", 9, 7), ("3", 3, 3)] for i in range(n)]
    df = spark.createDataFrame(rows, "iu_ac string, k double")
    assert [r["iu_ac"] for r in top_roads_by_coverage(df).collect()] == ["1", "3"]
    assert [r["iu_ac"] for r in top_roads_by_coverage(df, n=1).collect()] == ["1"]


def test_capped_per_road_matches_brute_force(spark):
    rows = [("a", T0 + timedelta(hours=7 * i)) for i in range(400)] + [("b", T0 + timedelta(hours=i)) for i in range(5)]
    df = spark.createDataFrame(rows, "iu_ac string, timestamp_utc timestamp")
    got = capped_per_road(df, n=50, bucket_hours=24).collect()
    assert sorted(utc(r["timestamp_utc"]) for r in got if r["iu_ac"] == "a") == [utc(t) for _, t in rows[:50]]
    assert sum(r["iu_ac"] == "b" for r in got) == 5


@pytest.mark.parametrize("n, target", [(1000, 30), (25, 30), (30, 30), (59, 30), (61, 30)])
def test_systematic_sample_matches_brute_force(spark, n, target):
    rows = sorted((T0 + timedelta(hours=i % 13), f"{i:04d}") for i in range(n))
    df = spark.createDataFrame([(k, t, i) for i, (t, k) in enumerate(rows)], "iu_ac string, timestamp_utc timestamp, place int")
    got = sorted(r["place"] for r in systematic_sample(df.repartition(5), target).collect())
    assert got == list(range(n))[::max(n // target, 1)][:target]


def test_profiles(spark):
    stats = spark.createDataFrame([("1", 10, 1, 1), ("2", 20, 1, 1), ("3", 40, 1, 1), ("4", 30, 1, 1)], STATS)
    d = describe_numeric(stats, "n_observations").first()
    assert (d["p25"], d["p50"], d["p75"], d["mean"]) == (17.5, 25.0, 32.5, 25.0)
    assert {r["threshold"]: r["n_roads"] for r in threshold_counts(stats, (10, 21, 99)).collect()} == {10: 0, 21: 2, 99: 4}
    assert {r["iu_ac"]: r["coverage_ratio"] for r in coverage_ratio(stats).collect()}["1"] == 0.25
    holes = spark.createDataFrame([(None, 1.0), (None, None), (1.0, None)], "a double, b double")
    assert {r["column_name"]: r["n_missing"] for r in null_profile(holes).collect()} == {"a": 2, "b": 2}
    assert rows_without_match(holes, ["a", "b"]).first()["n_without_match"] == 1
    assert [r["iu_ac"] for r in page_overlap(stats.where("iu_ac < '3'"), stats.where("iu_ac > '1'")).collect()] == ["2"]
    assert [r["iu_ac"] for r in excluded_roads(stats, stats.where("iu_ac <> '2'")).collect()] == ["2"]


def test_missing_start_date_is_the_newest_version(spark):
    rows = spark.createDataFrame([("1", "old", "2020-01-01"), ("1", "new", "2021-01-01"), ("2", "dated", "2021-01-01"),
                                  ("2", "undated", None), ("3", "only", None)], "iu_ac string, libelle string, d string")
    dated = rows.withColumn("date_debut", F.col("d").cast("timestamp"))
    assert {r["iu_ac"]: r["libelle"] for r in latest_version_per_road(dated).collect()} == {
        "1": "new", "2": "undated", "3": "only"}


def test_reference_normalisation(spark):
    line = ("Feature", ("LineString", [[2.0, 48.0], [2.0, 48.01]]))
    df = spark.createDataFrame([
        ("1", "x", "2020-01-01", "bad", "a", "b", (2.0, 48.0), line), ("2", "y", "bad", None, "a", "b", None, None)], ROAD_RECORD)
    first, second = sorted(normalize_road_reference(df).collect(), key=lambda r: r["iu_ac"])
    assert first["road_length_m"] == pytest.approx(1111.949, abs=1e-3) and first["latitude"] == 48.0
    assert first["geo_point_2d"] == '{"lon":2.0,"lat":48.0}' and first["date_fin"] is None
    assert second["road_length_m"] is None and second["geo_shape"] is None and second["date_debut"] is None


def test_id_sets(spark):
    reference = spark.createDataFrame([("1", "a", 1.0, 1.0, 1.0, "s"), ("2", "b", 1.0, 1.0, 1.0, "s")], REFERENCE)
    wanted = spark.createDataFrame([("2",), ("2",), ("3",)], "iu_ac string")
    assert [r["iu_ac"] for r in reference_for_eligible(reference, wanted).collect()] == ["2"]
    assert [r["iu_ac"] for r in roads_not_in_reference(reference, wanted).collect()] == ["1"]
    assert [r["iu_ac"] for r in missing_road_ids(wanted, reference).collect()] == ["3"]
    assert sync_reference_projection(reference.unionByName(reference)).count() == 2
    with pytest.raises(ValueError, match="geo_shape"):
        sync_reference_projection(reference.drop("geo_shape"))


@pytest.mark.parametrize("n", [0, 1, 2, 501])
def test_quartiles_of_many_values(spark, n):
    import numpy as np

    values = [((i * 7919) % 1009) / 8 for i in range(n)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    d = describe_numeric(rows, "x").first()
    want = [float(x) for x in np.percentile(values, [25, 50, 75])] if n else [None] * 3
    assert d["count"] == n and [d["p25"], d["p50"], d["p75"]] == (want if not n else pytest.approx(want))
