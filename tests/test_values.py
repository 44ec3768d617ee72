from datetime import datetime

import pytest
from times import utc
from pyspark.sql import functions as F

from kerbside.functions.values import instant_from_text, is_digits, number_from_text
from kerbside.operators.cleaning import (
    clean_traffic, congestion_class, dedupe_keep_last, normalize_bulk, normalize_json_text, normalize_traffic,
    quality_flags,
)


@pytest.mark.parametrize("text, expected", [
    (" 12 ", 12.0), ("1e3", 1000.0), ("+.5", 0.5), ("5.", 5.0), ("-2.25", -2.25), ("inf", float("inf")),
    ("-Infinity", float("-inf")), ("12f", None), ("12d", None), ("abc", None), ("nan", None), ("", None),
    ("1_000", None), ("0x10", None), ("\t7\n", 7.0), (None, None),
])
def test_number_from_text(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string").select(number_from_text(F.col("t")).alias("n"))
    assert df.first()["n"] == expected


@pytest.mark.parametrize("text, expected", [
    ("2024-01-01T10:00:00+02:00", datetime(2024, 1, 1, 8)),
    ("2024-01-01T10:00:00+0200", datetime(2024, 1, 1, 8)),
    ("2024-01-01 10:00:00", datetime(2024, 1, 1, 10)),
    ("2024-01-01T10:00", datetime(2024, 1, 1, 10)),
    ("2024-01-01T10:00Z", datetime(2024, 1, 1, 10)),
    ("2024-01-01T10:00:00.25Z", datetime(2024, 1, 1, 10, 0, 0, 250000)),
    ("2024-01-01", datetime(2024, 1, 1)),
    (" 2024-01-01 ", datetime(2024, 1, 1)),
    ("2024", None), ("2024-13-01", None), ("soon", None), ("", None), (None, None),
])
def test_instant_from_text(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string").select(instant_from_text(F.col("t")).alias("t"))
    assert utc(df.first()["t"]) == expected


@pytest.mark.parametrize("text, valid", [
    ("123", True), ("*", False), ("ORA-03113", False), ("", False), (None, False), ("12\n", False), ("١٢", False)])
def test_digits_cover_the_whole_id(spark, text, valid):
    df = spark.createDataFrame([(text,)], "t string").select(is_digits(F.col("t")).alias("v"))
    assert df.first()["v"] is valid


def test_clean_keeps_rows_and_prefers_existing_time(spark):
    df = spark.createDataFrame(
        [(" 7 ", "2024-01-01T00:00:00Z", "2024-06-01T00:00:00Z", "12f", "nan"), (None, None, "bad", None, "3")],
        "iu_ac string, t_1h string, timestamp_utc string, q string, k string")
    rows = clean_traffic(df).collect()
    assert len(rows) == 2
    assert rows[0]["iu_ac"] == "7" and rows[0]["q"] is None and rows[0]["k"] is None
    assert utc(rows[0]["timestamp_utc"]) == datetime(2024, 6, 1)
    assert rows[0]["timestamp_paris"] == datetime(2024, 6, 1, 2)
    assert rows[1]["timestamp_utc"] is None and rows[1]["k"] == 3.0


def test_paris_wall_clock_repeats_in_autumn(spark):
    df = spark.createDataFrame([("2024-10-27T00:30:00Z",), ("2024-10-27T01:30:00Z",), ("2024-03-31T01:30:00Z",)], "t_1h string")
    got = [r["timestamp_paris"] for r in clean_traffic(df).collect()]
    assert got == [datetime(2024, 10, 27, 2, 30), datetime(2024, 10, 27, 2, 30), datetime(2024, 3, 31, 3, 30)]


def test_nan_becomes_missing_and_geometry_becomes_text(spark):
    df = spark.createDataFrame(
        [("1", float("nan"), (2.5, 48.5), "kept"), ("2", 1.0, None, None)],
        "iu_ac string, q double, geo_point_2d struct<lon:double,lat:double>, geo_shape string")
    landed = normalize_traffic(df).collect()
    assert landed[0]["q"] is None and landed[0]["geo_point_2d"] == '{"lon":2.5,"lat":48.5}'
    assert landed[0]["geo_shape"] is None  # text is not a nested value
    assert clean_traffic(df).first()["geo_shape"] == "kept"
    assert normalize_json_text(df, "q").first()["q"] is None


def test_flags(spark):
    df = spark.createDataFrame([
        ("12", None, 1.0, 2.0, "Inconnu", "Invalide"), ("*", None, None, 2.0, None, None)],
        "iu_ac string, timestamp_utc timestamp, q double, k double, etat_trafic string, etat_barre string")
    first, second = quality_flags(df).collect()
    assert first["is_valid_iu_ac"] and first["has_complete_measurement"]
    assert first["is_invalid_road_state"] and first["is_unknown_traffic_state"]
    assert not second["is_valid_iu_ac"] and not second["has_q"]
    assert second["is_invalid_road_state"] is False and second["is_unknown_traffic_state"] is False
    with pytest.raises(ValueError, match="etat_barre"):
        quality_flags(df.drop("etat_barre"))


def test_bulk_drops_rows_without_key(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-01", 1.0, None), (None, "2024-01-01", 1.0, 1.0), ("2", "bad", 1.0, 1.0)],
        "iu_ac string, t_1h string, q double, k double")
    assert [r["iu_ac"] for r in normalize_bulk(df).collect()] == ["1"]


def test_dedupe_keeps_last_in_source_order(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-01", 1, 5.0), ("1", "2024-01-01", 2, None), (None, "2024-01-01", 3, 1.0)],
        "iu_ac string, t string, n int, k double").withColumn("timestamp_utc", F.col("t").cast("timestamp"))
    rows = dedupe_keep_last(df, "n").collect()
    assert [(r["n"], r["k"]) for r in rows] == [(2, None)]


def test_band_edges(spark):
    df = spark.createDataFrame([(x,) for x in (14.9, 15.0, 30.0, 50.0, None)], "k double")
    assert [r["congestion"] for r in congestion_class(df).collect()] == [
        "fluid", "pre-saturated", "saturated", "blocked", None]
