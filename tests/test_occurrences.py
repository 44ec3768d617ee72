from datetime import datetime

from times import at, utc

from kerbside.operators.occurrences import (
    event_duration_profile, events_overlapping_period, explode_occurrences, longest_events, normalize_events,
)

EVENTS = ("event_id string, title string, date_start timestamp, date_end timestamp, occurrences string, "
          "latitude double, longitude double")
A, B = "2024-01-01T10:00:00+00:00", "2024-01-01T12:00:00+00:00"
C, D = "2024-02-01T10:00:00+01:00", "2024-02-01T12:00:00Z"


def exploded(spark, occurrences, start="2024-01-01T00:00:00", end="2024-01-02T00:00:00", lat=48.0, lon=2.0):
    df = spark.createDataFrame([("e", "t", at(start), at(end), occurrences, lat, lon)], EVENTS)
    return sorted((utc(r["occurrence_start"]), utc(r["occurrence_end"])) for r in explode_occurrences(df).collect())


ONE = (datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 12))
TWO = (datetime(2024, 2, 1, 9), datetime(2024, 2, 1, 12))
OWN = (datetime(2024, 1, 1), datetime(2024, 1, 2))


def test_pieces(spark):
    assert exploded(spark, f"{A}_{B};{C}_{D}") == [ONE, TWO]
    assert exploded(spark, f" {A}_{B} ; ") == [ONE]
    assert exploded(spark, f"{A}_{B};{A}_{B}") == [ONE]  # a repeated piece counts once
    assert exploded(spark, f"{A};{C}_{D}") == [TWO]  # a piece without a separator is skipped
    assert exploded(spark, f"{A}_{B}_x") == []  # split at the first separator only


def test_unreadable_text_has_no_fallback(spark):
    assert exploded(spark, "tbd") == []
    assert exploded(spark, ";") == []
    assert exploded(spark, "a_b") == []


def test_blank_text_falls_back_up_to_a_day(spark):
    assert exploded(spark, None) == [OWN]
    assert exploded(spark, " \t ") == [OWN]
    assert exploded(spark, None, end="2024-01-02T00:00:01") == []
    assert exploded(spark, None, end="2023-12-01T00:00:00") == [(datetime(2024, 1, 1), datetime(2023, 12, 1))]


def test_coordinates_are_needed(spark):
    assert exploded(spark, f"{A}_{B}", lat=None) == []


def test_normalize_events(spark):
    df = spark.createDataFrame([
        ("1", "b", A, B, None, (2.0, 48.0)), ("1", "a", A, B, None, (2.0, 48.0)), ("2", "c", "bad", B, None, None),
        ("3", "d", A, None, None, None), ("4", "e", A, B, None, None)],
        "event_id string, title string, date_start string, date_end string, occurrences string, lat_lon struct<lon:double,lat:double>")
    rows = {r["event_id"]: r for r in normalize_events(df).collect()}
    assert set(rows) == {"1", "4"} and rows["1"]["title"] == "a"
    assert rows["1"]["latitude"] == 48.0 and rows["4"]["longitude"] is None


def test_periods_and_durations(spark):
    df = spark.createDataFrame([
        ("1", "t", at("2024-01-01T00:00:00"), at("2024-01-02T00:00:00"), "x", 1.0, 1.0),
        ("2", "t", at("2024-01-05T00:00:00"), at("2025-03-01T00:00:00"), None, 1.0, 1.0)], EVENTS)
    got = events_overlapping_period(df, [("2024-01-02 00:00:00", "2024-01-03 00:00:00"), ("2024-01-03 00:00:00", "2024-01-04 00:00:00"),
                                         ("2023-01-01 00:00:00", "2026-01-01 00:00:00")])
    assert [r["n_events"] for r in got.collect()] == [1, 0, 2]
    profile = event_duration_profile(df).first()
    assert (profile["n_up_to_24h"], profile["n_over_24h"], profile["n_over_365d"], profile["n_with_occurrences"]) == (1, 1, 1, 1)
    assert [r["event_id"] for r in longest_events(df, 1).collect()] == ["2"]
