from datetime import date, datetime

import pytest
from times import at
from pyspark.sql import functions as F

from kerbside.functions.calendar import easter_sunday, is_public_holiday
from kerbside.operators.cleaning import utc_to_local
from kerbside.operators.features import public_holiday_features, school_holiday_features, time_features

# Published dates of Easter Sunday.
EASTER = ["1961-04-02", "1981-04-19", "1999-04-04", "2000-04-23", "2008-03-23", "2011-04-24", "2016-03-27",
          "2019-04-21", "2024-03-31", "2025-04-20", "2026-04-05", "2038-04-25", "2049-04-18"]


def test_easter(spark):
    df = spark.createDataFrame([(int(d[:4]), d) for d in EASTER], "y int, d string")
    for r in df.select("d", easter_sunday(F.col("y")).alias("e")).collect():
        assert r["e"] == date.fromisoformat(r["d"])


def test_eleven_holidays_a_year(spark):
    days = spark.sql("select explode(sequence(date '2025-01-01', date '2025-12-31')) d")
    found = {r["d"].isoformat() for r in days.where(is_public_holiday(F.col("d"))).collect()}
    assert found == {"2025-01-01", "2025-04-21", "2025-05-01", "2025-05-08", "2025-05-29", "2025-06-09",
                     "2025-07-14", "2025-08-15", "2025-11-01", "2025-11-11", "2025-12-25"}


def local(spark, *times):
    df = spark.createDataFrame([(at(t) if t else None,) for t in times], "timestamp_utc timestamp")
    return utc_to_local(df)


def flags(df):
    return [(r["is_public_holiday"], r["is_day_before_public_holiday"], r["is_day_after_public_holiday"])
            for r in public_holiday_features(df).collect()]


def test_holiday_flags_use_the_local_date(spark):
    df = local(spark, "2024-04-30T22:30:00", "2024-04-30T12:00:00", "2024-05-02T12:00:00", None)
    assert flags(df) == [(True, False, False), (False, True, False), (False, False, True), (False, False, False)]


def test_last_day_of_the_last_year(spark):
    assert flags(local(spark, "2024-12-31T12:00:00")) == [(False, False, False)]
    assert flags(local(spark, "2024-12-31T12:00:00", "2025-02-01T12:00:00"))[0] == (False, True, False)


def test_no_time_at_all_is_an_error(spark):
    with pytest.raises(Exception, match="No valid timestamp"):
        public_holiday_features(local(spark, None)).collect()


def test_school_holidays(spark):
    df = local(spark, "2025-07-04T12:00:00", "2025-07-04T22:30:00", "2025-08-31T12:00:00", "2025-08-31T22:30:00", None)
    assert [r["is_school_holiday"] for r in school_holiday_features(df).collect()] == [False, True, True, False, False]


def test_time_features(spark):
    rows = time_features(local(spark, "2024-01-07T23:30:00", "2024-01-06T12:00:00", None)).collect()
    monday, saturday, missing = rows
    assert (monday["hour"], monday["day_of_week"], monday["is_weekend"]) == (0, 0, False)
    assert (saturday["day_of_week"], saturday["is_weekend"], saturday["month"]) == (5, True, 1)
    assert missing["hour"] is None and missing["is_weekend"] is False
    assert monday["timestamp_paris"] == datetime(2024, 1, 8, 0, 30)
