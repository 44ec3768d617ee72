"""Calendar, weather and road features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.calendar import is_public_holiday, is_school_holiday
from kerbside.functions.values import hours
from kerbside.operators.reference import one_per_road
from kerbside.schemas import FEATURES_ROAD, KEY, TIME, WEATHER_VARIABLES, require_columns


def time_features(df: DataFrame) -> DataFrame:
    """Local hour, weekday (Monday 0), day, month and weekend; a missing time is no weekend."""
    require_columns(df, ["timestamp_paris"])
    local = F.col("timestamp_paris")
    return df.withColumns({
        "hour": F.hour(local),
        "day_of_week": F.weekday(local),
        "day_of_month": F.dayofmonth(local),
        "month": F.month(local),
        "is_weekend": F.coalesce(F.weekday(local) >= 5, F.lit(False)),
    })


def public_holiday_features(df: DataFrame, years_of: DataFrame | None = None) -> DataFrame:
    """Holiday, day before and day after, by local date.

    Only holidays of years that occur in the data count. That matters on 31 December
    alone: it is the day before a holiday only if the next year occurs. `years_of` is a
    cheaper table with the same years, where `df` is costly to make a second time.
    """
    require_columns(df, ["timestamp_paris"])
    local_year = F.year("timestamp_paris")
    found = F.collect_set(local_year)
    years = (df if years_of is None else years_of).agg(
        F.when(F.size(found) > 0, found)
        .otherwise(F.raise_error(F.lit("No valid timestamp available for calendar features.")).cast("array<int>"))
        .alias("years")
    ).scalar()
    day = F.to_date("timestamp_paris")
    tomorrow = F.date_add(day, 1)
    known_tomorrow = (F.year(tomorrow) == F.year(day)) | F.array_contains(years, F.year(tomorrow))
    return df.withColumns({
        "is_public_holiday": F.coalesce(is_public_holiday(day), F.lit(False)),
        "is_day_before_public_holiday": F.coalesce(is_public_holiday(tomorrow) & known_tomorrow, F.lit(False)),
        "is_day_after_public_holiday": F.coalesce(is_public_holiday(F.date_sub(day, 1)), F.lit(False)),
    })


def school_holiday_features(df: DataFrame) -> DataFrame:
    require_columns(df, ["timestamp_paris"])
    return df.withColumn("is_school_holiday", is_school_holiday(F.to_date("timestamp_paris")))


def target_timestamp(df: DataFrame, horizon_hours: int, time: str = TIME) -> DataFrame:
    return df.withColumn("target_timestamp_utc", F.col(time) + hours(horizon_hours))


def weather_features(df: DataFrame, weather: DataFrame, horizon_hours: int = 1) -> DataFrame:
    """Weather of the target hour; the column suffix is the same for every horizon.

    Spark broadcasts the weather table while its size is below the session's
    threshold and sorts and merges beyond it.
    """
    require_columns(df, [TIME])
    require_columns(weather, [TIME, *WEATHER_VARIABLES], "weather")
    first = Window.partitionBy(TIME).orderBy(*[F.col(c).asc_nulls_last() for c in WEATHER_VARIABLES])
    hourly = (
        weather.withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
        .select(F.col(TIME).alias("_target"), *[F.col(c).alias(f"{c}_target_1h") for c in WEATHER_VARIABLES])
    )
    return (
        df.withColumn("_target", F.col(TIME) + hours(horizon_hours))
        .join(hourly, "_target", "left").drop("_target")
    )


def road_features(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Position and length of the road; unknown roads get null."""
    require_columns(df, [KEY])
    segments = one_per_road(reference, [KEY, *FEATURES_ROAD])
    return df.withColumn(KEY, F.col(KEY).cast("string")).join(segments, KEY, "left")
