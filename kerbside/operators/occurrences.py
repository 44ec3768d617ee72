"""City events: normalisation, occurrence intervals and duration profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.values import hours, instant_from_text, strip, to_instant
from kerbside.schemas import require_columns

EVENT_COLUMNS = ["event_id", "title", "date_start", "date_end", "occurrences", "latitude", "longitude"]
OCCURRENCE_COLUMNS = ["event_id", "title", "occurrence_start", "occurrence_end", "latitude", "longitude"]


def _first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key. Tables have no row order, so the smallest row counts as first."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def normalize_events(df: DataFrame) -> DataFrame:
    require_columns(df, ["event_id", "title", "date_start", "date_end", "occurrences", "lat_lon"], "event")
    rows = df.select(
        "event_id", "title",
        to_instant(df, "date_start").alias("date_start"),
        to_instant(df, "date_end").alias("date_end"),
        "occurrences",
        F.col("lat_lon")["lat"].cast("double").alias("latitude"),
        F.col("lat_lon")["lon"].cast("double").alias("longitude"),
    ).na.drop(subset=["date_start", "date_end"])
    return _first_per_key(
        rows, ["event_id", "date_start", "date_end"], ["title", "occurrences", "latitude", "longitude"]
    )


def explode_occurrences(df: DataFrame, max_hours: float = 24) -> DataFrame:
    """One row per occurrence interval.

    `occurrences` packs start_end pieces, split by semicolons. Text in which no piece
    is readable gives no rows. Only blank or missing text falls back to the event's
    own dates, and then only up to `max_hours`; a negative length passes.
    """
    require_columns(df, EVENT_COLUMNS, "event")
    packed = F.coalesce(F.col("occurrences").rlike(r"\S"), F.lit(False))
    pieces = F.transform(F.split("occurrences", ";"), lambda p: F.split(strip(p), "_", 2))
    listed = F.transform(
        F.filter(pieces, lambda p: F.size(p) == 2),
        lambda p: F.struct(
            instant_from_text(p[0]).alias("occurrence_start"),
            instant_from_text(p[1]).alias("occurrence_end"),
        ),
    )
    start, end = to_instant(df, "date_start"), to_instant(df, "date_end")
    own = F.when(
        end - start <= hours(max_hours),
        F.array(F.struct(start.alias("occurrence_start"), end.alias("occurrence_end"))),
    )
    rows = df.select(
        "event_id", "title", "latitude", "longitude",
        F.inline(F.when(packed, listed).otherwise(own)),
    ).na.drop(subset=["occurrence_start", "occurrence_end", "latitude", "longitude"])
    return _first_per_key(
        rows.select(*OCCURRENCE_COLUMNS),
        ["event_id", "occurrence_start", "occurrence_end"], ["title", "latitude", "longitude"],
    )


def with_duration_hours(events: DataFrame) -> DataFrame:
    seconds = (F.unix_micros("date_end") - F.unix_micros("date_start")) / 1_000_000
    return events.withColumn("duration_hours", seconds / 3600)


def event_duration_profile(events: DataFrame) -> DataFrame:
    lasting = F.col("duration_hours")
    return with_duration_hours(events).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count("occurrences").alias("n_with_occurrences"),
        F.count_if(F.col("occurrences").isNull()).alias("n_without_occurrences"),
        F.count_if(lasting <= 24).alias("n_up_to_24h"),
        F.count_if(lasting > 24).alias("n_over_24h"),
        F.count_if(lasting > 24 * 7).alias("n_over_7d"),
        F.count_if(lasting > 24 * 30).alias("n_over_30d"),
        F.count_if(lasting > 24 * 365).alias("n_over_365d"),
    )


def longest_events(events: DataFrame, n: int = 10) -> DataFrame:
    return (
        with_duration_hours(events)
        .select("event_id", "title", "date_start", "date_end", "duration_hours", "occurrences")
        .orderBy(F.col("duration_hours").desc_nulls_last(), "event_id", "date_start").limit(n)
    )


def events_overlapping_period(events: DataFrame, periods: Sequence[tuple[str, str]]) -> DataFrame:
    """Number of events that touch each period, both ends closed.

    Periods are arguments, so all are counted in one pass without a join.
    """
    require_columns(events, ["date_start", "date_end"], "event")
    if not periods:
        raise ValueError("At least one period is required.")
    lines = []
    for start, end in periods:
        lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
        touches = (F.col("date_start") <= hi) & (F.col("date_end") >= lo)
        lines.append(F.struct(lo.alias("period_start"), hi.alias("period_end"),
                              F.count_if(touches).alias("n_events")))
    return events.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))
