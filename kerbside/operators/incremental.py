"""Per-road cursors, the bootstrap window and the two training gates. The clock is always
an argument."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.values import hours
from kerbside.operators.offsets import join_per_road
from kerbside.operators.serving import latest_timestamp_by_road
from kerbside.schemas import KEY, TIME


def new_vs_known_roads(roads: DataFrame, obs: DataFrame) -> DataFrame:
    """Each requested road with `is_known`: whether it has history."""
    history = obs.select(KEY).distinct().withColumn("is_known", F.lit(True))
    return (
        roads.select(KEY).distinct().join(history, KEY, "left")
        .withColumn("is_known", F.coalesce("is_known", F.lit(False)))
    )


def cursors(roads: DataFrame, obs: DataFrame) -> DataFrame:
    """Each requested road with the time of its newest row, or null."""
    return roads.select(KEY).distinct().join(latest_timestamp_by_road(obs), KEY, "left")


def road_cursors(roads: DataFrame, obs: DataFrame) -> DataFrame:
    """Number of roads per cursor. `cursors` holds the members, one row per road, so that
    a cursor shared by very many roads is never gathered into one value."""
    return cursors(roads, obs).groupBy("latest_timestamp").agg(
        F.count(F.lit(1)).alias("n_roads"), F.min(KEY).alias("first_road"), F.max(KEY).alias("last_road")
    )


def cursor_filter(arrivals: DataFrame, cursor: DataFrame) -> DataFrame:
    """Rows newer than their road's cursor; roads without a cursor keep all rows."""
    return (
        join_per_road(arrivals, cursor)
        .where(F.col("latest_timestamp").isNull() | (F.col(TIME) > F.col("latest_timestamp")))
        .drop("latest_timestamp")
    )


def bootstrap_window(arrivals: DataFrame, cursor: DataFrame, now: str, bootstrap_hours: int = 72) -> DataFrame:
    """Rows to load, all of them: of known roads what is newer than their cursor, of new roads what is newer than
    now - 72 h. A landed row that isn't loaded now would fall out of the next run's window, so nothing is held back."""
    since = F.lit(now).cast("timestamp") - hours(bootstrap_hours)
    return (
        join_per_road(arrivals, cursor)
        .where(F.col(TIME) > F.coalesce(F.col("latest_timestamp"), since))
        .select(*arrivals.columns)
    )


def freshness_gate(obs: DataFrame, now: str, max_age_hours: float = 24) -> DataFrame:
    """Age of the newest row in hours and whether training may start."""
    newest = F.max(TIME).alias("latest_timestamp")
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("latest_timestamp")) / 3_600_000_000
    return obs.agg(newest).withColumn("age_hours", age).withColumn(
        "is_fresh", F.coalesce(F.col("age_hours") <= max_age_hours, F.lit(False))
    )


def new_data_gate(obs: DataFrame, last_trained: DataFrame) -> DataFrame:
    """Whether the data has moved on since the last training; a first run continues."""
    return obs.agg(F.max(TIME).alias("latest_timestamp")).withColumn(
        "last_trained", last_trained.scalar()
    ).withColumns({
        "new_data_hours": (F.unix_micros("latest_timestamp") - F.unix_micros("last_trained")) / 3_600_000_000,
        "training_required": F.col("last_trained").isNull() | (F.col("latest_timestamp") > F.col("last_trained")),
    })
