"""Newest-row queries over observations and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.values import hours
from kerbside.operators.offsets import BUCKET_HOURS, time_bucket
from kerbside.operators.reference import SEGMENT_COLUMNS
from kerbside.schemas import HORIZONS, KEY, TIME, require_columns

PREDICTION_COLUMNS = [
    KEY, "prediction_timestamp_utc", "target_timestamp_utc", "horizon_hours", "predicted_k", "model_version",
]


def _newest(df: DataFrame, keys: list[str], *order, n: int = 1) -> DataFrame:
    """The n first rows per key. The rank limit runs before the shuffle, so a task gets
    at most n rows of a key from each input partition."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def latest_observation_per_road(df: DataFrame) -> DataFrame:
    return _newest(df.where(F.col(KEY).isNotNull()), [KEY], F.col(TIME).desc_nulls_last())


def latest_timestamp_rows(df: DataFrame, time: str = TIME) -> DataFrame:
    """Rows at the newest time of the whole table."""
    return df.where(F.col(time) == df.agg(F.max(time)).scalar())


def recent_window(obs: DataFrame, hours_back: int = 48) -> DataFrame:
    """Rows no more than n hours before the newest one; the limit belongs to the window."""
    newest = obs.agg(F.max(TIME).alias("newest")).select(F.col("newest") - hours(hours_back))
    return obs.where(F.col(TIME) >= newest.scalar())


def latest_traffic_timestamp(obs: DataFrame) -> DataFrame:
    return obs.agg(F.max(TIME).alias("latest_timestamp"))


def latest_timestamp_by_road(obs: DataFrame, roads: DataFrame | None = None) -> DataFrame:
    """Newest time per road, of all roads or of the listed ones."""
    newest = obs.groupBy(KEY).agg(F.max(TIME).alias("latest_timestamp")).where(F.col("latest_timestamp").isNotNull())
    return newest if roads is None else newest.join(roads.select(KEY), KEY, "left_semi")


def latest_n_for_road(obs: DataFrame, road: str | None = None, n: int = 24) -> DataFrame:
    """The newest n rows of one road, or of every road."""
    if road is not None:
        return obs.where(F.col(KEY) == road).orderBy(F.col(TIME).desc()).limit(n)
    return _newest(obs, [KEY], F.col(TIME).desc_nulls_last(), n=n)


def latest_predictions(predictions: DataFrame, horizon_hours: int | None = 1, horizons=HORIZONS) -> DataFrame:
    """Predictions at a horizon's newest prediction time, one per road: the one first
    written last. With `horizon_hours=None` for all horizons at once."""
    require_columns(predictions, [*PREDICTION_COLUMNS, "first_write"], "prediction")
    wanted = list(horizons) if horizon_hours is None else [horizon_hours]
    rows = predictions.where(F.col("horizon_hours").isin(wanted))
    newest = rows.groupBy("horizon_hours").agg(F.max("prediction_timestamp_utc").alias("prediction_timestamp_utc"))
    current = rows.join(newest, ["horizon_hours", "prediction_timestamp_utc"], "left_semi")
    return _newest(current, ["horizon_hours", KEY], F.col("first_write").desc())


def latest_prediction_for_road(
    predictions: DataFrame, road: str | None = None, horizon_hours: int = 1
) -> DataFrame:
    """The newest prediction of one road, or of every road, by time and then first write."""
    rows = predictions.where(F.col("horizon_hours") == horizon_hours)
    if road is not None:
        rows = rows.where(F.col(KEY) == road)
    return _newest(rows, [KEY], F.col("prediction_timestamp_utc").desc(), F.col("first_write").desc())


def road_history(
    obs: DataFrame, predictions: DataFrame, road: str | None = None, hours_back: int = 24, horizon_hours: int = 1
) -> DataFrame:
    """Rows within n hours of the road's own newest row, with its latest prediction.

    Without `road`, for every road.
    """
    if not 1 <= hours_back <= 168:
        raise ValueError("hours must be between 1 and 168.")
    if horizon_hours not in HORIZONS:
        raise ValueError(f"Nothing is predicted {horizon_hours} hours ahead.")
    rows = obs if road is None else obs.where(F.col(KEY) == road)
    newest = rows.groupBy(KEY).agg(F.max(TIME).alias("_newest"))

    def bucket(time: Column) -> Column:
        return time_bucket(F.unix_micros(time), BUCKET_HOURS)

    # A road's window lies in two time buckets at most; only they are joined, by road and bucket.
    ends = F.array_distinct(F.array(bucket(F.col("_newest")), bucket(F.col("_newest") - hours(hours_back))))
    wanted = newest.select(KEY, "_newest", F.explode(ends).alias("_bucket"))
    recent = (
        rows.withColumn("_bucket", bucket(F.col(TIME))).join(wanted, [KEY, "_bucket"])
        .where(F.col(TIME) >= F.col("_newest") - hours(hours_back)).drop("_newest", "_bucket")
    )
    prediction = latest_prediction_for_road(predictions, road, horizon_hours).select(*PREDICTION_COLUMNS)
    return recent.select(KEY, TIME, "q", "k").join(prediction, KEY, "left")


def top_predicted(predictions: DataFrame, n: int | None = None) -> DataFrame:
    ranked = predictions.orderBy(F.col("predicted_k").desc_nulls_last(), KEY, "horizon_hours", "model_version")
    return ranked if n is None else ranked.limit(n)


def persistence_predictions(latest: DataFrame, horizons=HORIZONS, model_version: str = "persistence") -> DataFrame:
    """The prediction table that assumes k stays as it is."""
    ahead = F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_hours")
    return latest.select(KEY, TIME, "k", ahead).select(
        KEY,
        F.col(TIME).alias("prediction_timestamp_utc"),
        (F.col(TIME) + F.make_dt_interval(hours=F.col("horizon_hours"))).alias("target_timestamp_utc"),
        "horizon_hours",
        F.col("k").alias("predicted_k"),
        F.lit(model_version).alias("model_version"),
    )


# Public columns per kind of answer; the write order of predictions stays internal.
RESPONSES = {"road": SEGMENT_COLUMNS, "observation": [KEY, TIME, "q", "k"], "prediction": PREDICTION_COLUMNS}


def response_projection(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*RESPONSES[kind])
