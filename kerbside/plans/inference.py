"""Scoring the newest row of each road with the champions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.values import hours
from kerbside.operators.keyed import upsert_predictions
from kerbside.operators.serving import PREDICTION_COLUMNS, latest_observation_per_road
from kerbside.plans.features import build_prediction_features
from kerbside.plans.learners import score
from kerbside.plans.training import CHAMPION, Registry, model_name
from kerbside.schemas import HORIZONS, TIME
from kerbside.sources.tables import read_store, write_keyed


def horizon_predictions(latest: DataFrame, model: PipelineModel, version: str, horizon: int) -> DataFrame:
    """Prediction rows of one horizon."""
    return score(model, latest).select(
        "iu_ac",
        F.col(TIME).alias("prediction_timestamp_utc"),
        (F.col(TIME) + hours(horizon)).alias("target_timestamp_utc"),
        F.lit(horizon).alias("horizon_hours"),
        "predicted_k",
        F.lit(str(version)).alias("model_version"),
    )


def predict_all(latest: DataFrame, registry: Registry, horizons: Iterable[int] = HORIZONS) -> DataFrame:
    parts = None
    for h in horizons:
        model, version = registry.load(model_name(h), CHAMPION)
        part = horizon_predictions(latest, model, version, h)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def run_predictions(
    obs: DataFrame, reference: DataFrame, registry: Registry, store: str, history_hours: int = 48
) -> int:
    """Features once, the newest row per road, every horizon, one keyed write; returns the row count.

    All rows of a write share one `first_write` number, above all earlier ones.
    """
    spark = registry.spark
    latest = latest_observation_per_road(build_prediction_features(obs, reference, history_hours))
    stored = read_store(spark, store)
    last = stored.agg(F.max("first_write")).first()[0] if stored is not None else None
    latest = latest.persist()  # one row per road, used once per horizon
    try:
        batch = predict_all(latest, registry).withColumn("first_write", F.lit((last or 0) + 1).cast("bigint"))
        return write_keyed(
            spark, store, batch.select(*PREDICTION_COLUMNS, "first_write"), upsert_predictions,
            time="prediction_timestamp_utc",
        )
    finally:
        latest.unpersist()
