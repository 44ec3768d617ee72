"""The jobs: bulk refresh, weekly training and hourly inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbside.operators.evaluate import last_training_timestamp
from kerbside.operators.incremental import freshness_gate, new_data_gate
from kerbside.plans.features import build_training_features, make_training_dataset
from kerbside.plans.inference import run_predictions
from kerbside.plans.ingest import bulk_import, incremental_ingest
from kerbside.plans.learners import GBT, BoostSettings
from kerbside.plans.training import Registry, promote_candidates, train_all_horizons
from kerbside.schemas import HORIZONS
from kerbside.sources.files import archive_files, pending_files
from kerbside.sources.tables import read_recent, scan_parquet, sink_parquet


def train_and_promote(
    spark: SparkSession, store: str, features_path: str, reference: DataFrame, registry: Registry, now,
    history_hours: int = 24 * 90, min_improvement_pct: float = 0.5, settings: BoostSettings = GBT,
) -> DataFrame:
    """Dataset, features, one model per horizon, gate; one result row per horizon.

    Training features are written once and read by training and gate.
    """
    dataset = make_training_dataset(read_recent(spark, store, history_hours), history_hours)
    sink_parquet(build_training_features(dataset, reference), features_path)
    features = scan_parquet(spark, features_path)
    trained = train_all_horizons(registry, features, now, HORIZONS, settings)
    gates = promote_candidates(registry, features, HORIZONS, metric="mae", min_improvement_pct=min_improvement_pct)
    return trained.select("horizon_hours", "mae", "rmse").join(
        gates.select("horizon_hours", "promoted", "reason"), "horizon_hours"
    )


def refresh_job(
    spark: SparkSession, inbox: str, archive: str, store: str, features_path: str, reference: DataFrame,
    registry: Registry, now, **training,
) -> DataFrame | None:
    """Everything from the inbox to the champions, or None when nothing is pending.

    Files are archived last, so a failed run is simply run again: the import is keyed.
    """
    names = pending_files(spark, inbox)
    if not names:
        return None
    bulk_import(spark, inbox, reference, store)
    result = train_and_promote(spark, store, features_path, reference, registry, now, **training)
    archive_files(spark, inbox, archive, names)
    return result


def training_job(
    spark: SparkSession, arrivals: DataFrame, store: str, features_path: str, reference: DataFrame,
    registry: Registry, now, max_age_hours: float = 24, **training,
) -> DataFrame | None:
    """The weekly job: ingest, check, train, promote.

    Stale data is an error. Without newer data than the last training saw, nothing is
    trained and the result is None.
    """
    incremental_ingest(spark, arrivals, reference, store, str(now))
    obs = read_recent(spark, store, 0)  # both gates ask for the newest time only
    if obs is None:
        raise RuntimeError("Training aborted: the store is empty.")
    fresh = freshness_gate(obs, str(now), max_age_hours).first()
    if not fresh["is_fresh"]:
        raise RuntimeError(f"Training aborted: the newest observation is {fresh['age_hours']} hours old.")
    if not new_data_gate(obs, last_training_timestamp(registry.versions())).first()["training_required"]:
        return None
    return train_and_promote(spark, store, features_path, reference, registry, now, **training)


def inference_job(
    spark: SparkSession, arrivals: DataFrame, store: str, reference: DataFrame, registry: Registry,
    predictions: str, now, history_hours: int = 48,
) -> int:
    """The hourly job: ingest, then predict every road and horizon; returns the row count."""
    incremental_ingest(spark, arrivals, reference, store, str(now))
    return run_predictions(read_recent(spark, store, history_hours), reference, registry, predictions, history_hours)
