"""Training per horizon, a file-based model registry and the feature-set comparisons."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.evaluate import promote_all, regression_metrics, split_cutoff, version_with_alias
from kerbside.plans.learners import GBT, HIST_GBT, BoostSettings, Fit, fit_all, gbt_fit, hist_gbt_fit, score
from kerbside.schemas import (
    FEATURES_CALENDAR, FEATURES_CORE, FEATURES_EVENT, FEATURES_HOLIDAY, FEATURES_ROAD, FEATURES_TARGET_WEATHER,
    FEATURES_TRAFFIC, FEATURES_WEATHER, HORIZONS, MODEL_VERSIONS, TIME, require_columns, target_column,
)
from kerbside.sources.files import create_new
from kerbside.sources.tables import read_store

BASE_NAME = "congestion"
CANDIDATE, CHAMPION = "candidate", "champion"
PERSISTENCE = "Persistence"
ALIASES = "model_name string, horizon_hours int, alias string, version int, assigned_at bigint"


def model_name(horizon: int, base: str = BASE_NAME) -> str:
    if horizon <= 0:
        raise ValueError(f"A horizon of {horizon} hours has no model; it has to be one hour at least.")
    return f"{base}-{horizon}h"


class Registry:
    """Saved models, a log of trained versions and a log of alias assignments.

    Both logs are only appended to; the newest assignment of an alias counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self, name: str, schema) -> DataFrame:
        stored = read_store(self.spark, f"{self.root}/{name}")
        return self.spark.createDataFrame([], schema) if stored is None else stored

    def versions(self) -> DataFrame:
        return self._log("model_versions", MODEL_VERSIONS)

    def aliases(self) -> DataFrame:
        return self._log("aliases", ALIASES)

    def path(self, name: str, version: int) -> str:
        return f"{self.root}/models/{name}/v{version}"

    def claim(self, name: str) -> int:
        """A version of the model that no other run has or gets: the first whose marker file this run creates."""
        newest = self.versions().where(F.col("model_name") == name).agg(F.max("version")).first()[0]
        version = (newest or 0) + 1
        while not create_new(self.spark, f"{self.root}/claims/{name}/v{version}"):
            version += 1
        return version

    def add(self, model: PipelineModel, record: Mapping[str, Any]) -> int:
        name = record["model_name"]
        version = self.claim(name)
        model.save(self.path(name, version))
        row = tuple({**record, "version": version}.get(f.name) for f in MODEL_VERSIONS.fields)
        self.spark.createDataFrame([row], MODEL_VERSIONS).write.mode("append").parquet(f"{self.root}/model_versions")
        return version

    def assign(self, assignments: DataFrame) -> None:
        """Append (model_name, horizon_hours, alias, version) as the newest assignments."""
        last = self.aliases().agg(F.max("assigned_at")).first()[0] or 0
        rows = assignments.select(
            "model_name", F.col("horizon_hours").cast("int").alias("horizon_hours"), "alias",
            F.col("version").cast("int").alias("version"), F.lit(last + 1).cast("bigint").alias("assigned_at"),
        ).collect()  # one row per model
        if rows:
            self.spark.createDataFrame(rows, ALIASES).write.mode("append").parquet(f"{self.root}/aliases")

    def current(self, alias: str) -> dict[str, int]:
        return {r["model_name"]: r["version"] for r in version_with_alias(self.aliases(), alias).collect()}

    def load(self, name: str, alias: str) -> tuple[PipelineModel, int]:
        version = self.current(alias).get(name)
        if version is None:
            raise LookupError(f"No version of {name} has the alias {alias}.")
        return PipelineModel.load(self.path(name, version)), version


def _split(dataset: DataFrame, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The temporal split with the cutoff as a literal, which the scans can push down."""
    cutoff = F.lit(split_cutoff(dataset, test_size).first()[0])
    return dataset.where(F.col(TIME) < cutoff), dataset.where(F.col(TIME) >= cutoff)


def _dataset_facts(dataset: DataFrame) -> dict[str, Any]:
    return dataset.agg(
        F.count(F.lit(1)).alias("dataset_rows"),
        F.min(TIME).alias("dataset_min_timestamp"), F.max(TIME).alias("dataset_max_timestamp"),
    ).first().asDict()


def train_horizons(
    registry: Registry, train: DataFrame, test: DataFrame, horizons: Sequence[int], now, facts: Mapping[str, Any],
    settings: BoostSettings = GBT, features: Sequence[str] = FEATURES_CORE, base: str = BASE_NAME,
) -> list[dict[str, Any]]:
    """Fit all horizons at once; then score each one's test rows, save the model, log the version and make it the candidate."""
    models = fit_all(train, [gbt_fit(features, target_column(h), settings) for h in horizons])
    counts = train.agg(*(F.count(target_column(h)) for h in horizons)).first()
    records = []
    for horizon, model, train_rows in zip(horizons, models, counts):
        target = target_column(horizon)
        metrics = regression_metrics(score(model, test.where(F.col(target).isNotNull())), target, "predicted_k").first()
        record = {
            "model_name": model_name(horizon, base), "horizon_hours": horizon, "run_id": uuid.uuid4().hex,
            "alias": CANDIDATE, "status": "FINISHED", "started_at": now, "features": list(features),
            "mae": metrics["mae"], "rmse": metrics["rmse"],
            "train_rows": train_rows, "test_rows": metrics["n_samples"], **facts,
        }
        record["version"] = registry.add(model, record)
        records.append(record)
    registry.assign(registry.spark.createDataFrame(
        [(r["model_name"], r["horizon_hours"], CANDIDATE, r["version"]) for r in records],
        "model_name string, horizon_hours int, alias string, version int",
    ))
    return records


def train_horizon(
    registry: Registry, train: DataFrame, test: DataFrame, horizon: int, now, facts: Mapping[str, Any],
    settings: BoostSettings = GBT, features: Sequence[str] = FEATURES_CORE, base: str = BASE_NAME,
) -> dict[str, Any]:
    """One horizon of `train_horizons`."""
    return train_horizons(registry, train, test, [horizon], now, facts, settings, features, base)[0]


def train_all_horizons(
    registry: Registry, dataset: DataFrame, now, horizons: Iterable[int] = HORIZONS,
    settings: BoostSettings = GBT, features: Sequence[str] = FEATURES_CORE,
) -> DataFrame:
    """One shared split, one model per horizon; returns the new rows of the version log."""
    horizons = tuple(horizons)
    require_columns(dataset, [TIME, *features, *map(target_column, horizons)], "training dataset")
    train, test = _split(dataset)
    records = train_horizons(registry, train, test, horizons, now, _dataset_facts(dataset), settings, features)
    rows = [tuple(r.get(f.name) for f in MODEL_VERSIONS.fields) for r in records]
    return registry.spark.createDataFrame(rows, MODEL_VERSIONS)


def train_one_horizon(registry: Registry, dataset: DataFrame, now, horizon: int = 1, **options) -> DataFrame:
    if horizon not in HORIZONS:
        raise ValueError(f"No model looks {horizon} hours ahead; choose one of {HORIZONS}.")
    return train_all_horizons(registry, dataset, now, (horizon,), **options)


def _error_lines(scored: DataFrame, target: str, columns: Mapping[str, str]) -> DataFrame:
    """One row per model with its errors, all from one pass; `columns` maps names to predictions."""
    lines = []
    for name, column in columns.items():
        error = F.col(target) - F.col(column)
        lines.append(F.struct(
            F.lit(name).alias("model"), F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"), F.count(error).alias("n_samples"),
        ))
    return scored.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def promote_candidates(
    registry: Registry, dataset: DataFrame, horizons: Iterable[int] = HORIZONS, test_size: float = 0.2, **gate
) -> DataFrame:
    """Score persistence, candidate and champion of each horizon in one pass over the same
    rows, decide, and move the champion alias."""
    spark = registry.spark
    candidates, champions = registry.current(CANDIDATE), registry.current(CHAMPION)
    _, test = _split(dataset, test_size)
    entries, scores, baselines = [], [], []
    for h in horizons:
        name, target = model_name(h), target_column(h)
        if name not in candidates:
            raise LookupError(f"No candidate for {name}.")
        rows, columns = test.na.drop(subset=[target, "k"]), {PERSISTENCE: "k"}
        for version in sorted({candidates[name], champions.get(name, candidates[name])}):
            columns[str(version)] = f"_v{version}"
            model = PipelineModel.load(registry.path(name, version))
            rows = score(model, rows, "predicted_k").withColumnRenamed("predicted_k", f"_v{version}")
        for line in _error_lines(rows, target, columns).collect():
            if not line["n_samples"]:
                raise ValueError(f"No test row has both k and its value {h} h later, so nothing can be compared.")
            if line["model"] == PERSISTENCE:
                baselines.append((h, line["mae"], line["rmse"], line["n_samples"]))
            else:
                scores.append((name, line["model"], line["mae"], line["rmse"]))
        entries.append((name, h, str(candidates[name]), str(champions[name]) if name in champions else None))
    aliases = spark.createDataFrame(
        entries, "model_name string, horizon_hours int, candidate_version string, champion_version string")
    scored = spark.createDataFrame(scores, "model_name string, version string, mae double, rmse double")
    baseline = spark.createDataFrame(baselines, "horizon_hours int, mae double, rmse double, n_samples long")
    decided = promote_all(aliases, scored, baseline, horizons, **gate)
    # One row per horizon, kept as it was decided.
    result = spark.createDataFrame(decided.collect(), decided.schema)
    registry.assign(result.where("promoted").select(
        "model_name", "horizon_hours", F.lit(CHAMPION).alias("alias"), F.col("candidate_version").alias("version")
    ))
    return result


# The feature sets that are compared.
CALENDAR_SETS = {
    "flow": FEATURES_TRAFFIC,
    "flow, holidays": FEATURES_TRAFFIC + FEATURES_HOLIDAY,
    "flow, calendar": FEATURES_TRAFFIC + FEATURES_CALENDAR,
}
WEATHER_SETS = {
    "flow": FEATURES_TRAFFIC,
    "flow, weather": FEATURES_TRAFFIC + FEATURES_TARGET_WEATHER,
}
ROAD_SETS = {"flow": FEATURES_TRAFFIC, "flow, road": FEATURES_TRAFFIC + FEATURES_ROAD}
EVENT_SETS = {"flow": FEATURES_TRAFFIC, "flow, city events": FEATURES_TRAFFIC + FEATURES_EVENT}
ALL_SETS = {
    "flow": FEATURES_TRAFFIC,
    "flow, calendar": FEATURES_TRAFFIC + FEATURES_CALENDAR,
    "flow, weather": FEATURES_TRAFFIC + FEATURES_TARGET_WEATHER,
    "flow, road": FEATURES_TRAFFIC + FEATURES_ROAD,
    "flow, city events": FEATURES_TRAFFIC + FEATURES_EVENT,
    "flow, road, city events": FEATURES_TRAFFIC + FEATURES_ROAD + FEATURES_EVENT,
}


def compare(
    train: DataFrame, rows: DataFrame, fits: Mapping[str, Fit], reference: str | None = None,
) -> DataFrame:
    """Fit the models at the same time and score all of them, and persistence, in one pass over the rows.

    All fits have one target. Gains are relative to `reference`, by default the persistence line.
    """
    (target,) = {fit.target for fit in fits.values()}
    named = {name: replace(fit, prediction=f"_model_{i}") for i, (name, fit) in enumerate(fits.items())}
    columns = {PERSISTENCE: "k", **{name: fit.prediction for name, fit in named.items()}}
    models = fit_all(train, list(named.values()))
    scored = rows.where(F.col(target).isNotNull() & F.col("k").isNotNull())
    for model, fit in zip(models, named.values()):
        scored = score(model, scored, fit.prediction)
    sizes = F.create_map(*[F.lit(x) for name, fit in fits.items() for x in (name, len(fit.features))])
    table = _error_lines(scored, target, columns)
    table = table.agg(F.collect_list(F.struct("*")).alias("lines")).select("lines", F.inline("lines"))  # one row per model
    base = F.filter("lines", lambda x: x["model"] == (reference or PERSISTENCE))[0]
    return table.select(
        "model", F.coalesce(sizes[F.col("model")], F.lit(1)).alias("n_features"), "mae", "rmse", "n_samples",
        (F.try_divide(base["mae"] - F.col("mae"), base["mae"]) * 100).alias("mae_gain_pct"),
        (F.try_divide(base["rmse"] - F.col("rmse"), base["rmse"]) * 100).alias("rmse_gain_pct"),
        (F.col("model") == F.array_min(F.transform(
            F.filter("lines", lambda x: x["model"] != PERSISTENCE), lambda x: F.struct(x["mae"], x["model"])
        ))["model"]).alias("is_best"),
    )


def _fits(sets: Mapping[str, Sequence[str]], fit: Callable[..., Fit], settings: BoostSettings) -> dict[str, Fit]:
    return {name: fit(features, settings=settings) for name, features in sets.items()}


def ablation_calendar(dataset: DataFrame, settings: BoostSettings = HIST_GBT) -> DataFrame:
    train, test = _split(dataset)
    return compare(train, test, _fits(CALENDAR_SETS, hist_gbt_fit, settings))


def ablation_weather(dataset: DataFrame, settings: BoostSettings = HIST_GBT) -> DataFrame:
    train, test = _split(dataset)
    return compare(train, test, _fits(WEATHER_SETS, hist_gbt_fit, settings))


def ablation_road(dataset: DataFrame, settings: BoostSettings = GBT) -> DataFrame:
    train, test = _split(dataset)
    return compare(train, test, _fits(ROAD_SETS, gbt_fit, settings), reference="flow")


def _fixed(dataset: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    at = F.lit(cutoff).cast("timestamp")
    return dataset.where(F.col(TIME) <= at), dataset.where(F.col(TIME) > at)


def ablation_events(dataset: DataFrame, cutoff, settings: BoostSettings = GBT) -> DataFrame:
    """Rows up to the cutoff train, later rows test."""
    train, test = _fixed(dataset, cutoff)
    return compare(train, test, _fits(EVENT_SETS, gbt_fit, settings), reference="flow")


def ablation_all(dataset: DataFrame, cutoff, settings: BoostSettings = GBT) -> DataFrame:
    """Six feature sets on the rows that have both k and target."""
    train, test = _fixed(dataset.where(F.col("k").isNotNull()), cutoff)
    return compare(train, test, _fits(ALL_SETS, gbt_fit, settings), reference="flow")


def model_comparison(
    dataset: DataFrame, hist: BoostSettings = HIST_GBT, boosted: BoostSettings = GBT
) -> DataFrame:
    """Persistence against both learners on the traffic features."""
    train, test = _split(dataset)
    return compare(train, test, {
        "Histogram boosting": hist_gbt_fit(FEATURES_TRAFFIC, settings=hist),
        "Boosted trees": gbt_fit(FEATURES_TRAFFIC, settings=boosted),
    })


def train_report(dataset: DataFrame, settings: BoostSettings = HIST_GBT) -> DataFrame:
    """One model on the weather feature set, with its gain over persistence."""
    train, test = _split(dataset)
    return compare(train, test, {"Histogram boosting": hist_gbt_fit(FEATURES_WEATHER, settings=settings)})
