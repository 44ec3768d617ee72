"""Time splits, error metrics and the promotion gate."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.schemas import HORIZONS, TIME, require_columns, target_column


def split_cutoff(df: DataFrame, test_size: float = 0.2, time: str = TIME) -> DataFrame:
    """One row with `cutoff`: the distinct time at index int(n * (1 - test_size)), held in 1..n-1.

    Distinct times are counted per day first, so only the day that holds the cutoff
    is ranked.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1.")
    require_columns(df, [time])
    times = df.where(F.col(time).isNotNull()).select(F.col(time).alias("cutoff")).distinct().withColumn(
        "_day", F.date_trunc("day", F.col("cutoff"))
    )
    # One row per day from here on.
    days = times.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(Window.partitionBy())
    index = F.least(F.greatest((total.cast("double") * F.lit(1 - test_size)).cast("long"), F.lit(1)), total - 1)
    located = days.select(
        "_day", "_n", total.alias("_total"), index.alias("_index"),
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
    ).where((F.col("_before") <= F.col("_index")) & (F.col("_index") < F.col("_before") + F.col("_n")))
    rank = F.row_number().over(Window.partitionBy("_day").orderBy("cutoff"))
    found = (
        times.join(located, "_day").withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("_index") - F.col("_before") + 1)
    )
    return found.agg(
        F.when(F.coalesce(F.max("_total"), F.lit(0)) >= 2, F.max("cutoff"))
        .otherwise(F.raise_error(F.lit("At least 2 distinct timestamps are required.")).cast("timestamp"))
        .alias("cutoff")
    )


def temporal_split(df: DataFrame, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train rows before the cutoff, test rows from the cutoff on; no time is in both."""
    cutoff = split_cutoff(df, test_size).scalar()
    return df.where(F.col(TIME) < cutoff), df.where(F.col(TIME) >= cutoff)


def fixed_cutoff_split(df: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Train rows up to and including the cutoff, test rows after it."""
    at = F.lit(cutoff).cast("timestamp")
    return df.where(F.col(TIME) <= at), df.where(F.col(TIME) > at)


def _metrics(actual: Column, predicted: Column, at_least_one: bool) -> list[Column]:
    n = F.count(actual - predicted)
    mae, rmse = F.avg(F.abs(actual - predicted)), F.sqrt(F.avg(F.pow(actual - predicted, 2.0)))
    if at_least_one:
        empty = F.raise_error(F.lit("Cannot evaluate empty predictions."))
        mae = F.when(n > 0, mae).otherwise(empty.cast("double"))
    return [mae.alias("mae"), rmse.alias("rmse"), n.alias("n_samples")]


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE and row count over rows with both values; an error when there are none."""
    require_columns(df, [actual, predicted, *by])
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    metrics = _metrics(F.col(actual), F.col(predicted), at_least_one=not by)
    return rows.groupBy(*by).agg(*metrics)


def persistence_baseline(test: DataFrame, horizons: Iterable[int] = (1,)) -> DataFrame:
    """Errors of predicting that k stays as it is, per horizon, in one pass."""
    horizons = tuple(horizons)
    require_columns(test, ["k", *map(target_column, horizons)])
    lines = [
        F.struct(F.lit(h).alias("horizon_hours"), *_metrics(F.col(target_column(h)), F.col("k"), True))
        for h in horizons
    ]
    return test.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def evaluation_rows(df: DataFrame, horizon_hours: int, test_size: float = 0.2) -> DataFrame:
    """Test rows with target and k: the rows on which all models of a horizon are compared."""
    _, test = temporal_split(df, test_size)
    return test.na.drop(subset=[target_column(horizon_hours), "k"])


def improvement(reference: Column, candidate: Column) -> Column:
    """Gain in percent of a metric for which lower is better."""
    at_zero = F.when(candidate == 0, F.lit(0.0)).otherwise(F.lit(float("-inf")))
    return F.when(reference == 0, at_zero).otherwise((reference - candidate) / reference * 100)


def improvement_pct(df: DataFrame, reference: str, candidate: str, out: str = "improvement_pct") -> DataFrame:
    return df.withColumn(out, improvement(F.col(reference), F.col(candidate)))


def quality_gate(
    aliases: DataFrame, scores: DataFrame, baseline: DataFrame, metric: str = "mae",
    min_improvement_pct: float = 0.0, min_baseline_improvement_pct: float = 0.0,
) -> DataFrame:
    """Decide for each candidate whether it becomes champion.

    aliases: model_name, horizon_hours, candidate_version, champion_version (or null);
    scores: model_name, version, mae, rmse on the shared evaluation rows;
    baseline: horizon_hours, mae, rmse, n_samples of persistence on the same rows.
    The baseline is tested first, then whether there is a champion, whether it is the
    same version, and last the gain over it.
    """
    if metric not in ("mae", "rmse"):
        raise ValueError("metric must be either 'mae' or 'rmse'")

    def scored(version: str, prefix: str) -> DataFrame:
        return scores.select(
            "model_name", F.col("version").alias(version),
            F.col("mae").alias(f"{prefix}_mae"), F.col("rmse").alias(f"{prefix}_rmse"),
        )

    base = baseline.select(
        "horizon_hours", F.col("mae").alias("baseline_mae"), F.col("rmse").alias("baseline_rmse"),
        F.col("n_samples").alias("evaluation_rows"),
    )
    rows = (
        aliases.join(base, "horizon_hours")
        .join(scored("candidate_version", "candidate"), ["model_name", "candidate_version"])
        .join(scored("champion_version", "champion"), ["model_name", "champion_version"], "left")
    )
    vs_base = improvement(F.col(f"baseline_{metric}"), F.col(f"candidate_{metric}"))
    vs_champion = improvement(F.col(f"champion_{metric}"), F.col(f"candidate_{metric}"))

    def reaches(gain: Column, margin: float) -> Column:
        return ~F.isnan(gain) & (gain >= margin)

    reason = (
        F.when(~reaches(vs_base, min_baseline_improvement_pct), "baseline_gate_failed")
        .when(F.col("champion_version").isNull(), "initial_champion")
        .when(F.col("candidate_version") == F.col("champion_version"), "candidate_already_champion")
        .when(reaches(vs_champion, min_improvement_pct), "quality_gate_passed")
        .otherwise("champion_gate_failed")
    )
    decided = rows.withColumns({"reason": reason, "vs_base": vs_base, "vs_champion": vs_champion})
    promoted = F.col("reason").isin("initial_champion", "quality_gate_passed")
    compared = F.col("reason").isin("quality_gate_passed", "champion_gate_failed")
    same = F.col("reason") == "candidate_already_champion"

    def champion_score(name: str) -> Column:
        return F.when(same, F.col(f"candidate_{name}")).when(compared, F.col(f"champion_{name}"))

    return decided.select(
        "horizon_hours", "model_name", promoted.alias("promoted"), "reason", "candidate_version",
        F.when(promoted, F.col("candidate_version"))
        .when(F.col("reason") != "baseline_gate_failed", F.col("champion_version")).alias("champion_version"),
        F.lit(metric).alias("metric"),
        "baseline_mae", "baseline_rmse", "candidate_mae", "candidate_rmse",
        champion_score("mae").alias("champion_mae"), champion_score("rmse").alias("champion_rmse"),
        F.col("vs_base").alias("baseline_improvement_pct"),
        F.when(same, F.lit(0.0)).when(compared, F.col("vs_champion")).alias("champion_improvement_pct"),
        "evaluation_rows",
    )


def promote_all(
    aliases: DataFrame, scores: DataFrame, baseline: DataFrame, horizons: Iterable[int] = HORIZONS, **gate
) -> DataFrame:
    """The gate for every horizon in one job, with a status column for the summary."""
    wanted = aliases.where(F.col("horizon_hours").isin(list(horizons)))
    return quality_gate(wanted, scores, baseline, **gate).withColumn(
        "status", F.when(F.col("promoted"), "PROMOTED").otherwise("NOT PROMOTED")
    )


def newest_version_of_run(model_versions: DataFrame, run_id: str | None = None) -> DataFrame:
    """The highest version per model and run."""
    rows = model_versions if run_id is None else model_versions.where(F.col("run_id") == run_id)
    return rows.groupBy("model_name", "run_id").agg(F.max("version").alias("version"))


def version_with_alias(aliases: DataFrame, alias: str) -> DataFrame:
    """The version that an alias names now, per model; the newest assignment counts."""
    return (
        aliases.where(F.col("alias") == alias)
        .groupBy("model_name", "horizon_hours").agg(F.max_by("version", "assigned_at").alias("version"))
    )


def model_version_lookup(model_versions: DataFrame, alias: str) -> DataFrame:
    """The newest version per model that carries an alias."""
    return (
        model_versions.where(F.col("alias") == alias)
        .groupBy("model_name", "horizon_hours")
        .agg(F.max("version").alias("version"), F.max_by("run_id", "version").alias("run_id"))
    )


def last_training_timestamp(model_versions: DataFrame) -> DataFrame:
    """Newest time in the data of the latest finished +1h run that recorded one."""
    recorded = (F.col("horizon_hours") == 1) & (F.col("status") == "FINISHED") & F.col("dataset_max_timestamp").isNotNull()
    return model_versions.where(recorded).agg(
        F.max_by("dataset_max_timestamp", F.struct("started_at", "run_id")).alias("last_trained"))
