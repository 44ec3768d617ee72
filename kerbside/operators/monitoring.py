"""Freshness, coverage and alert metrics; `now` is an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators.serving import latest_predictions
from kerbside.schemas import HORIZONS, KEY, TIME

MAX_AGE_SECONDS = 21600
MIN_COVERAGE = 0.95
# How long a rule is breached before it fires, and how often it is looked at.
HOLD_SECONDS, STEP_SECONDS = 900, 300
STALE, LOW = "stale observations", "low prediction coverage"


def _epoch(time: Column) -> Column:
    return F.unix_micros(time) / 1_000_000


def _age(now: str, time: Column) -> Column:
    return F.greatest(F.lit(0.0), _epoch(F.lit(now).cast("timestamp")) - _epoch(time))


def observation_freshness(obs: DataFrame, now: str) -> DataFrame:
    """Newest observation as epoch seconds and its age, never below 0; no row when empty."""
    newest = obs.agg(F.max(TIME).alias("t")).where(F.col("t").isNotNull())
    return newest.select(
        _epoch(F.col("t")).alias("latest_observation_epoch"),
        _age(now, F.col("t")).alias("observation_age_seconds"),
    )


def _horizons(df: DataFrame, horizons) -> DataFrame:
    return df.select(F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_hours"), "total_roads")


def prediction_coverage(predictions: DataFrame, roads: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Roads with a prediction at the horizon's newest time, as a share of all roads.

    Roads whose own newest observation lags behind lower the share on purpose.
    """
    predicted = (
        latest_predictions(predictions, None, horizons)
        .groupBy("horizon_hours").agg(F.count(F.lit(1)).alias("predicted_roads"))
    )
    total = roads.agg(F.count(KEY).alias("total_roads"))
    found = F.coalesce(F.col("predicted_roads"), F.lit(0))
    return _horizons(total, horizons).join(predicted, "horizon_hours", "left").select(
        "horizon_hours", found.alias("predicted_roads"), "total_roads",
        F.when(F.col("total_roads") > 0, found / F.nullif(F.col("total_roads"), F.lit(0))).otherwise(0.0)
        .alias("coverage_ratio"),
    )


def prediction_age(predictions: DataFrame, now: str, horizons=HORIZONS) -> DataFrame:
    """Newest prediction per horizon as epoch seconds and its age; no row without predictions."""
    newest = (
        predictions.where(F.col("horizon_hours").isin(list(horizons)))
        .groupBy("horizon_hours").agg(F.max("prediction_timestamp_utc").alias("t"))
    )
    return newest.select(
        "horizon_hours", _epoch(F.col("t")).alias("latest_prediction_epoch"),
        _age(now, F.col("t")).alias("prediction_age_seconds"),
    )


def champion_version_metric(predictions: DataFrame, horizons=HORIZONS) -> DataFrame:
    """The newest predictions' model version as a number per horizon, left out when it is
    not one. Among equal times the version of the first road counts."""
    latest = latest_predictions(predictions, None, horizons)
    chosen = F.min_by("model_version", KEY).alias("model_version")
    return (
        latest.groupBy("horizon_hours").agg(chosen)
        .select("horizon_hours", F.col("model_version").try_cast("double").alias("champion_version"))
        .where(F.col("champion_version").isNotNull())
    )


def _evaluated(points: DataFrame, now: str, step_s: int) -> DataFrame:
    """Metric points (series columns, t, ...) at every evaluation time from the first point to now, as they were known then.

    A point counts until the next one of its series; evaluation times are the multiples of `step_s`.
    """
    end = F.unix_micros(F.lit(now).cast("timestamp"))
    after = F.lead("t").over(Window.partitionBy("alert", "horizon_hours").orderBy("t", "n"))
    step = F.lit(step_s * 1_000_000)
    first = F.ceil(F.unix_micros("t") / step) * step
    last = F.least(F.coalesce(F.unix_micros("after") - 1, end), end)
    times = F.when(first <= last, F.sequence(first, last, step))
    laid = points.withColumn("after", after).withColumn("at", F.explode(times))
    return laid.withColumn("evaluated_at", F.timestamp_micros("at")).drop("at", "after")


def alert_evaluations(
    obs: DataFrame, predictions: DataFrame, roads: DataFrame, now: str, step_s: int = STEP_SECONDS, horizons=HORIZONS,
    max_age_s: float = MAX_AGE_SECONDS, min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """alert, horizon_hours, evaluated_at, value, breached for both rules at every evaluation time up to now.

    The age is that of the newest observation by then; the coverage that of the newest predictions by then, and 0 from the first
    observation on until there are any. Only distinct times, and counts per prediction time, are laid out over the evaluation times.
    """
    seen = obs.where(F.col(TIME).isNotNull()).select(
        F.lit(STALE).alias("alert"), F.lit(None).cast("int").alias("horizon_hours"), F.col(TIME).alias("t"),
        F.lit(None).cast("bigint").alias("n")).distinct()
    age = (F.unix_micros("evaluated_at") - F.unix_micros("t")) / 1_000_000
    stale = _evaluated(seen, now, step_s).select("alert", "horizon_hours", "evaluated_at", age.alias("value"), (age > max_age_s).alias("breached"))
    counted = (
        predictions.where(F.col("horizon_hours").isin(list(horizons)))
        .groupBy("horizon_hours", F.col("prediction_timestamp_utc").alias("t")).agg(F.count_distinct(KEY).alias("n"))
        .select(F.lit(LOW).alias("alert"), F.col("horizon_hours").cast("int").alias("horizon_hours"), "t", "n"))
    start = obs.agg(F.min(TIME).alias("t")).where(F.col("t").isNotNull()).select(
        F.lit(LOW).alias("alert"), F.explode(F.array(*(F.lit(h) for h in horizons))).alias("horizon_hours"), "t",
        F.lit(0).cast("bigint").alias("n"))
    counted = counted.unionByName(start)
    total = roads.agg(F.count(KEY).alias("total")).scalar()
    share = F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0))
    low = _evaluated(counted, now, step_s).select(
        "alert", "horizon_hours", "evaluated_at", share.alias("value"), (share < min_coverage).alias("breached"))
    return stale.unionByName(low)


def breach_runs(evaluations: DataFrame, hold_s: int = HOLD_SECONDS, bucket_s: int = 86_400) -> DataFrame:
    """Runs of consecutive breaches per rule and horizon: alert, horizon_hours, started_at, ended_at, fired_at, n_evaluations,
    last_value.

    A rule fires at the first evaluation that comes `hold_s` or more after the run's first; `fired_at` is null for a run that
    ended before. One evaluation without breach ends a run. Runs are found per time bucket, so a long series is many tasks; a run
    that touches a bucket's edge is joined with the one it goes on from, of which a bucket has two at most.
    """
    key = ["alert", "_h", "_b"]
    rows = evaluations.select(
        "alert", "horizon_hours", F.coalesce("horizon_hours", F.lit(-1)).alias("_h"), "evaluated_at", "value", "breached",
        F.floor(F.unix_micros("evaluated_at") / F.lit(bucket_s * 1_000_000)).alias("_b"))
    ordered = Window.partitionBy(*key).orderBy("evaluated_at")
    before = F.lag("breached").over(ordered)
    numbered = rows.select(
        "*", before.isNull().alias("_head"), F.lead("breached").over(ordered).isNull().alias("_tail"),
        F.sum((~F.coalesce(before, F.lit(False))).cast("int")).over(ordered).alias("_n"),
    ).where("breached")
    pieces = numbered.groupBy(*key, "_n").agg(
        F.first("horizon_hours").alias("horizon_hours"), F.min("evaluated_at").alias("_from"), F.max("evaluated_at").alias("_to"),
        F.count(F.lit(1)).alias("_rows"), F.max_by("value", "evaluated_at").alias("_last"), F.bool_or("_head").alias("_head"),
        F.bool_or("_tail").alias("_tail"))
    places = Window.partitionBy("alert", "_h").orderBy("_b")
    buckets = rows.select(*key).distinct().withColumn("_place", F.row_number().over(places))  # one row per series and bucket
    edges = pieces.where("_head or _tail").join(buckets, key)
    chain = Window.partitionBy("alert", "_h").orderBy("_from")
    goes_on = F.lag(F.when(F.col("_tail"), F.col("_place"))).over(chain) + 1 == F.when(F.col("_head"), F.col("_place"))
    chained = edges.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(chain))
    start = F.min("_from").over(Window.partitionBy("alert", "_h", "_run"))
    names = [*key, "_n", "horizon_hours", "_rows", "_last", "_to"]
    known = chained.select(*names, start.alias("started_at")).unionByName(
        pieces.where("not (_head or _tail)").select(*names, F.col("_from").alias("started_at")))
    held = numbered.join(known.select(*key, "_n", "started_at"), [*key, "_n"]).where(
        F.unix_micros("evaluated_at") - F.unix_micros("started_at") >= hold_s * 1_000_000)
    fired = held.groupBy("alert", "_h", "started_at").agg(F.min("evaluated_at").alias("fired_at"))
    runs = known.groupBy("alert", "_h", "started_at").agg(
        F.first("horizon_hours").alias("horizon_hours"), F.max("_to").alias("ended_at"), F.sum("_rows").alias("n_evaluations"),
        F.max_by("_last", "_to").alias("last_value"))
    return runs.join(fired, ["alert", "_h", "started_at"], "left").select(
        "alert", "horizon_hours", "started_at", "ended_at", "fired_at", "n_evaluations", "last_value")


def alerts(evaluations: DataFrame, hold_s: int = HOLD_SECONDS) -> DataFrame:
    """One row per rule and horizon that fires at its newest evaluation, with the value there and since when it is breached."""
    newest = evaluations.groupBy("alert", F.coalesce("horizon_hours", F.lit(-1)).alias("_h")).agg(F.max("evaluated_at").alias("ended_at"))
    runs = breach_runs(evaluations, hold_s).withColumn("_h", F.coalesce("horizon_hours", F.lit(-1)))
    return runs.join(newest, ["alert", "_h", "ended_at"]).where(F.col("fired_at").isNotNull()).select(
        "alert", "horizon_hours", F.col("last_value").alias("value"), F.col("started_at").alias("breached_since"))
