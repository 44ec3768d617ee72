"""Per-road statistics, eligibility, coverage and data profiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.values import is_digits, strip
from kerbside.operators.ranks import first_n_by_time, global_position, values_at
from kerbside.operators.reference import one_per_road
from kerbside.schemas import KEY, TIME, require_columns

MIN_OBSERVATIONS = 24 * 90
MIN_VALID_RATIO = 0.95
COUNT_THRESHOLDS = (1, 24, 168, 1000, 5000, 9000, 9700)


def _rows() -> Column:
    return F.count(F.lit(1))


def road_statistics(obs: DataFrame) -> DataFrame:
    """Row, q and k counts per road; ids that are not digits are left out before grouping."""
    require_columns(obs, [KEY, "q", "k"])
    return (
        obs.where(is_digits(F.col(KEY).cast("string")))
        .groupBy(F.col(KEY).cast("string").alias(KEY))
        .agg(_rows().alias("n_observations"), F.count("q").alias("n_valid_q"), F.count("k").alias("n_valid_k"))
    )


def candidate_roads(
    stats: DataFrame, min_observations: int = MIN_OBSERVATIONS, min_valid_ratio: float = MIN_VALID_RATIO
) -> DataFrame:
    """Roads with enough rows and enough valid q and k; a road without rows never passes."""
    require_columns(stats, [KEY, "n_observations", "n_valid_q", "n_valid_k"], "road statistics")
    return stats.withColumns({
        "valid_q_ratio": F.try_divide("n_valid_q", "n_observations"),
        "valid_k_ratio": F.try_divide("n_valid_k", "n_observations"),
    }).where(
        (F.col("n_observations") >= min_observations)
        & (F.col("valid_q_ratio") >= min_valid_ratio)
        & (F.col("valid_k_ratio") >= min_valid_ratio)
    )


def stats_reference_join(stats: DataFrame, reference: DataFrame) -> DataFrame:
    fields = [KEY, "latitude", "longitude", "road_length_m", "geo_shape"]
    return stats.join(one_per_road(reference, fields), KEY, "inner")


def eligible_roads(
    stats: DataFrame, reference: DataFrame, *,
    min_observations: int = MIN_OBSERVATIONS, min_valid_ratio: float = MIN_VALID_RATIO,
) -> DataFrame:
    """Candidates that are in the reference with position, length and shape; most rows first."""
    return (
        stats_reference_join(candidate_roads(stats, min_observations, min_valid_ratio), reference)
        .na.drop(subset=["latitude", "longitude", "road_length_m", "geo_shape"])
        .orderBy(F.col("n_observations").desc(), KEY)
    )


def top_roads_by_coverage(obs: DataFrame, n: int = 20, min_coverage: float = 0.90) -> DataFrame:
    """The n numeric ids with most k values among those with enough coverage; every id is looked at."""
    groups = (
        obs.groupBy(KEY)
        .agg(_rows().alias("observations"), F.count("k").alias("k_available"))
    )
    return (
        groups.withColumn(KEY, strip(F.col(KEY))).where(is_digits(F.col(KEY)))
        .withColumn("k_coverage", F.try_divide("k_available", "observations"))
        .where(F.col("k_coverage") >= min_coverage)
        .orderBy(F.col("k_available").desc(), KEY).limit(n)
    )


def observations_per_road(obs: DataFrame) -> DataFrame:
    return obs.groupBy(KEY).agg(_rows().alias("n_observations"))


def coverage_ratio(stats: DataFrame) -> DataFrame:
    """Each road's row count as a share of the largest one."""
    largest = stats.agg(F.max("n_observations").alias("largest"))
    return stats.withColumn("coverage_ratio", F.try_divide(F.col("n_observations"), largest.scalar()))


def threshold_counts(stats: DataFrame, thresholds: Sequence[int] = COUNT_THRESHOLDS) -> DataFrame:
    """How many roads have fewer rows than each threshold, in one pass."""
    lines = F.array(*[
        F.struct(F.lit(t).cast("long").alias("threshold"),
                 F.count_if(F.col("n_observations") < t).alias("n_roads"))
        for t in thresholds
    ])
    return stats.agg(lines.alias("lines")).select(F.inline("lines"))


def smallest_roads(stats: DataFrame, n: int = 20) -> DataFrame:
    return stats.orderBy("n_observations", KEY).limit(n)


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, extremes and linearly interpolated quartiles.

    Quartiles are exact, whatever the number of distinct values: counts in ever narrower ranges of values lead to them.
    """
    c = F.col(column)
    facts = df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
    )
    n = df.agg(F.count(c)).first()[0]
    places = {name: (n - 1) * share for name, share in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))} if n else {}
    held = values_at(df, column, [rank for p in places.values() for rank in (math.floor(p), math.ceil(p))]) if n else {}

    def quartile(name: str) -> Column:
        if not n:
            return F.lit(None).cast("double")
        place = places[name]
        weight = place - math.floor(place)
        low, high = held[math.floor(place)], held[math.ceil(place)]
        return F.lit(low * (1 - weight) + high * weight if weight else low)

    return facts.select("count", "mean", "std", "min", *(quartile(p).alias(p) for p in ("p25", "p50", "p75")), "max")


def distinct_roads(df: DataFrame, approximate: bool = False) -> DataFrame:
    counted = F.approx_count_distinct(KEY) if approximate else F.count_distinct(KEY)
    return df.agg(counted.alias("n_roads"))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, as one row per column."""
    names = list(columns or df.columns)
    lines = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("n_missing")) for c in names
    ])
    return df.agg(lines.alias("lines")).select(F.inline("lines"))


def time_range(df: DataFrame, time: str = TIME) -> DataFrame:
    return df.agg(F.min(time).alias("min_timestamp"), F.max(time).alias("max_timestamp"))


def complete_count(df: DataFrame) -> DataFrame:
    complete = F.col("q").isNotNull() & F.col("k").isNotNull()
    return df.agg(_rows().alias("n_rows"), F.count_if(complete).alias("n_complete"))


def rows_without_match(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every joined column is missing."""
    require_columns(df, columns)
    unmatched = F.lit(True)
    for c in columns:
        unmatched = unmatched & F.col(c).isNull()
    return df.agg(_rows().alias("n_rows"), F.count_if(unmatched).alias("n_without_match"))


def targets_available(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    lines = F.array(*[
        F.struct(F.lit(c).alias("target"), F.count(c).alias("n_available")) for c in columns
    ])
    return df.agg(lines.alias("lines")).select(F.inline("lines"))


def page_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select(KEY).distinct().intersect(second.select(KEY).distinct())


def event_coverage(df: DataFrame, flag: str = "has_event_nearby_target_1h") -> DataFrame:
    return df.agg(_rows().alias("n_rows"), (F.avg(F.col(flag).cast("double")) * 100).alias("event_coverage_pct"))


def excluded_roads(source: DataFrame, dataset: DataFrame) -> DataFrame:
    """Ids of the input that are no longer in the dataset. Both sides shrink to their ids
    before they are compared."""
    ids = [df.select(F.col(KEY).cast("string").alias(KEY)).distinct() for df in (source, dataset)]
    return ids[0].subtract(ids[1])


def capped_per_road(obs: DataFrame, n: int = 8000, bucket_hours: int = 168) -> DataFrame:
    """The first n rows of each road by time."""
    return first_n_by_time(obs, KEY, TIME, n, bucket_hours=bucket_hours)


def systematic_sample(df: DataFrame, target: int = 2000, order: Sequence[str] = (TIME, KEY)) -> DataFrame:
    """Every n-th row in sort order, n = rows // target (at least 1), at most `target` rows.

    `order` must identify a row.
    """
    require_columns(df, order)
    step = F.greatest(F.floor(F.col("total") / target), F.lit(1))
    chosen = global_position(df, order).where(
        (F.col("position") % step == 0) & (F.col("position") < step * target)
    )
    return df.join(chosen.select(*order), list(order), "left_semi")
