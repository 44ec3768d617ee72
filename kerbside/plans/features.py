"""Feature and dataset jobs composed of the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators.cleaning import clean_traffic
from kerbside.operators.features import (
    public_holiday_features, road_features, school_holiday_features, time_features, weather_features,
)
from kerbside.operators.keyed import OBSERVATION_KEY, last_per_key
from kerbside.operators.offsets import exact_offsets, lag_lookups, lags_and_targets, target_lookups, traffic_lags
from kerbside.operators.profiles import excluded_roads
from kerbside.operators.reference import one_per_road
from kerbside.operators.serving import recent_window
from kerbside.schemas import (
    FEATURES_CORE, FEATURES_ROAD, FEATURES_TARGET_WEATHER, FEATURES_WEATHER, HORIZONS, KEY, TIME,
    require_columns, target_column,
)


def build_traffic_features(
    df: DataFrame, weather: DataFrame | None = None, reference: DataFrame | None = None
) -> DataFrame:
    """Calendar, optional weather and road features, lags and the one-hour target.

    Lags and target share one shuffle; the narrow columns go through it and the rest
    is added afterwards.
    """
    rows = exact_offsets(df, {**lag_lookups(), **target_lookups((1,))})
    # The lookups keep every row, so the years of the input are those of the result.
    rows = school_holiday_features(public_holiday_features(time_features(rows), years_of=df))
    if weather is not None:
        rows = weather_features(rows, weather)
    if reference is not None:
        rows = road_features(rows, reference)
    return rows


def build_ml_dataset(df: DataFrame) -> DataFrame:
    """Rows with a target, in the columns of the weather feature set; missing features stay."""
    columns = [KEY, TIME, *FEATURES_WEATHER, *FEATURES_ROAD, "target_k_1h"]
    require_columns(df, columns)
    return df.select(*columns).where(F.col("target_k_1h").isNotNull())


def make_training_dataset(obs: DataFrame, history_hours: int = 24 * 365) -> DataFrame:
    """The recent window, cleaned, with one row per road and time."""
    if history_hours <= 0:
        raise ValueError(f"No history of {history_hours} hours can be taken; it has to be one hour at least.")
    require_columns(obs, [KEY, TIME, "q", "k"])
    rows = clean_traffic(recent_window(obs, history_hours)).na.drop(subset=OBSERVATION_KEY)
    return last_per_key(rows, OBSERVATION_KEY, None)


def _eligible_with_road(obs: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows of referenced roads with the road's columns: road features and the id filter
    use the same reference, so one inner join does both."""
    return clean_traffic(obs).join(one_per_road(reference, [KEY, *FEATURES_ROAD]), KEY, "inner")


def build_training_features(
    obs: DataFrame, reference: DataFrame, horizons: Iterable[int] = HORIZONS
) -> DataFrame:
    """Fourteen features and one target per horizon for every row of a referenced road."""
    horizons = tuple(horizons)
    rows = time_features(lags_and_targets(_eligible_with_road(obs, reference), horizons=horizons))
    require_columns(rows, [*FEATURES_CORE, *map(target_column, horizons)], "training feature")
    return rows


def build_prediction_features(obs: DataFrame, reference: DataFrame, history_hours: int = 48) -> DataFrame:
    """The same features without targets, over the last 48 hours: the 24 h lag needs history."""
    rows = time_features(traffic_lags(_eligible_with_road(recent_window(obs, history_hours), reference)))
    require_columns(rows, FEATURES_CORE, "prediction feature")
    return rows


def multi_road_dataset(obs: DataFrame, weather: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dataset of many roads, and the ids that dropped out of it."""
    dataset = build_ml_dataset(build_traffic_features(clean_traffic(obs), weather, reference))
    return dataset, excluded_roads(obs, dataset)


def multi_road_rows(obs: DataFrame, weather: DataFrame, reference: DataFrame) -> DataFrame:
    """The rows of the dataset of many roads."""
    return multi_road_dataset(obs, weather, reference)[0]


def multi_road_coverage(obs: DataFrame, weather: DataFrame, reference: DataFrame) -> DataFrame:
    """One row per road of the input: its observations, its rows in the dataset, and whether it dropped out of it."""
    sides = [df.select(F.col(KEY).cast("string").alias(KEY), F.lit(own).alias("of_dataset"))
             for own, df in ((False, obs), (True, multi_road_rows(obs, weather, reference)))]
    counts = sides[0].unionByName(sides[1]).groupBy(KEY).agg(
        F.count_if(~F.col("of_dataset")).alias("n_observations"), F.count_if(F.col("of_dataset")).alias("n_rows"))
    return counts.withColumn("dropped", F.col("n_rows") == 0)


REPORT_COLUMNS = [*FEATURES_TARGET_WEATHER, *FEATURES_ROAD, *lag_lookups(), "target_k_1h"]
