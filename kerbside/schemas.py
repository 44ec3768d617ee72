"""Table schemas, feature lists and the column check used by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEY = "iu_ac"
TIME = "timestamp_utc"
HORIZONS = (1, 2, 3)
LAGS = (1, 2, 24)

# Feature names and their order are part of the model contract.
FEATURES_CORE = [
    "q", "k",
    "hour", "day_of_week", "is_weekend",
    "q_lag_1h", "k_lag_1h", "q_lag_2h", "k_lag_2h", "q_lag_24h", "k_lag_24h",
    "latitude", "longitude", "road_length_m",
]
FEATURES_TRAFFIC = FEATURES_CORE[:11]
FEATURES_ROAD = FEATURES_CORE[11:]
WEATHER_VARIABLES = [
    "temperature_2m", "relative_humidity_2m", "precipitation",
    "rain", "wind_speed_10m", "weather_code",
]
FEATURES_TARGET_WEATHER = [f"{name}_target_1h" for name in WEATHER_VARIABLES]
FEATURES_WEATHER = FEATURES_TRAFFIC + FEATURES_TARGET_WEATHER
FEATURES_HOLIDAY = [
    "is_public_holiday", "is_day_before_public_holiday", "is_day_after_public_holiday",
]
FEATURES_CALENDAR = [*FEATURES_HOLIDAY, "is_school_holiday"]
FEATURES_EVENT = ["event_count_nearby_target_1h", "has_event_nearby_target_1h"]


def target_column(horizon: int) -> str:
    return f"target_k_{horizon}h"


POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
GEO_FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ])),
])


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_text, _number, _time = T.StringType(), T.DoubleType(), T.TimestampType()

TRAFFIC_RECORD = _struct(
    ("iu_ac", _text), ("libelle", _text), ("t_1h", _text), ("q", _number), ("k", _number),
    ("etat_trafic", _text), ("etat_barre", _text), ("iu_nd_amont", _text), ("iu_nd_aval", _text),
    ("date_debut", _text), ("date_fin", _text), ("geo_point_2d", POINT), ("geo_shape", GEO_FEATURE),
)
ROAD_RECORD = _struct(
    ("iu_ac", _text), ("libelle", _text), ("date_debut", _text), ("date_fin", _text),
    ("iu_nd_amont", _text), ("iu_nd_aval", _text), ("geo_point_2d", POINT), ("geo_shape", GEO_FEATURE),
)
EVENT_RECORD = _struct(
    ("event_id", _text), ("title", _text), ("date_start", _text), ("date_end", _text),
    ("occurrences", _text), ("lat_lon", POINT),
)
WEATHER_PAYLOAD = _struct(("hourly", T.StructType(
    [T.StructField("time", T.ArrayType(_text))]
    + [T.StructField(name, T.ArrayType(_number)) for name in WEATHER_VARIABLES[:-1]]
    + [T.StructField("weather_code", T.ArrayType(T.IntegerType()))]
)))
BULK_EXPORT = _struct(("iu_ac", _text), ("t_1h", _text), ("q", _number), ("k", _number))
OBSERVATIONS = _struct((KEY, _text), (TIME, _time), ("q", _number), ("k", _number))
ROAD_SEGMENTS = _struct(
    (KEY, _text), ("libelle", _text), ("latitude", _number), ("longitude", _number),
    ("road_length_m", _number), ("geo_shape", _text),
)
PREDICTIONS = _struct(
    (KEY, _text), ("prediction_timestamp_utc", _time), ("target_timestamp_utc", _time),
    ("horizon_hours", T.IntegerType()), ("predicted_k", _number), ("model_version", _text),
)
MODEL_VERSIONS = _struct(
    ("model_name", _text), ("horizon_hours", T.IntegerType()), ("version", T.IntegerType()),
    ("run_id", _text), ("alias", _text), ("status", _text), ("started_at", _time),
    ("mae", _number), ("rmse", _number), ("train_rows", T.LongType()), ("test_rows", T.LongType()),
    ("dataset_rows", T.LongType()), ("dataset_min_timestamp", _time), ("dataset_max_timestamp", _time),
    ("features", T.ArrayType(_text)),
)


def page_of(record: T.StructType) -> T.StructType:
    """The envelope of one landed result page."""
    return _struct(("total_count", T.LongType()), ("results", T.ArrayType(record)))


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing {what} columns: {missing}")
