"""Road reference: versions, coordinates and segment length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.geo import geo_feature, linestring_length_m
from kerbside.functions.values import json_text, to_instant
from kerbside.schemas import KEY, require_columns

SEGMENT_COLUMNS = [KEY, "libelle", "latitude", "longitude", "road_length_m", "geo_shape"]


def _first_per_road(df: DataFrame, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_version_per_road(df: DataFrame) -> DataFrame:
    """The newest version of each road. A missing start date counts as newest, because
    missing dates sort last and the last version is kept. Equal dates are settled by
    the end date and the name."""
    order = [F.col("date_debut").desc_nulls_first()]
    order += [F.col(c).desc_nulls_first() for c in ("date_fin", "libelle") if c in df.columns]
    return _first_per_road(df, *order)


def linestring_length(df: DataFrame, shape: str = "geo_shape", out: str = "road_length_m") -> DataFrame:
    """Length in metres of each line; null unless it is a LineString of two points or more."""
    return df.withColumn(out, linestring_length_m(geo_feature(df, shape)))


def normalize_road_reference(df: DataFrame) -> DataFrame:
    require_columns(df, [KEY, "date_debut", "date_fin", "geo_point_2d", "geo_shape"], "road reference")
    dated = df.withColumns({
        KEY: F.col(KEY).cast("string"),
        "date_debut": to_instant(df, "date_debut"),
        "date_fin": to_instant(df, "date_fin"),
    })
    newest = latest_version_per_road(dated)
    return newest.withColumns({
        "longitude": F.col("geo_point_2d")["lon"].cast("double"),
        "latitude": F.col("geo_point_2d")["lat"].cast("double"),
        "road_length_m": linestring_length_m(geo_feature(newest, "geo_shape")),
    }).withColumns({
        "geo_point_2d": json_text(newest, "geo_point_2d", keep_text=False),
        "geo_shape": json_text(newest, "geo_shape", keep_text=False),
    })


def one_per_road(df: DataFrame, columns: list[str]) -> DataFrame:
    """A projection with a single row per road; the smallest row wins."""
    require_columns(df, columns, "road reference")
    return _first_per_road(
        df.select(F.col(KEY).cast("string").alias(KEY), *[c for c in columns if c != KEY]),
        *[F.col(c).asc_nulls_last() for c in columns if c != KEY],
    )


def sync_reference_projection(df: DataFrame) -> DataFrame:
    return one_per_road(df, SEGMENT_COLUMNS)


def reference_for_eligible(reference: DataFrame, eligible: DataFrame) -> DataFrame:
    return reference.join(eligible.select(KEY).distinct(), KEY, "left_semi")


def roads_not_in_reference(segments: DataFrame, eligible: DataFrame) -> DataFrame:
    return segments.join(eligible.select(KEY), KEY, "left_anti")


def missing_road_ids(requested: DataFrame, found: DataFrame) -> DataFrame:
    return requested.select(KEY).distinct().join(found.select(KEY).distinct(), KEY, "left_anti")


def versions_per_road(df: DataFrame) -> DataFrame:
    return df.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_versions"))


def list_roads(segments: DataFrame) -> DataFrame:
    return segments.select(*SEGMENT_COLUMNS).orderBy(KEY)


def all_road_ids(segments: DataFrame) -> DataFrame:
    return segments.select(KEY).orderBy(KEY)
