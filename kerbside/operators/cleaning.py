"""Row-wise normalisation, flags and filters of traffic records; no row is removed
unless the operator's name says so, and nothing here shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.values import is_digits, json_text, strip, to_instant, to_number, to_paris
from kerbside.schemas import KEY, TIME, require_columns


def _set(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns) if columns else df


def normalize_traffic(df: DataFrame) -> DataFrame:
    """Structural normalisation of landed records; nested geometry becomes JSON text,
    geometry of any other kind becomes null."""
    out: dict[str, Column] = {}
    if "t_1h" in df.columns:
        out[TIME] = to_instant(df, "t_1h")
    if KEY in df.columns:
        out[KEY] = F.col(KEY).cast("string")
    out |= {c: to_number(df, c) for c in ("q", "k") if c in df.columns}
    out |= {c: json_text(df, c, keep_text=False) for c in ("geo_point_2d", "geo_shape") if c in df.columns}
    return _set(df, out)


def clean_traffic(df: DataFrame) -> DataFrame:
    """Trimmed ids, numbers, UTC and Paris time, dates; columns are optional, rows are kept."""
    out: dict[str, Column] = {
        c: strip(F.col(c).cast("string")) for c in (KEY, "iu_nd_amont", "iu_nd_aval") if c in df.columns
    }
    out |= {c: to_number(df, c) for c in ("q", "k") if c in df.columns}
    source = TIME if TIME in df.columns else "t_1h"
    if source in df.columns:
        instant = to_instant(df, source)
        out |= {TIME: instant, "timestamp_paris": to_paris(instant)}
    out |= {c: to_instant(df, c) for c in ("date_debut", "date_fin") if c in df.columns}
    out |= {c: json_text(df, c, keep_text=True) for c in ("geo_point_2d", "geo_shape") if c in df.columns}
    return _set(df, out)


def normalize_json_text(df: DataFrame, name: str) -> DataFrame:
    """Text stays, nested values become JSON text, any other kind becomes null."""
    return df.withColumn(name, json_text(df, name, keep_text=True))


def utc_to_local(df: DataFrame, time: str = TIME, out: str = "timestamp_paris") -> DataFrame:
    return df.withColumn(out, to_paris(F.col(time)))


def normalize_utc(df: DataFrame, time: str = TIME) -> DataFrame:
    """Naive time is UTC; time with a zone is converted to UTC."""
    return df.withColumn(time, to_instant(df, time))


def quality_flags(df: DataFrame) -> DataFrame:
    """Six data-quality flags; a missing state is neither invalid nor unknown."""
    require_columns(df, [KEY, TIME, "q", "k", "etat_trafic", "etat_barre"], "traffic")
    return df.withColumns({
        "is_valid_iu_ac": is_digits(F.col(KEY).cast("string")),
        "has_q": F.col("q").isNotNull(),
        "has_k": F.col("k").isNotNull(),
        "has_complete_measurement": F.col("q").isNotNull() & F.col("k").isNotNull(),
        "is_invalid_road_state": F.col("etat_barre").eqNullSafe("Invalide"),
        "is_unknown_traffic_state": F.col("etat_trafic").eqNullSafe("Inconnu"),
    })


def quality_counts(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("is_valid_iu_ac")).alias("n_invalid_iu_ac"),
        F.count_if(~F.col("has_k")).alias("n_missing_k"),
        F.count_if(~F.col("has_q")).alias("n_missing_q"),
        F.count_if("has_complete_measurement").alias("n_complete"),
    )


def process_traffic(df: DataFrame) -> DataFrame:
    return quality_flags(clean_traffic(df))


def normalize_bulk(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The four store columns of a bulk export, and any columns to `keep`; rows without id
    or time are dropped."""
    return bulk_columns(df, keep).na.drop(subset=[KEY, TIME])


def bulk_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    require_columns(df, [KEY, "t_1h", "q", "k"])
    return df.select(
        F.col(KEY).cast("string").alias(KEY),
        to_instant(df, "t_1h").alias(TIME),
        to_number(df, "q").alias("q"),
        to_number(df, "k").alias("k"),
        *keep,
    )


def filter_eligible_ids(df: DataFrame, roads: DataFrame) -> DataFrame:
    """Rows of the given roads. Spark broadcasts the id list only while it is small."""
    return df.join(roads.select(KEY).distinct(), KEY, "left_semi")


def dedupe_keep_last(df: DataFrame, ordinal: str) -> DataFrame:
    """One row per (road, time), the last by source order; rows without a key are dropped."""
    last = Window.partitionBy(KEY, TIME).orderBy(F.col(ordinal).desc_nulls_last())
    return (
        df.na.drop(subset=[KEY, TIME])
        .withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")
    )


def filter_complete(df: DataFrame) -> DataFrame:
    return df.where(F.col("q").isNotNull() & F.col("k").isNotNull())


def filter_road(df: DataFrame, road: str, limit: int | None = None) -> DataFrame:
    """Complete rows of one road, newest first; all of them unless a limit is asked for."""
    rows = filter_complete(df.where(F.col(KEY) == road)).orderBy(F.col(TIME).desc())
    return rows if limit is None else rows.limit(limit)


def distinct_ids(df: DataFrame) -> DataFrame:
    return df.select(F.col(KEY).cast("string").alias(KEY)).where(F.col(KEY).isNotNull()).distinct()


def incomplete_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("q").isNull() | F.col("k").isNull())


def congested_rows(df: DataFrame, min_k: float = 15) -> DataFrame:
    """Rows at or above an occupancy, in order of local time."""
    return df.where(F.col("k") >= min_k).orderBy("timestamp_paris", KEY)


def congestion_class(df: DataFrame) -> DataFrame:
    """Occupancy bands; the band edges are fixed values."""
    band = (
        F.when(F.col("k") < 15, "fluid")
        .when(F.col("k") < 30, "pre-saturated")
        .when(F.col("k") < 50, "saturated")
        .when(F.col("k") >= 50, "blocked")
    )
    return df.withColumn("congestion", band)


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
