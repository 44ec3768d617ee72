"""Landed API answers: result pages and the weather payload, read as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.values import instant_from_text
from kerbside.schemas import (
    EVENT_RECORD, KEY, ROAD_RECORD, TIME, TRAFFIC_RECORD, WEATHER_PAYLOAD, WEATHER_VARIABLES, page_of,
)


def _pages(spark: SparkSession, path: str, record) -> DataFrame:
    return spark.read.schema(page_of(record)).json(path).select(F.inline("results"))


def traffic_pages(
    spark: SparkSession, path: str, *, where: str | Column | None = None,
    order_by: str | None = None, max_records: int | None = None,
) -> DataFrame:
    """All traffic records; rows without q or k are kept."""
    rows = _pages(spark, path, TRAFFIC_RECORD)
    if where is not None:
        rows = rows.where(where)
    if order_by is not None:
        rows = rows.orderBy(F.expr(order_by.removesuffix(" ASC").removesuffix(" DESC")).desc()
                            if order_by.endswith(" DESC") else F.expr(order_by.removesuffix(" ASC")).asc())
    return rows if max_records is None else rows.limit(max_records)


def road_reference_pages(spark: SparkSession, path: str, road_ids: DataFrame) -> DataFrame:
    """Reference records of the listed roads; repeated ids count once."""
    return _pages(spark, path, ROAD_RECORD).join(road_ids.select(KEY).distinct(), KEY, "left_semi")


def event_pages(spark: SparkSession, path: str) -> DataFrame:
    return _pages(spark, path, EVENT_RECORD)


def weather_payload(spark: SparkSession, path: str) -> DataFrame:
    """Arrays per variable to one row per hour, in UTC."""
    payload = spark.read.schema(WEATHER_PAYLOAD).json(path)
    zipped = F.arrays_zip(*[F.col(f"hourly.{name}") for name in ("time", *WEATHER_VARIABLES)])
    return (
        payload.select(F.inline(zipped))
        .withColumn(TIME, instant_from_text(F.col("time"))).drop("time")
    )
