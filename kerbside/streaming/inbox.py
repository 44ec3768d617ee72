"""Structured Streaming over a bulk inbox folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kerbside.operators.cleaning import normalize_bulk
from kerbside.operators.keyed import merge_traffic, traffic_batch
from kerbside.plans.ingest import bulk_batch
from kerbside.schemas import BULK_EXPORT
from kerbside.sources.tables import SOURCE_ORDER, write_keyed


def read_inbox(
    spark: SparkSession, inbox: str, archive: str | None = None, schema: StructType = BULK_EXPORT,
    max_files: int | None = None,
) -> DataFrame:
    """New Parquet files of a folder as a stream, with file name and row number.

    The checkpoint makes sure that a file is processed once. Moving files to the archive
    is only tidying: Spark moves a file when a later batch commits.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if max_files is not None:
        stream = stream.option("maxFilesPerTrigger", max_files)
    if archive is not None:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return stream.parquet(inbox).select("*", *[F.col(f"_metadata.{c}").alias(c) for c in SOURCE_ORDER])


def stream_dedupe(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """One stored row per (road, time), the last delivered. A keyed write instead of a watermark: a row counts however
    late it comes, and no state is kept between batches."""

    def load(batch: DataFrame, _batch_id: int) -> None:
        if not batch.isEmpty():
            order = [c for c in SOURCE_ORDER if c in batch.columns]
            write_keyed(batch.sparkSession, store, traffic_batch(normalize_bulk(batch, order), order), merge_traffic, newest=True)

    return (
        stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_bulk_inbox(
    spark: SparkSession, inbox: str, roads: DataFrame, store: str, checkpoint: str,
    archive: str | None = None, schema: StructType = BULK_EXPORT, max_files: int | None = None,
) -> StreamingQuery:
    """Process what is in the inbox once and stop. Each micro-batch is a keyed upsert, so
    a batch that runs again after a failure leaves the same store."""

    def load(batch: DataFrame, _batch_id: int) -> None:
        if not batch.isEmpty():
            write_keyed(batch.sparkSession, store, bulk_batch(batch, roads), merge_traffic, newest=True)

    return (
        read_inbox(spark, inbox, archive, schema, max_files)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
