"""Ingestion jobs: fetch results landed as files, normalise, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.cleaning import bulk_columns, filter_eligible_ids, normalize_bulk, normalize_traffic
from kerbside.operators.incremental import bootstrap_window
from kerbside.operators.keyed import merge_traffic, sync_roads, traffic_batch, upsert_roads
from kerbside.operators.occurrences import normalize_events
from kerbside.operators.reference import all_road_ids, sync_reference_projection
from kerbside.schemas import KEY, TIME
from kerbside.session import run_folder
from kerbside.sources.files import remove
from kerbside.sources.landed import event_pages, traffic_pages, weather_payload
from kerbside.sources.tables import (
    SOURCE_ORDER, newest_by_road, read_store, scan_bulk_parquet, scan_parquet, sink_parquet, write_keyed, write_small,
)


def ingest_traffic(spark: SparkSession, landed: str, target: str, **selection) -> str:
    return sink_parquet(normalize_traffic(traffic_pages(spark, landed, **selection)), target)


def ingest_weather(spark: SparkSession, landed: str, target: str) -> str:
    return sink_parquet(weather_payload(spark, landed), target)


def ingest_events(spark: SparkSession, landed: str, target: str) -> str:
    return sink_parquet(normalize_events(event_pages(spark, landed)), target)


def load_traffic_table(spark: SparkSession, source: str, store: str) -> int:
    """A cleaned Parquet table into the observation store; returns the row count. Of rows with the same key the last by
    file and row number stays, also one with nulls."""
    rows = scan_parquet(spark, source).select("*", *[F.col(f"_metadata.{c}").alias(c) for c in SOURCE_ORDER])
    return write_keyed(spark, store, traffic_batch(rows, SOURCE_ORDER), merge_traffic, newest=True)


def sync_road_store(spark: SparkSession, reference: DataFrame, store: str) -> None:
    """Make the stored segments those of the reference; an empty reference changes nothing."""
    segments = sync_reference_projection(reference)
    stored = read_store(spark, store)
    write_small(segments if stored is None else sync_roads(stored, segments), store)


def upsert_road_store(spark: SparkSession, segments: DataFrame, store: str) -> None:
    stored = read_store(spark, store)
    write_small(segments if stored is None else upsert_roads(stored, segments), store)


def bulk_batch(bulk: DataFrame, roads: DataFrame) -> DataFrame:
    """Bulk rows of eligible roads in store shape. Of rows with the same key the last in
    source order stays, where the rows carry their source."""
    order = [c for c in SOURCE_ORDER if c in bulk.columns]
    return traffic_batch(filter_eligible_ids(normalize_bulk(bulk, order), roads), order)


def import_ledger(bulk: DataFrame, roads: DataFrame) -> DataFrame:
    """One row per file, eligible road and time of a bulk scan: how many rows it stands for, and the last one's q and k.

    A file's rows of other roads, and those without road or time, are one row without a key.
    """
    known = roads.select(KEY).distinct().withColumn("_known", F.lit(True))
    rows = bulk_columns(bulk, SOURCE_ORDER).join(known, KEY, "left")
    wanted = F.col("_known") & F.col(TIME).isNotNull()
    last = F.max_by(F.struct("row_index", "q", "k"), "row_index")
    return rows.groupBy("file_name", F.when(wanted, F.col(KEY)).alias(KEY), F.when(wanted, F.col(TIME)).alias(TIME)).agg(
        F.count(F.lit(1)).alias("n_rows"), last.alias("last")).select("file_name", KEY, TIME, "n_rows", "last.*")


def ledger_counts(ledger: DataFrame) -> DataFrame:
    """Source, eligible and upserted rows per file with a total line (file_name null); a file upserts one row per road and time."""
    has_key = F.col(KEY).isNotNull()
    return ledger.rollup("file_name").agg(
        F.sum("n_rows").alias("source_rows"), F.coalesce(F.sum(F.when(has_key, F.col("n_rows"))), F.lit(0)).alias("eligible_rows"),
        F.count_if(has_key).alias("upserted_rows"))


def bulk_import_counts(spark: SparkSession, folder: str, roads: DataFrame, store: str) -> DataFrame:
    """Import all bulk files into the observation store; returns what the import read and wrote, per file and in all.

    The files are scanned once. The ledger of that scan is written aside; both the counts and the batch come from it.
    """
    if roads.isEmpty():
        raise RuntimeError("There are no roads to import for; the road reference has to be synced first.")
    aside, counted = run_folder(spark, "import"), run_folder(spark, "import-counts")
    try:
        made = import_ledger(scan_bulk_parquet(spark, folder), roads)
        made.write.parquet(aside)
        ledger = spark.read.schema(made.schema).parquet(aside)
        ledger_counts(ledger).write.parquet(counted)
        write_keyed(spark, store, traffic_batch(ledger.where(F.col(KEY).isNotNull()), SOURCE_ORDER), merge_traffic, newest=True)
    finally:
        remove(spark, aside)
    return spark.read.parquet(counted)


def bulk_import(spark: SparkSession, folder: str, roads: DataFrame, store: str) -> int:
    """All bulk files into the observation store; running it again changes nothing. Returns the rows of the total line."""
    return bulk_import_counts(spark, folder, roads, store).where("file_name is null").first()["upserted_rows"]


def incremental_rows(
    arrivals: DataFrame, newest: DataFrame, roads: DataFrame, now: str, bootstrap_hours: int = 72
) -> DataFrame:
    """The rows of landed arrivals that an incremental run loads; `newest` has every known road's newest time."""
    cursor = roads.select(KEY).distinct().join(newest, KEY, "left")
    return bootstrap_window(arrivals, cursor, now, bootstrap_hours)


def incremental_ingest(
    spark: SparkSession, arrivals: DataFrame, segments: DataFrame, store: str, now: str, bootstrap_hours: int = 72
) -> int:
    """Cursors, newer rows, upsert; returns the number of rows loaded. Of arrivals with the same key the last by
    SOURCE_ORDER stays, where they carry these columns. Of the stored history only the days of the new rows are read."""
    newest = newest_by_road(spark, store)
    if newest is None:
        newest = spark.createDataFrame([], f"{KEY} string, latest_timestamp timestamp")
    rows = incremental_rows(arrivals, newest, all_road_ids(segments), now, bootstrap_hours)
    batch = traffic_batch(rows, [c for c in SOURCE_ORDER if c in rows.columns])
    return write_keyed(spark, store, batch, merge_traffic, newest=True)
