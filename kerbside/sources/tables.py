"""Parquet tables: scans, sinks and the keyed store."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.values import hours
from kerbside.operators.cleaning import process_traffic
from kerbside.schemas import KEY, TIME, require_columns
from kerbside.session import run_folder
from kerbside.sources.files import folders, partition_values, read_text, remove, replace_file, write_text

DAY = "day"
# Days of a batch up to which they are listed in a filter.
LISTED_DAYS = 366
# A small table is a folder of versions and a file that names the current one; readers of plain Parquet see neither.
POINTER, VERSION = "_current", "_v-"
# Where a row came from: later files, and later rows of a file, overwrite earlier ones.
SOURCE_ORDER = ["file_name", "row_index"]


def scan_parquet(spark: SparkSession, path: str, required: Iterable[str] = ()) -> DataFrame:
    """A Parquet table; a missing path or column is an error."""
    df = spark.read.parquet(path)
    require_columns(df, required)
    return df


def scan_bulk_parquet(spark: SparkSession, folder: str) -> DataFrame:
    """The four bulk columns of every Parquet file in a folder, with file name and row number."""
    files = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)
    require_columns(files, [KEY, "t_1h", "q", "k"])
    return files.select(KEY, "t_1h", "q", "k", *[F.col(f"_metadata.{c}").alias(c) for c in SOURCE_ORDER])


def sink_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = (), mode: str = "overwrite") -> str:
    """Write a table; with partition columns, files are balanced per partition value."""
    columns = list(partition_by)
    if columns:
        df = df.hint("rebalance", *columns)
    df.write.mode(mode).partitionBy(*columns).option("partitionOverwriteMode", "static").parquet(path)
    return path


def process_traffic_file(spark: SparkSession, source: str, target: str) -> str:
    return sink_parquet(process_traffic(scan_parquet(spark, source)), target)


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table without its partition column, or None before the first write.

    Of a small table this is the version that its pointer names.
    """
    current = read_text(spark, f"{path.rstrip('/')}/{POINTER}")
    if current is not None:
        return spark.read.parquet(f"{path.rstrip('/')}/{current}")
    try:
        return spark.read.parquet(path).drop(DAY)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_recent(spark: SparkSession, path: str, hours_back: int, time: str = TIME) -> DataFrame | None:
    """Stored rows no more than n hours before the newest one, or None before the first write.

    The newest day comes from the folder names, the newest time from that day alone, and only
    the days of the window are read.
    """
    days = partition_values(spark, path, DAY)
    if not days:
        return None
    table = spark.read.parquet(path)
    newest = table.where(F.col(DAY) == F.lit(days[-1]).cast("date")).agg(F.max(time)).first()[0]
    if newest is None:
        return table.drop(DAY)
    since = F.lit(newest) - hours(hours_back)
    return table.where((F.col(DAY) >= F.to_date(since)) & (F.col(time) >= since)).drop(DAY)


def write_keyed(
    spark: SparkSession, path: str, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame],
    time: str = TIME, newest: bool = False,
) -> int:
    """Merge a batch into a store partitioned by UTC day; returns the batch's row count.

    The batch is written aside first, because it is read several times. Only the days
    that occur in it are read and rewritten. Dynamic partition overwrite writes all new
    files aside and swaps whole days on commit, so lost executors only repeat tasks, and
    a repeated batch gives the same table. With `newest` the table of every road's newest
    time beside the store is brought up to date from the batch alone.
    """
    aside = run_folder(spark, "batch")
    try:
        batch.write.parquet(aside)
        written = spark.read.schema(batch.schema).parquet(aside)
        n = _merge_days(spark, path, written, merge, time)
        if newest and n:
            known = read_store(spark, newest_path(path))
            if known is None:  # the store's first write with such a table, or one that began without
                newest_by_road(spark, path)
            else:
                write_small(_newest(known.unionByName(_newest(written, time))), newest_path(path))
        return n
    finally:
        remove(spark, aside)


def newest_path(path: str) -> str:
    return f"{path.rstrip('/')}__newest"


def _newest(rows: DataFrame, time: str = "latest_timestamp") -> DataFrame:
    return rows.groupBy(KEY).agg(F.max(time).alias("latest_timestamp"))


def newest_by_road(spark: SparkSession, path: str) -> DataFrame | None:
    """Every road's newest time from the table beside a store, or None before the first write.

    Where the table is missing it is made from the store, once. It is written after the store's days, so after a lost driver it is
    behind at most: the next incremental run then loads some rows again, which changes nothing.
    """
    known = read_store(spark, newest_path(path))
    if known is None:
        store = read_store(spark, path)
        if store is None:
            return None
        write_small(_newest(store, TIME), newest_path(path))
        known = read_store(spark, newest_path(path))
    return known


def _merge_days(spark, path, batch, merge, time) -> int:
    day = F.to_date(time).alias(DAY)
    # One row per day. A list of days prunes the scan of the store; for a long one its ends do.
    days = batch.groupBy(day).agg(F.count(F.lit(1)).alias("n")).collect()
    if not days:
        return 0
    try:
        known = [d[DAY] for d in days if d[DAY] is not None]
        wanted = F.col(DAY).isin(known) if len(known) <= LISTED_DAYS else F.col(DAY).between(min(known), max(known))
        stored = spark.read.parquet(path).where(wanted)
        if len(known) > LISTED_DAYS:  # days in between that the batch doesn't touch aren't rewritten
            stored = stored.join(batch.select(day).distinct(), DAY, "left_semi")
        stored = stored.drop(DAY)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        stored = spark.createDataFrame([], batch.schema)
    (
        merge(stored, batch).select("*", day).hint("rebalance", DAY)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY).parquet(path)
    )
    return sum(d["n"] for d in days)


def write_small(df: DataFrame, path: str) -> None:
    """Replace a small table. The new rows, which may come from the old ones, become a version of their own; then one rename of the
    pointer file switches to it, so a driver lost on the way leaves the old table. The version before stays for its readers."""
    spark, path = df.sparkSession, path.rstrip("/")
    before = read_text(spark, f"{path}/{POINTER}")
    version = f"{VERSION}{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    write_text(spark, f"{path}/{POINTER}-{version}", version)
    replace_file(spark, f"{path}/{POINTER}-{version}", f"{path}/{POINTER}")
    for old in folders(spark, path, VERSION):
        if old not in (version, before):
            remove(spark, f"{path}/{old}")
