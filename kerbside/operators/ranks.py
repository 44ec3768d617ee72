"""Global positions and first-n-by-time without gathering rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators.offsets import time_bucket
from kerbside.session import shared_folder


def _sorted_parts(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows in range partitions, with the number of their partition and their place in it, checkpointed."""
    shared_folder(df.sparkSession)
    place = F.monotonically_increasing_id()
    return df.orderBy(*order).select(
        "*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")).checkpoint()


#: Value ranges that a round of `values_at` counts for each rank at most.
RANGES = 1024


def values_at(df: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at given places (from 0) of the sorted column, nulls left out, NaN last; without sorting.

    Each round counts the rows in RANGES parts of the range of values that holds a rank, in one pass for all ranks, and goes on in
    the part where the rank lies, from its least to its greatest value, until these are one value. The least and the greatest
    value never share a part, so every round narrows; doubles take a handful. The driver holds RANGES counts per rank.
    """
    value = F.col(column).cast("double")
    rows = df.select(value.alias("v")).where(F.col("v").isNotNull())
    ends = rows.agg(
        F.count(F.lit(1)), F.count_if(F.col("v") == float("-inf")), F.count_if(F.col("v") == float("inf")), F.count_if(F.isnan("v"))).first()
    n, lowest, highest, unordered = ends
    finite = rows.where(~F.isnan("v") & (F.abs("v") < float("inf")))
    found: dict[int, float] = {}
    open_ranks: dict[int, tuple[float, float, int]] = {}
    limits = finite.agg(F.min("v"), F.max("v")).first()
    for rank in set(ranks):
        if not 0 <= rank < n:
            raise IndexError(f"place {rank} of {n} values")
        if rank < lowest:
            found[rank] = float("-inf")
        elif rank >= n - unordered:
            found[rank] = float("nan")
        elif rank >= n - unordered - highest:
            found[rank] = float("inf")
        elif limits[0] == limits[1]:
            found[rank] = limits[0]
        else:
            open_ranks[rank] = (limits[0], limits[1], lowest)
    while open_ranks:
        spans = sorted({(low, high) for low, high, _ in open_ranks.values()})
        part = span = F.lit(None).cast("int")
        for i, (low, high) in enumerate(spans):
            half = 1.0 if high - low < float("inf") else 0.5
            share = (F.col("v") * half - low * half) / (high * half - low * half)
            here = (F.col("v") >= low) & (F.col("v") <= high)
            span, part = F.when(here, i).otherwise(span), F.when(here, F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).cast("int")).otherwise(part)
        counted = finite.select("v", span.alias("span"), part.alias("part")).where("span is not null").groupBy("span", "part").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        counted.sort(key=lambda r: (r["span"], r["part"]))
        for rank, (low, high, below) in list(open_ranks.items()):
            for r in counted:
                if spans[r["span"]] == (low, high):
                    if rank < below + r["n"]:
                        break
                    below += r["n"]
            if r["low"] == r["high"]:
                found[rank] = r["low"]
                del open_ranks[rank]
            else:
                open_ranks[rank] = (r["low"], r["high"], below)
    return found


def global_position(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The `order` columns with `position` (from 0, in sort order) and `total`.

    The rows are sorted by range partitions. Row counts of the partitions give each one
    its start. Partition numbers must be the same in both uses, so the sorted columns
    are checkpointed in the shared folder. `order` must identify a row.
    """
    keys = _sorted_parts(df.select(*order), order)
    # One row per partition of the sort.
    sizes = keys.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_size").over(Window.partitionBy()).alias("total"),
    )
    return keys.join(starts, "_part").select(
        *order, (F.col("_start") + F.col("_row")).alias("position"), "total"
    )


def first_n_by_time(
    df: DataFrame, key: str, time: str, n: int, ties: Sequence[str | Column] = (), bucket_hours: int = 168
) -> DataFrame:
    """The first n rows of each key by time.

    Row counts per key and time bucket show in which bucket a key reaches n rows. Rows meet
    the list of buckets up to that one by (key, bucket), so a key with very many rows is
    spread over many tasks, and later buckets are dropped before any row is ranked.
    """
    bucketed = df.where(F.col(time).isNotNull()).withColumn(
        "_bucket", time_bucket(F.unix_micros(time), bucket_hours)
    )
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        bucketed.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .where(F.col("_before") < n).select(key, "_bucket")
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy(time, *ties))
    return (
        bucketed.join(first, [key, "_bucket"], "left_semi")
        .withColumn("_rank", rank).where(F.col("_rank") <= n)
        .drop("_bucket", "_rank").select(*df.columns)
    )
