"""Exact-time lookups along a road: lags, targets and the previous observation.

Every lookup goes by time, never by row position, so a missing hour gives null.
Windows are cut into time buckets per road, which keeps a road with a large
share of all rows from landing in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.schemas import HORIZONS, KEY, LAGS, TIME, require_columns, target_column

HOUR_US = 3_600_000_000
BUCKET_HOURS = 336
NULL_TIME_SALTS = 4096


def time_bucket(us: Column, bucket_hours: int) -> Column:
    """Number of the bucket that holds a time given in microseconds."""
    size = bucket_hours * HOUR_US
    return ((us - F.pmod(us, F.lit(size))) / size).cast("long")


def null_time_salt(df: DataFrame) -> Column:
    """A bucket number far from all others for rows without a time, which no lookup needs
    to find: it only has to spread them."""
    return F.pmod(F.xxhash64(*df.columns), F.lit(NULL_TIME_SALTS)) - (1 << 40)


def join_per_road(rows: DataFrame, per_road: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """Rows with the columns of their road, from a table of one row per road; other roads' rows go.

    The table is first spread over the buckets that each road has rows in, so the join goes by
    road and bucket, and a road with a large share of all rows is met by many tasks.
    """
    bucket = F.coalesce(time_bucket(F.unix_micros(time), BUCKET_HOURS), null_time_salt(rows))
    placed = rows.withColumn("_bucket", bucket)
    spread = placed.select(key, "_bucket").distinct().join(per_road, key)
    return placed.join(spread, [key, "_bucket"]).drop("_bucket")


def exact_offsets(
    df: DataFrame,
    lookups: Mapping[str, tuple[str, int]],
    key: str = KEY,
    time: str = TIME,
    bucket_hours: int = BUCKET_HOURS,
) -> DataFrame:
    """Add one column per lookup: the value of a column exactly n hours away.

    `lookups` maps the new name to (source column, hours); negative hours look
    back. All lookups share one shuffle: a row goes to its own bucket, and near a
    bucket's edge also to the neighbour that needs it. A repeated (key, time) is an
    error, found in the same pass. Rows without a time keep null lookups.
    """
    require_columns(df, {key, time, *(source for source, _ in lookups.values())})
    back = max([-h for _, h in lookups.values() if h < 0], default=0)
    ahead = max([h for _, h in lookups.values() if h > 0], default=0)
    bucket_hours = max(bucket_hours, back, ahead, 1)
    size = bucket_hours * HOUR_US

    us = F.unix_micros(time)
    own = time_bucket(us, bucket_hours)
    within = F.pmod(us, F.lit(size))
    salt = null_time_salt(df)
    visits = F.array(
        F.coalesce(own, salt),
        F.when(within >= size - back * HOUR_US, own + 1) if back else F.lit(None).cast("long"),
        F.when(within < ahead * HOUR_US, own - 1) if ahead else F.lit(None).cast("long"),
    )
    spread = df.select("*", us.alias("_us"), F.coalesce(own, salt).alias("_own"),
                       F.explode(F.array_compact(visits)).alias("_bucket"))
    # Partition by road and bucket even where the input is already partitioned by road.
    spread = spread.repartition(F.col(key), F.col("_bucket"))

    line = Window.partitionBy(key, "_bucket").orderBy("_us")

    def at(shift: int) -> Window:
        return line.rangeBetween(shift * HOUR_US, shift * HOUR_US)

    known = F.col("_us").isNotNull()
    # The key check reads a window column in the filter, so it cannot be pruned away.
    found = spread.select(
        "*",
        *[F.when(known, F.max(source).over(at(shift))).alias(name)
          for name, (source, shift) in lookups.items()],
        F.count(F.lit(1)).over(at(0)).alias("_copies"),
    )
    clash = F.raise_error(F.concat(F.lit("Duplicate key and time: "), F.col(key), F.lit(" "),
                                   F.col(time).cast("string")))
    unique = F.when(known & F.col(key).isNotNull() & (F.col("_copies") > 1), clash.cast("boolean")).otherwise(True)
    return (
        found.where((F.col("_bucket") == F.col("_own")) & unique)
        .drop("_us", "_own", "_bucket", "_copies")
    )


def _hours(values: Iterable[int], what: str) -> tuple[int, ...]:
    values = tuple(values)
    if any(v <= 0 for v in values):
        raise ValueError(f"All {what} must be greater than 0.")
    return values


def lag_lookups(lags: Iterable[int] = LAGS) -> dict[str, tuple[str, int]]:
    return {f"{c}_lag_{n}h": (c, -n) for n in _hours(lags, "lags") for c in ("q", "k")}


def target_lookups(horizons: Iterable[int] = HORIZONS) -> dict[str, tuple[str, int]]:
    horizons = _hours(horizons, "horizons")
    if not horizons:
        raise ValueError("At least one horizon is required.")
    if len(set(horizons)) != len(horizons):
        raise ValueError("Horizons must be unique.")
    return {target_column(n): ("k", n) for n in horizons}


def traffic_lags(df: DataFrame, lags: Iterable[int] = LAGS) -> DataFrame:
    """q and k exactly n hours earlier on the same road."""
    require_columns(df, [KEY, TIME, "q", "k"])
    lookups = lag_lookups(lags)
    return exact_offsets(df, lookups) if lookups else df


def traffic_targets(df: DataFrame, horizons: Iterable[int] = HORIZONS) -> DataFrame:
    """k exactly n hours later on the same road."""
    return exact_offsets(df, target_lookups(horizons))


def traffic_target_single(df: DataFrame, horizon_hours: int = 1) -> DataFrame:
    return traffic_targets(df, (horizon_hours,))


def lags_and_targets(df: DataFrame, lags: Iterable[int] = LAGS, horizons: Iterable[int] = HORIZONS) -> DataFrame:
    """Both sets of lookups in a single shuffle."""
    return exact_offsets(df, {**lag_lookups(lags), **target_lookups(horizons)})


def with_previous_time(
    df: DataFrame, key: str = KEY, time: str = TIME, bucket_hours: int = BUCKET_HOURS
) -> DataFrame:
    """Add `previous_time`: the time of the road's row before this one.

    Inside a bucket this is a plain lag. The newest time of each bucket is handed
    to the road's next bucket as one extra row, so buckets stay independent.
    """
    bucket = time_bucket(F.unix_micros(time), bucket_hours)
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_bucket", bucket)
    newest = rows.groupBy(key, "_bucket").agg(F.max(time).alias(time))
    handed = newest.select(
        key, time, F.lead("_bucket").over(Window.partitionBy(key).orderBy("_bucket")).alias("_bucket")
    ).where(F.col("_bucket").isNotNull())
    line = Window.partitionBy(key, "_bucket").orderBy(time, "_carried")
    both = rows.withColumn("_carried", F.lit(1)).unionByName(
        handed.withColumn("_carried", F.lit(0)), allowMissingColumns=True
    ).repartition(F.col(key), F.col("_bucket"))
    return (
        both.withColumn("previous_time", F.lag(time).over(line))
        .where(F.col("_carried") == 1)
        .drop("_bucket", "_carried")
    )


def gap_histogram(df: DataFrame) -> DataFrame:
    """How often each distance to the previous row occurs, in hours."""
    gap = (F.unix_micros(TIME) - F.unix_micros("previous_time")) / HOUR_US
    return (
        with_previous_time(df).where(F.col("previous_time").isNotNull())
        .groupBy(gap.alias("gap_hours")).agg(F.count(F.lit(1)).alias("n"))
    )


def gaps_over_1h(df: DataFrame, hours: float = 1) -> DataFrame:
    """Rows whose previous row on the road lies more than `hours` back."""
    gap = F.unix_micros(TIME) - F.unix_micros("previous_time")
    return (
        with_previous_time(df).where(gap > F.lit(int(hours * HOUR_US)))
        .withColumn("gap_hours", gap / HOUR_US)
    )


def gap_context(df: DataFrame, before: int = 2, after: int = 2, hours: float = 1) -> DataFrame:
    """Each road's first gap with its neighbours: `position` counts from the gap row.

    Positions run from -before to +after. Only the nearest rows on either side are
    ranked, so the rank limit is applied before the shuffle.
    """
    first = gaps_over_1h(df, hours).groupBy(KEY).agg(F.min(TIME).alias("gap_time"))
    rows = join_per_road(df.where(F.col(TIME).isNotNull()), first)
    road = Window.partitionBy(KEY)
    earlier = (
        rows.where(F.col(TIME) < F.col("gap_time"))
        .withColumn("_rank", F.row_number().over(road.orderBy(F.col(TIME).desc())))
        .where(F.col("_rank") <= before).withColumn("position", -F.col("_rank"))
    )
    later = (
        rows.where(F.col(TIME) >= F.col("gap_time"))
        .withColumn("_rank", F.row_number().over(road.orderBy(TIME)))
        .where(F.col("_rank") <= after + 1).withColumn("position", F.col("_rank") - 1)
    )
    return earlier.unionByName(later).drop("_rank")
