"""City events near a road at a time: radius pairs, interval counts, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions.geo import RadiusGrid, haversine_pairs_m
from kerbside.functions.values import hours
from kerbside.operators.offsets import BUCKET_HOURS, null_time_salt, time_bucket
from kerbside.schemas import KEY, TIME, require_columns

EVENT_RADIUS_M = 5000.0
#: Venues of a grid cell from which on it is divided, and venues in a part then.
PART_VENUES = 64
#: Cells to a radius of the two levels that stand for their venues.
COARSE, FINE = 4, 16


def _distance():
    return haversine_pairs_m(F.col("longitude"), F.col("latitude"), F.col("venue_longitude"), F.col("venue_latitude"))


def _pairs_within(roads: DataFrame, venues: DataFrame, radius_m: float) -> DataFrame:
    """(road columns, venue_latitude, venue_longitude, distance_m) within the radius.

    An equi-join on grid cells: each road is listed in the up to nine cells around it that
    hold venues, so it meets a venue in exactly one cell. Venues are counted per cell first;
    a crowded cell is divided into parts of PART_VENUES, each a join key of its own, and only
    there is a road listed once for every part. Both tables are small next to the pairs they
    make, and by their bytes alone Spark would merge them into a few tasks, so the pairs are
    dealt over the session's shuffle partitions.
    """
    grid, cell = RadiusGrid(radius_m), ["_band", "_cell"]
    tasks = int(roads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    home = grid.with_home(venues, "venue_longitude", "venue_latitude")
    parts = home.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / PART_VENUES).cast("long").alias("_parts"))
    right = home.join(parts, cell).withColumn(
        "_split", F.pmod(F.xxhash64("venue_latitude", "venue_longitude"), F.col("_parts"))).drop("_parts")
    left = grid.with_neighbourhood(roads, "longitude", "latitude").join(parts, cell).withColumn(
        "_split", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    keys = [*cell, "_split"]
    pairs = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys)
    return pairs.drop(*keys).withColumn("distance_m", _distance()).where(F.col("distance_m") <= radius_m)


def _with_cells(venues: DataFrame, radius_m: float) -> DataFrame:
    """Venues with their cell of the radius grid and of two finer ones."""
    out = venues
    for name, part in (("_own", 1), ("_coarse", COARSE), ("_fine", FINE)):
        out = RadiusGrid(radius_m / part).with_home(out, "venue_longitude", "venue_latitude")
        out = out.withColumn(name, F.struct("_band", "_cell")).drop("_band", "_cell")
    return out


def _boxes(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by).agg(
        F.min("venue_latitude").alias("_south"), F.max("venue_latitude").alias("_north"),
        F.min("venue_longitude").alias("_west"), F.max("venue_longitude").alias("_east"))


def _sorted_by_reach(pairs: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of a road and a box of venues that may be near it, with `_inside`: all of the box is within the radius.

    The farthest point of a box is one of its corners. No venue of it is nearer than the distance of its middle less that from its
    middle to a corner.
    """
    def to(lat: str, lon: str, lat0: str = "latitude", lon0: str = "longitude"):
        return haversine_pairs_m(F.col(lon0), F.col(lat0), F.col(lon), F.col(lat))

    corners = [(lat, lon) for lat in ("_south", "_north") for lon in ("_west", "_east")]
    placed = pairs.withColumns({"_y": (F.col("_south") + F.col("_north")) / 2, "_x": (F.col("_west") + F.col("_east")) / 2}).withColumns({
        "_farthest": F.greatest(*(to(*c) for c in corners)), "_middle": to("_y", "_x"),
        "_half": F.greatest(*(to(*c, "_y", "_x") for c in corners))})
    near = placed.where(F.col("_middle") - F.col("_half") <= radius_m * (1 + 1e-6))
    return near.withColumn("_inside", F.col("_farthest") <= radius_m * (1 - 1e-6)).drop(
        "_farthest", "_middle", "_half", "_y", "_x", "_south", "_north", "_west", "_east")


def venue_cover(roads: DataFrame, venues: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is near each road (id, latitude, longitude): whole coarse cells, whole fine cells of the others, single venues of the rest.

    Only cells that the circle's edge may cross are opened, so roads meet cells, and venues one by one only along the edge. Every
    venue (venue_latitude, venue_longitude, distinct) within the radius is in exactly one of the three; cells name the venues by
    `_own`, `_coarse` and `_fine`.
    """
    cells = _with_cells(venues, radius_m)
    coarse, fine = ["_own", "_coarse"], ["_own", "_coarse", "_fine"]
    around = RadiusGrid(radius_m).with_neighbourhood(roads, "longitude", "latitude").withColumn("_own", F.struct("_band", "_cell"))
    first = _sorted_by_reach(around.drop("_band", "_cell").join(_boxes(cells, coarse), "_own"), radius_m)
    second = _sorted_by_reach(first.where("not _inside").drop("_inside").join(_boxes(cells, fine), coarse), radius_m)
    rest = second.where("not _inside").drop("_inside").join(cells, fine).where(_distance() <= radius_m)
    return (first.where("_inside").select(KEY, *coarse), second.where("_inside").select(KEY, *fine),
            rest.select(KEY, "venue_latitude", "venue_longitude"))


def haversine_pairs(roads: DataFrame, venues: DataFrame, radius_m: float = EVENT_RADIUS_M) -> DataFrame:
    """Distances of roads (iu_ac, latitude, longitude) to venues (venue_latitude, venue_longitude)."""
    return _pairs_within(roads, venues.distinct(), radius_m)


def road_positions(df: DataFrame) -> DataFrame:
    """One position per road: that of its earliest row with both coordinates.

    Both aggregates see the same rows in the same order, so they agree on the row. They
    keep plain numbers, which lets Spark hash instead of sort the facts.
    """
    placed = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col(KEY).isNotNull())
    if TIME not in df.columns:
        return placed.groupBy(KEY).agg(F.min(F.struct("latitude", "longitude")).alias("p")).select(
            KEY, "p.latitude", "p.longitude")
    order = F.coalesce(F.unix_micros(TIME), F.lit(1 << 62))
    return placed.groupBy(KEY).agg(
        F.min_by("latitude", order).alias("latitude"), F.min_by("longitude", order).alias("longitude")
    )


def event_radius_pairs(roads: DataFrame, occurrences: DataFrame, radius_m: float = EVENT_RADIUS_M) -> DataFrame:
    """Every occurrence within the radius of each road, the limit included.

    Distances are worked out once per road and venue, however many occurrences share
    the venue.
    """
    require_columns(roads, [KEY, "latitude", "longitude"], "road")
    require_columns(occurrences, ["occurrence_start", "occurrence_end", "latitude", "longitude"], "event")
    held = occurrences.na.drop(
        subset=["occurrence_start", "occurrence_end", "latitude", "longitude"]
    ).withColumnsRenamed({"latitude": "venue_latitude", "longitude": "venue_longitude"})
    venues = held.select("venue_latitude", "venue_longitude").distinct()
    pairs = _pairs_within(road_positions(roads), venues, radius_m)
    return pairs.join(held, ["venue_latitude", "venue_longitude"])


def _edges(intervals: DataFrame, start: str, end: str, by: list[str], bucket_hours: int) -> DataFrame:
    """Interval ends as summed steps: +1 at a start (kind 0), -1 after an end (kind 2)."""
    step = F.inline(F.array(
        F.struct(F.unix_micros(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(1).cast("long").alias("_step")),
        F.struct(F.unix_micros(end).alias("_at"), F.lit(2).alias("_kind"), F.lit(-1).cast("long").alias("_step")),
    ))
    return (
        intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*by, step)
        .withColumn("_bucket", time_bucket(F.col("_at"), bucket_hours))
        .groupBy(*by, "_bucket", "_at", "_kind").agg(F.sum("_step").alias("_step"))
    )


def _count_open(points: DataFrame, edges: DataFrame, key: str, at: str, out: str, bucket_hours: int) -> DataFrame:
    """Running sum of the steps at each point, in independent (key, time bucket) pieces.

    A bucket starts from the sum of all earlier buckets' steps, which is worked out
    on per-bucket totals. Starts come before points and ends after points of the same
    time, which gives starts <= t minus ends < t also for intervals that end before
    they start.
    """
    rows = points.withColumn("_at", F.unix_micros(at)).withColumn(
        "_bucket", F.coalesce(time_bucket(F.col("_at"), bucket_hours), null_time_salt(points))
    )
    totals = edges.groupBy(key, "_bucket").agg(F.sum("_step").alias("_net"))
    # Per key one row per bucket, from edges or points.
    wanted = rows.where(F.col("_at").isNotNull()).select(key, "_bucket").distinct().withColumn("_net", F.lit(0).cast("long"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        wanted.unionByName(totals).groupBy(key, "_bucket").agg(F.sum("_net").alias("_net"))
        .select(key, "_bucket", F.coalesce(F.sum("_net").over(earlier), F.lit(0)).alias("_step"))
        .where(F.col("_step") != 0)
        .withColumns({"_kind": F.lit(-1), "_at": F.col("_bucket") * (bucket_hours * 3_600_000_000)})
    )
    everything = (
        rows.withColumns({"_kind": F.lit(1), "_step": F.lit(0).cast("long")})
        .unionByName(edges, allowMissingColumns=True)
        .unionByName(carried, allowMissingColumns=True)
        .repartition(F.col(key), F.col("_bucket"))
    )
    line = (
        Window.partitionBy(key, "_bucket").orderBy("_at", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        everything.withColumn(out, F.when(F.col("_at").isNotNull(), F.sum("_step").over(line)))
        .where(F.col("_kind") == 1).drop("_at", "_bucket", "_kind", "_step")
    )


def active_interval_count(
    points: DataFrame, intervals: DataFrame, key: str = KEY, at: str = TIME,
    start: str = "interval_start", end: str = "interval_end", out: str = "n_active",
    bucket_hours: int = BUCKET_HOURS,
) -> DataFrame:
    """For each point, the intervals of its key with start <= t minus those with end < t."""
    return _count_open(points, _edges(intervals, start, end, [key], bucket_hours), key, at, out, bucket_hours)


def event_features(
    df: DataFrame, occurrences: DataFrame, radius_m: float = EVENT_RADIUS_M, horizon_hours: int = 1,
    bucket_hours: int = BUCKET_HOURS, roads: DataFrame | None = None,
) -> DataFrame:
    """Count of occurrences within the radius at the target time, and a 0/1 flag.

    Occurrences are summed per venue and per cell before they meet the roads: a cell that lies
    within a road's radius as a whole gives it its summed steps, so a dense city costs each
    road as many rows as it has cells and times, not venues. Positions come from the rows unless `roads` (id, latitude, longitude) gives them, which saves a pass
    over the rows. The column suffix is the same for every horizon.
    """
    require_columns(df, [KEY, TIME, "latitude", "longitude"], "traffic")
    require_columns(occurrences, ["occurrence_start", "occurrence_end", "latitude", "longitude"], "event")
    venue = ["venue_latitude", "venue_longitude"]
    held = occurrences.withColumnsRenamed({"latitude": venue[0], "longitude": venue[1]}).na.drop(subset=venue)
    where = road_positions(df if roads is None else roads)
    found = venue_cover(where, held.select(*venue).distinct(), radius_m)
    # The occurrences with their cells are read by three sums of steps.
    placed = _with_cells(held.select("occurrence_start", "occurrence_end", *venue), radius_m)
    parts = [near.join(_edges(placed, "occurrence_start", "occurrence_end", by, bucket_hours), by).select(KEY, "_bucket", "_at", "_kind", "_step")
             for near, by in zip(found, (["_own", "_coarse"], ["_own", "_coarse", "_fine"], venue))]
    # Partitioned here, so that the two uses of the edges share one shuffle and one join.
    edges = (
        parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(F.col(KEY), F.col("_bucket"))
        .groupBy(KEY, "_bucket", "_at", "_kind").agg(F.sum("_step").alias("_step"))
    )
    points = df.withColumn("_target", F.col(TIME) + hours(horizon_hours))
    count = F.coalesce(F.col("_open"), F.lit(0)).cast("int")
    return (
        _count_open(points, edges, KEY, "_target", "_open", bucket_hours)
        .withColumns({
            "event_count_nearby_target_1h": count,
            "has_event_nearby_target_1h": (count > 0).cast("byte"),
        }).drop("_open", "_target")
    )
