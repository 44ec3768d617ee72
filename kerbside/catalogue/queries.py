"""One runnable query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.catalogue import views as V
from kerbside.functions import geo
from kerbside.functions.values import instant_from_text
from kerbside.operators import cleaning as clean
from kerbside.operators import evaluate as ev
from kerbside.operators import features as feat
from kerbside.operators import incremental as inc
from kerbside.operators import keyed, monitoring, nearby, occurrences, offsets, profiles, reference, serving
from kerbside.plans import features as plans
from kerbside.plans import ingest, learners, training
from kerbside.plans.inference import horizon_predictions, run_predictions
from kerbside.plans.jobs import refresh_job
from kerbside.schemas import BULK_EXPORT, FEATURES_CORE, FEATURES_WEATHER, HORIZONS, KEY, TIME
from kerbside.session import pin_utc, run_folder
from kerbside.sources import landed, tables
from kerbside.streaming import inbox

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = "2024-01-31 06:00:00"
MIN_OBSERVATIONS = 240  # the driver's events cover one month
MIN_VALID_RATIO = 0.85
CUTOFF = "2024-01-24 00:00:00"
ROAD = "1"
PERIODS = [("2024-01-01 00:00:00", "2024-01-07 23:00:00"), ("2024-01-15 00:00:00", "2024-01-15 12:00:00"),
           ("2025-06-01 00:00:00", "2025-06-30 00:00:00")]


def plain(df: DataFrame) -> DataFrame:
    """Times leave as UTC wall clock, so that no reader applies a zone to them."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(fn(pin_utc(spark), sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


# --- sources and sinks ---------------------------------------------------------------


def land_pages(spark: SparkSession, records: DataFrame, number: str, label: str) -> str:
    """Write records as result pages of at most a hundred, the way an API answers them."""
    path = run_folder(spark, label)
    fields = F.struct(*[c for c in records.columns if c != number])
    (
        records.groupBy(F.floor(F.col(number) / 100).alias("page"))
        .agg(F.count(F.lit(1)).alias("total_count"), F.collect_list(fields).alias("results"))
        .drop("page").write.json(path)
    )
    return path


def traffic_records(spark, sf):
    """Landed records with nested geometry; the shape of a record is a nested feature."""
    shape = F.from_json(F.lit('{"type":"Feature"}'), "type string")
    number = F.col("event_id")
    return V.obs_raw(
        spark, sf, q="case when event_id % 13 <> 0 then cast(event_id % 500 as double) end",
        k="case when event_id % 11 <> 0 then value / 4 end",
    ).withColumn("geo_shape", F.when(number % 6 != 0, shape))


RECORD_COLUMNS = [KEY, "libelle", "t_1h", "q", "k", "etat_trafic", "etat_barre", "iu_nd_amont", "iu_nd_aval"]


@query
def src_traffic_pages(spark, sf):
    path = land_pages(spark, traffic_records(spark, sf), "event_id", "traffic-pages")
    return landed.traffic_pages(spark, path).select(*RECORD_COLUMNS)


def reference_pages(spark, sf) -> str:
    numbered = V.road_ref_raw(spark, sf).withColumn("n", F.substring("iu_nd_amont", 2, 20).cast("long"))
    return land_pages(spark, numbered, "n", "reference-pages")


@query
def src_road_reference_pages(spark, sf):
    wanted = V.obs(spark, sf).select(KEY)
    rows = landed.road_reference_pages(spark, reference_pages(spark, sf), wanted)
    return rows.select(KEY, "libelle", "date_debut", "date_fin", "iu_nd_amont", "iu_nd_aval",
                       F.col("geo_point_2d.lon").alias("lon"), F.col("geo_point_2d.lat").alias("lat"))


def event_pages(spark, sf) -> str:
    numbered = V.events_raw(spark, sf).withColumn("n", F.substring("event_id", 4, 20).cast("long"))
    return land_pages(spark, numbered, "n", "event-pages")


@query
def src_event_pages(spark, sf):
    rows = landed.event_pages(spark, event_pages(spark, sf))
    return rows.select("event_id", "title", "date_start", "date_end", "occurrences",
                       F.col("lat_lon.lon").alias("lon"), F.col("lat_lon.lat").alias("lat"))


def weather_pages(spark, sf) -> str:
    """One payload per day: an array per variable, all in hour order."""
    hourly = V.weather(spark, sf).withColumn("time", F.date_format(TIME, "yyyy-MM-dd'T'HH:mm"))
    names = ["time", *[c for c in hourly.columns if c not in (TIME, "time")]]
    day = F.sort_array(F.collect_list(F.struct(*names)))
    path = run_folder(spark, "weather-payload")
    (
        hourly.groupBy(F.to_date(TIME).alias("day")).agg(day.alias("d"))
        .select(F.struct(*[F.col(f"d.{n}").alias(n) for n in names]).alias("hourly"))
        .write.json(path)
    )
    return path


@query
def src_weather_payload(spark, sf):
    return landed.weather_payload(spark, weather_pages(spark, sf))


def bulk_folder(spark, sf) -> str:
    """Export files in event order."""
    path = run_folder(spark, "bulk")
    return tables.sink_parquet(V.bulk(spark, sf).orderBy("event_id").drop("event_id"), path)


@query
def scan_bulk_parquet(spark, sf):
    return tables.scan_bulk_parquet(spark, bulk_folder(spark, sf)).drop(*tables.SOURCE_ORDER)


@query
def scan_parquet(spark, sf):
    return tables.scan_parquet(spark, f"{sf}/customer.parquet", ["c_custkey", "c_name"])


@query
def sink_parquet(spark, sf):
    path = run_folder(spark, "sink")
    rows = V.obs(spark, sf).withColumn("month", F.date_format(TIME, "yyyy-MM"))
    tables.sink_parquet(rows, path, ["month"])
    return tables.scan_parquet(spark, path).select(KEY, TIME, "q", "k", F.col("month").cast("string").alias("month"))


@query
def union_sources(spark, sf):
    rows = V.obs(spark, sf)
    return clean.union_sources(rows.where("k >= 15"), rows.where("k < 15").drop("q"))


@query
def capped_per_road(spark, sf):
    return profiles.capped_per_road(V.obs(spark, sf), n=200)


@query
def ingest_traffic(spark, sf):
    path = land_pages(spark, traffic_records(spark, sf), "event_id", "traffic-pages")
    target = ingest.ingest_traffic(spark, path, run_folder(spark, "traffic"))
    return tables.scan_parquet(spark, target).select(KEY, "t_1h", TIME, "q", "k", "geo_point_2d")


@query
def ingest_weather(spark, sf):
    target = ingest.ingest_weather(spark, weather_pages(spark, sf), run_folder(spark, "weather"))
    return tables.scan_parquet(spark, target)


@query
def ingest_events(spark, sf):
    target = ingest.ingest_events(spark, event_pages(spark, sf), run_folder(spark, "events"))
    return tables.scan_parquet(spark, target)


@query
def process_traffic_file(spark, sf):
    source = tables.sink_parquet(V.obs_raw(spark, sf), run_folder(spark, "raw"))
    target = tables.process_traffic_file(spark, source, run_folder(spark, "interim"))
    return tables.scan_parquet(spark, target)


@query
def load_traffic_table(spark, sf):
    source = tables.sink_parquet(V.obs(spark, sf), run_folder(spark, "interim"))
    store = run_folder(spark, "store")
    ingest.load_traffic_table(spark, source, store)
    return tables.read_store(spark, store)


# --- projections, normalisation, predicates -------------------------------------------


@query
def normalize_traffic(spark, sf):
    return clean.normalize_traffic(V.obs_raw(spark, sf)).select(
        "event_id", KEY, TIME, "q", "k", "geo_point_2d", "geo_shape")


@query
def clean_traffic(spark, sf):
    return clean.clean_traffic(V.obs_raw(spark, sf)).drop("libelle", "t_1h", "etat_trafic", "etat_barre")


@query
def normalize_json_text(spark, sf):
    raw = V.obs_raw(spark, sf).select("event_id", "geo_point_2d", "geo_shape", F.col("event_id").alias("geo_number"))
    for name in ("geo_point_2d", "geo_shape", "geo_number"):
        raw = clean.normalize_json_text(raw, name)
    return raw


@query
def utc_to_local(spark, sf):
    return clean.utc_to_local(V.obs(spark, sf)).select(KEY, TIME, "timestamp_paris")


@query
def normalize_utc(spark, sf):
    return clean.normalize_utc(V.obs_raw(spark, sf).select("event_id", F.col("t_1h").alias(TIME)))


@query
def quality_flags(spark, sf):
    return clean.process_traffic(V.obs_raw(spark, sf)).select(
        "event_id", "is_valid_iu_ac", "has_q", "has_k", "has_complete_measurement",
        "is_invalid_road_state", "is_unknown_traffic_state")


@query
def quality_counts(spark, sf):
    return clean.quality_counts(clean.process_traffic(V.obs_raw(spark, sf)))


@query
def normalize_bulk(spark, sf):
    return clean.normalize_bulk(V.bulk(spark, sf))


@query
def filter_eligible_ids(spark, sf):
    return clean.filter_eligible_ids(V.obs(spark, sf), V.road_reference(spark, sf))


@query
def normalize_events(spark, sf):
    return V.city_events(spark, sf)


@query
def explode_occurrences(spark, sf):
    return V.occurrences(spark, sf)


@query
def normalize_road_reference(spark, sf):
    return rounded(V.road_reference(spark, sf), 3, "road_length_m")


@query
def latest_version_per_road(spark, sf):
    dated = V.road_ref_raw(spark, sf).withColumns({
        c: instant_from_text(F.col(c)) for c in ("date_debut", "date_fin")})
    return reference.latest_version_per_road(dated).select(KEY, "libelle", "date_debut", "date_fin")


@query
def dedupe_keep_last(spark, sf):
    rows = clean.clean_traffic(V.obs_raw(spark, sf)).select("event_id", KEY, TIME, "q", "k")
    return clean.dedupe_keep_last(rows, "event_id")


@query
def sync_reference_projection(spark, sf):
    return rounded(reference.sync_reference_projection(V.road_reference(spark, sf)), 3, "road_length_m")


@query
def filter_complete(spark, sf):
    return clean.filter_complete(V.obs(spark, sf))


@query
def filter_road(spark, sf):
    return clean.filter_road(V.obs(spark, sf), ROAD)


@query
def distinct_ids(spark, sf):
    return clean.distinct_ids(clean.clean_traffic(V.obs_raw(spark, sf)))


@query
def incomplete_rows(spark, sf):
    return clean.incomplete_rows(clean.clean_traffic(V.obs_raw(spark, sf))).select(
        "event_id", KEY, TIME, "q", "k", "etat_trafic", "etat_barre")


@query
def congested_rows(spark, sf):
    local = clean.utc_to_local(V.obs(spark, sf))
    return clean.congested_rows(local, min_k=15).select(KEY, "timestamp_paris", "q", "k")


@query
def congestion_class(spark, sf):
    return clean.congestion_class(V.obs(spark, sf))


# --- joins ------------------------------------------------------------------------------


@query
def traffic_lags(spark, sf):
    return offsets.traffic_lags(V.obs(spark, sf))


@query
def traffic_targets(spark, sf):
    return offsets.traffic_targets(V.obs(spark, sf))


@query
def traffic_target_single(spark, sf):
    return offsets.traffic_target_single(V.obs(spark, sf), 2)


@query
def weather_features(spark, sf):
    return feat.weather_features(V.obs(spark, sf), V.weather(spark, sf))


@query
def road_features(spark, sf):
    return rounded(feat.road_features(V.obs(spark, sf), V.road_reference(spark, sf)), 3, "road_length_m")


def placed_obs(spark, sf):
    return feat.road_features(V.obs(spark, sf), V.road_reference(spark, sf))


def stored(spark, df, label) -> DataFrame:
    """A job's input as a written table, for jobs that read it more than once."""
    return tables.scan_parquet(spark, tables.sink_parquet(df, run_folder(spark, label)))


def with_events(spark, sf) -> DataFrame:
    return nearby.event_features(
        stored(spark, placed_obs(spark, sf), "placed"), stored(spark, V.occurrences(spark, sf), "occurrences"))


@query
def event_features(spark, sf):
    rows = with_events(spark, sf)
    return rows.select(KEY, TIME, "event_count_nearby_target_1h", "has_event_nearby_target_1h")


@query
def stats_reference_join(spark, sf):
    stats = profiles.road_statistics(V.obs(spark, sf))
    return rounded(profiles.stats_reference_join(stats, V.road_reference(spark, sf)), 3, "road_length_m")


def eligible(spark, sf):
    return profiles.eligible_roads(
        profiles.road_statistics(V.obs(spark, sf)), V.road_reference(spark, sf),
        min_observations=MIN_OBSERVATIONS, min_valid_ratio=MIN_VALID_RATIO)


@query
def reference_for_eligible(spark, sf):
    found = reference.reference_for_eligible(V.road_reference(spark, sf), eligible(spark, sf))
    return rounded(found, 3, "road_length_m")


@query
def roads_not_in_reference(spark, sf):
    return reference.roads_not_in_reference(V.segments(spark, sf), eligible(spark, sf)).select(KEY, "libelle")


@query
def new_vs_known_roads(spark, sf):
    return inc.new_vs_known_roads(V.road_reference(spark, sf), V.obs(spark, sf))


@query
def missing_road_ids(spark, sf):
    return reference.missing_road_ids(V.obs(spark, sf), V.road_reference(spark, sf))


@query
def events_overlapping_period(spark, sf):
    return occurrences.events_overlapping_period(V.city_events(spark, sf), PERIODS)


def earlier_obs(spark, sf):
    """What the store holds before the increment: all but some roads, up to a time per road."""
    last = "timestamp '2024-01-20 00:00:00' + make_dt_interval(0, cast(cast(iu_ac as bigint) % 48 as int))"
    return V.obs(spark, sf).where(f"cast(iu_ac as bigint) % 6 <> 2 and timestamp_utc <= {last}")


def roads_of(spark, sf):
    return V.obs(spark, sf).select(KEY).distinct()


@query
def cursor_filter(spark, sf):
    cursor = inc.cursors(roads_of(spark, sf), earlier_obs(spark, sf))
    return inc.cursor_filter(V.obs(spark, sf), cursor)


# --- aggregations, profiles, selection ----------------------------------------------------


def stats(spark, sf):
    return profiles.road_statistics(V.obs(spark, sf))


@query
def road_statistics(spark, sf):
    return profiles.road_statistics(clean.clean_traffic(V.obs_raw(spark, sf)))


@query
def eligible_roads(spark, sf):
    return rounded(eligible(spark, sf), 6, "valid_q_ratio", "valid_k_ratio", "road_length_m")


@query
def candidate_roads(spark, sf):
    chosen = profiles.candidate_roads(stats(spark, sf), MIN_OBSERVATIONS, MIN_VALID_RATIO)
    return rounded(chosen, 6, "valid_q_ratio", "valid_k_ratio")


@query
def top_roads_by_coverage(spark, sf):
    rows = clean.clean_traffic(V.obs_raw(spark, sf))
    return rounded(profiles.top_roads_by_coverage(rows, min_coverage=0.7), 6, "k_coverage")


@query
def observations_per_road(spark, sf):
    return profiles.observations_per_road(clean.clean_traffic(V.obs_raw(spark, sf)))


@query
def coverage_ratio(spark, sf):
    return rounded(profiles.coverage_ratio(stats(spark, sf)), 6, "coverage_ratio")


@query
def threshold_counts(spark, sf):
    return profiles.threshold_counts(stats(spark, sf))


@query
def smallest_roads(spark, sf):
    return profiles.smallest_roads(stats(spark, sf))


@query
def describe_numeric(spark, sf):
    return rounded(profiles.describe_numeric(stats(spark, sf), "n_observations"), 6, "mean", "std", "p25", "p50", "p75")


@query
def distinct_roads(spark, sf):
    return profiles.distinct_roads(V.obs(spark, sf))


@query
def null_profile(spark, sf):
    return profiles.null_profile(clean.clean_traffic(V.obs_raw(spark, sf)), [
        KEY, TIME, "q", "k", "etat_trafic", "etat_barre", "date_debut", "date_fin", "geo_point_2d", "geo_shape"])


@query
def time_range(spark, sf):
    return profiles.time_range(V.obs(spark, sf))


@query
def versions_per_road(spark, sf):
    return reference.versions_per_road(V.road_ref_raw(spark, sf))


@query
def gap_histogram(spark, sf):
    return offsets.gap_histogram(V.obs(spark, sf))


@query
def gaps_over_1h(spark, sf):
    return offsets.gaps_over_1h(V.obs(spark, sf))


@query
def gap_context(spark, sf):
    return offsets.gap_context(V.obs(spark, sf))


@query
def complete_count(spark, sf):
    return profiles.complete_count(V.obs(spark, sf))


@query
def event_duration_profile(spark, sf):
    return occurrences.event_duration_profile(V.city_events(spark, sf))


@query
def longest_events(spark, sf):
    return rounded(occurrences.longest_events(V.city_events(spark, sf)), 6, "duration_hours")


@query
def rows_without_match(spark, sf):
    joined = feat.weather_features(placed_obs(spark, sf), V.weather(spark, sf))
    road = profiles.rows_without_match(joined, plans.FEATURES_ROAD).withColumn("source", F.lit("road"))
    sky = profiles.rows_without_match(joined, plans.FEATURES_TARGET_WEATHER).withColumn("source", F.lit("weather"))
    return road.unionByName(sky)


@query
def targets_available(spark, sf):
    rows = offsets.traffic_targets(V.obs(spark, sf))
    return profiles.targets_available(rows, ["target_k_1h", "target_k_2h", "target_k_3h"])


@query
def systematic_sample(spark, sf):
    return profiles.systematic_sample(V.obs(spark, sf))


@query
def page_overlap(spark, sf):
    """Roads that are both in the statistics and in the reference."""
    return profiles.page_overlap(stats(spark, sf), V.road_reference(spark, sf))


@query
def event_coverage(spark, sf):
    rows = with_events(spark, sf)
    return rounded(profiles.event_coverage(rows.where(F.col(TIME) > F.lit(CUTOFF).cast("timestamp"))), 6, "event_coverage_pct")


@query
def bulk_import_counts(spark, sf):
    """Four deliveries, dealt by event number, imported one after the other into one store; each import's total line, and all of it.

    A road's rows of a delivery are in one file of it, so the line counts its roads' times once.
    """
    store, roads, lines = run_folder(spark, "store"), V.road_reference(spark, sf), None
    for i in range(4):
        delivery = V.bulk(spark, sf).where(F.col("event_id") % 4 == i).drop("event_id").repartition(KEY)
        folder = tables.sink_parquet(delivery, run_folder(spark, "delivery"))
        counts = ingest.bulk_import_counts(spark, folder, roads, store).where("file_name is null")
        line = counts.withColumn("file_name", F.lit(f"export-{i}.parquet"))
        lines = line if lines is None else lines.unionByName(line)
    totals = lines.agg(F.lit(None).cast("string").alias("file_name"), *(F.sum(c).alias(c) for c in lines.columns if c != "file_name"))
    return lines.unionByName(totals)


# --- calendar and time ---------------------------------------------------------------------


@query
def time_features(spark, sf):
    return feat.time_features(clean.utc_to_local(V.obs(spark, sf))).drop("q", "k")


def order_times(spark, sf):
    """Order dates: several years, so that the calendar has something to find."""
    orders = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias(TIME))
    return clean.utc_to_local(orders)


@query
def public_holiday_features(spark, sf):
    return feat.public_holiday_features(order_times(spark, sf))


@query
def school_holiday_features(spark, sf):
    """Orders moved by 27 years, into the years around the known school period."""
    moved = order_times(spark, sf).withColumn(
        "timestamp_paris", F.col("timestamp_paris") + F.expr("interval 27 years"))
    return feat.school_holiday_features(moved).drop(TIME)


@query
def target_timestamp(spark, sf):
    return feat.target_timestamp(V.obs(spark, sf), 3)


# --- geometry ------------------------------------------------------------------------------


@query
def haversine_m(spark, sf):
    """Distance of every city event to the first road's corner of the map."""
    spots = V.city_events(spark, sf).na.drop(subset=["latitude", "longitude"])
    return spots.select("event_id", "date_start", "date_end", F.round(geo.haversine_m(
        F.lit(2.25), F.lit(48.8), F.col("longitude"), F.col("latitude")), 3).alias("distance_m"))


def venues(spark, sf):
    return V.occurrences(spark, sf).select(
        F.col("latitude").alias("venue_latitude"), F.col("longitude").alias("venue_longitude"))


@query
def haversine_pairs(spark, sf):
    roads = V.road_reference(spark, sf).select(KEY, "latitude", "longitude").na.drop()
    return rounded(nearby.haversine_pairs(roads, venues(spark, sf)), 3, "distance_m")


@query
def linestring_length(spark, sf):
    lines = reference.linestring_length(V.road_ref_raw(spark, sf))
    return rounded(lines.select("iu_nd_amont", "road_length_m"), 3, "road_length_m")


@query
def event_radius_pairs(spark, sf):
    roads = V.road_reference(spark, sf).select(KEY, "latitude", "longitude")
    pairs = nearby.event_radius_pairs(roads, V.occurrences(spark, sf))
    return rounded(pairs, 3, "distance_m").select(
        KEY, "event_id", "occurrence_start", "occurrence_end", "distance_m")


@query
def active_interval_count(spark, sf):
    """Intervals of each road's customers, reversed ones among them, at each observation."""
    spans = V.events_raw(spark, sf).select(
        F.expr(f"cast(cast(substring(event_id, 4, 20) as bigint) div {V.CUSTOMERS_PER_ROAD} as string)").alias(KEY),
        instant_from_text(F.col("date_start")).alias("interval_start"),
        instant_from_text(F.col("date_end")).alias("interval_end"),
    )
    return nearby.active_interval_count(V.obs(spark, sf).select(KEY, TIME), spans)


# --- feature and dataset jobs ----------------------------------------------------------------


def local_obs(spark, sf):
    return clean.clean_traffic(V.obs(spark, sf))


@query
def build_traffic_features(spark, sf):
    rows = plans.build_traffic_features(local_obs(spark, sf), V.weather(spark, sf), V.road_reference(spark, sf))
    return rounded(rows, 3, "road_length_m")


def ml_dataset(spark, sf):
    return plans.build_ml_dataset(plans.build_traffic_features(
        local_obs(spark, sf), V.weather(spark, sf), V.road_reference(spark, sf)))


@query
def build_ml_dataset(spark, sf):
    return rounded(ml_dataset(spark, sf), 3, "road_length_m")


@query
def make_training_dataset(spark, sf):
    return plans.make_training_dataset(V.obs(spark, sf), 24 * 10)


def training_features(spark, sf):
    return plans.build_training_features(V.obs(spark, sf), V.road_reference(spark, sf))


@query
def build_training_features(spark, sf):
    return rounded(training_features(spark, sf), 3, "road_length_m")


@query
def build_prediction_features(spark, sf):
    return rounded(plans.build_prediction_features(V.obs(spark, sf), V.road_reference(spark, sf)), 3, "road_length_m")


@query
def multi_road_dataset(spark, sf):
    """The report on the features of many roads: missing values per column."""
    rows = plans.build_traffic_features(local_obs(spark, sf), V.weather(spark, sf), V.road_reference(spark, sf))
    return profiles.null_profile(rows, plans.REPORT_COLUMNS)


@query
def multi_road_rows(spark, sf):
    """The dataset of many roads itself."""
    rows = plans.multi_road_rows(V.obs(spark, sf), V.weather(spark, sf), V.road_reference(spark, sf))
    return rounded(rows, 3, "road_length_m")


@query
def multi_road_coverage(spark, sf):
    return plans.multi_road_coverage(V.obs(spark, sf), V.weather(spark, sf), V.road_reference(spark, sf))


@query
def excluded_roads(spark, sf):
    dense = plans.build_ml_dataset(plans.build_traffic_features(
        local_obs(spark, sf), V.weather(spark, sf), V.road_reference(spark, sf))).na.drop(subset=["latitude"])
    return profiles.excluded_roads(V.obs(spark, sf), dense)


# --- split, metrics, gate ----------------------------------------------------------------------


@query
def temporal_split(spark, sf):
    train, test = ev.temporal_split(V.obs(spark, sf))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def fixed_cutoff_split(spark, sf):
    train, test = ev.fixed_cutoff_split(V.obs(spark, sf), CUTOFF)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def persistence_baseline(spark, sf):
    _, test = ev.temporal_split(offsets.traffic_targets(V.obs(spark, sf)))
    return rounded(ev.persistence_baseline(test, HORIZONS), 6, "mae", "rmse")


# Stand-ins for model versions: formulas of k, so that the whole gate can be checked.
VERSION_FORMULAS = {"1": "k", "2": "0.5D * k + 8D", "3": "0.25D * k + 13D", "4": "k + 10D"}
GATE_ALIASES = [
    ("worse than persistence", 1, "4", "2"), ("first champion", 2, "2", None), ("same version", 3, "2", "2"),
    ("better than champion", 1, "3", "2"), ("worse than champion", 2, "1", "3"), ("equal to persistence", 3, "1", None),
]


def version_errors(spark, sf):
    """Each version's predictions on the evaluation rows of each horizon, in long form."""
    _, test = ev.temporal_split(offsets.traffic_targets(V.obs(spark, sf)))
    horizon = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon_hours"), F.col(f"target_k_{h}h").alias("actual")) for h in HORIZONS]))
    version = F.explode(F.array(*[
        F.struct(F.lit(v).alias("version"), F.expr(f).alias("predicted")) for v, f in VERSION_FORMULAS.items()]))
    rows = test.where("k is not null").select(KEY, TIME, "k", horizon.alias("h")).select(KEY, TIME, "k", "h.*")
    return rows.where("actual is not null").withColumn("p", version).select("*", "p.*").drop("p")


@query
def regression_metrics(spark, sf):
    rows = ev.regression_metrics(version_errors(spark, sf), "actual", "predicted", ["horizon_hours", "version"])
    return rounded(rows, 6, "mae", "rmse")


@query
def evaluation_rows(spark, sf):
    return ev.evaluation_rows(offsets.traffic_targets(V.obs(spark, sf)), 2)


@query
def improvement_pct(spark, sf):
    """Gain of each road's smoothed guess over persistence; some roads with zero errors."""
    rows = offsets.traffic_targets(V.obs(spark, sf), (1,)).where("k is not null and target_k_1h is not null")
    errors = rows.groupBy(KEY).agg(
        F.round(F.avg(F.abs(F.col("target_k_1h") - F.col("k"))), 6).alias("reference_mae"),
        F.round(F.avg(F.abs(F.col("target_k_1h") - (F.col("k") * 0.5 + 8))), 6).alias("candidate_mae"))
    zero = F.col(KEY).cast("long") % 5 == 0
    errors = errors.withColumns({
        "reference_mae": F.when(zero, F.lit(0.0)).otherwise(F.col("reference_mae")),
        "candidate_mae": F.when(F.col(KEY).cast("long") % 10 == 0, F.lit(0.0)).otherwise(F.col("candidate_mae"))})
    return rounded(ev.improvement_pct(errors, "reference_mae", "candidate_mae"), 5, "improvement_pct")


def gate_inputs(spark, sf):
    aliases = spark.createDataFrame(
        GATE_ALIASES, "model_name string, horizon_hours int, candidate_version string, champion_version string")
    errors = ev.regression_metrics(version_errors(spark, sf), "actual", "predicted", ["horizon_hours", "version"])
    metrics = stored(spark, errors, "gate-metrics")  # read three times
    scores = aliases.select("model_name", "horizon_hours").join(metrics, "horizon_hours")
    baseline = metrics.where("version = '1'").select("horizon_hours", "mae", "rmse", "n_samples")
    return aliases, scores, baseline


GATE_NUMBERS = ["baseline_mae", "baseline_rmse", "candidate_mae", "candidate_rmse", "champion_mae", "champion_rmse",
                "baseline_improvement_pct", "champion_improvement_pct"]


@query
def quality_gate(spark, sf):
    return rounded(ev.quality_gate(*gate_inputs(spark, sf)), 5, *GATE_NUMBERS)


@query
def promote_all(spark, sf):
    gates = ev.promote_all(*gate_inputs(spark, sf), metric="rmse", min_improvement_pct=0.5)
    return rounded(gates, 5, *GATE_NUMBERS)


@query
def model_version_lookup(spark, sf):
    """Newest version per run, and per model the newest one with the champion alias."""
    runs = V.training_runs(spark, sf)
    by_run = ev.newest_version_of_run(runs).withColumn("lookup", F.lit("run"))
    champion = ev.model_version_lookup(runs, "champion").withColumn("lookup", F.lit("champion")).drop("horizon_hours")
    return by_run.unionByName(champion)


@query
def last_training_timestamp(spark, sf):
    return ev.last_training_timestamp(V.training_runs(spark, sf))


# --- learners: the rows and facts around the models; what the models predict is for the tests ---------


def scored_rows(model, test):
    rows = learners.score(model, test)
    return rows.select(KEY, TIME, "k", "target_k_1h", has_prediction())


def has_prediction():
    return (F.col("predicted_k").isNotNull() & ~F.isnan("predicted_k")).alias("has_prediction")


def version_facts(versions: DataFrame) -> DataFrame:
    return versions.select(
        "model_name", "horizon_hours", "version", "alias", "status", "started_at",
        (F.col("mae").isNotNull() & F.col("rmse").isNotNull()).alias("has_errors"), F.size("features").alias("n_features"),
        "train_rows", "test_rows", "dataset_rows", "dataset_min_timestamp", "dataset_max_timestamp")


def comparison_facts(lines: DataFrame, relative: bool = False) -> DataFrame:
    """A comparison's lines with the errors of persistence alone; `own_gain_pct` is that of the line the others are relative to."""
    alone = F.col("model") == training.PERSISTENCE
    base = F.col("model") == "flow" if relative else alone
    best = F.sum(F.col("is_best").cast("int")).over(Window.partitionBy())  # a handful of models
    return lines.select(
        "model", "n_features", "n_samples", (F.col("mae").isNotNull() & F.col("rmse").isNotNull()).alias("has_errors"),
        (best == 1).alias("one_best"), F.round(F.when(alone, F.col("mae")), 6).alias("persistence_mae"),
        F.round(F.when(alone, F.col("rmse")), 6).alias("persistence_rmse"), F.when(base, F.col("mae_gain_pct")).alias("own_gain_pct"))


def prediction_facts(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(KEY, "prediction_timestamp_utc", "target_timestamp_utc", "horizon_hours", "model_version", *more, has_prediction())


def stored_features(spark, sf) -> DataFrame:
    return stored(spark, training_features(spark, sf), "training-features")


@query
def train_gbt(spark, sf):
    train, test = training._split(stored_features(spark, sf))
    return scored_rows(learners.train_gbt(train, FEATURES_CORE), test)


@query
def train_hist_gbt(spark, sf):
    train, test = training._split(stored(spark, ml_dataset(spark, sf), "ml-dataset"))
    return scored_rows(learners.train_hist_gbt(train, FEATURES_WEATHER), test)


def registry_of(spark):
    return training.Registry(spark, run_folder(spark, "registry"))


@query
def train_horizon(spark, sf):
    registry, dataset = registry_of(spark), stored_features(spark, sf)
    training.train_one_horizon(registry, dataset, _now(), 2)
    return version_facts(registry.versions())


def _now():
    from datetime import datetime

    return datetime.fromisoformat(NOW)


@query
def train_one_horizon(spark, sf):
    return version_facts(training.train_one_horizon(registry_of(spark), stored_features(spark, sf), _now(), 1))


@query
def train_all_horizons(spark, sf):
    return version_facts(training.train_all_horizons(registry_of(spark), stored_features(spark, sf), _now()))


def comparison_dataset(spark, sf) -> DataFrame:
    """Every feature of the comparisons, written once."""
    rows = plans.build_traffic_features(local_obs(spark, sf), V.weather(spark, sf), V.road_reference(spark, sf))
    held = stored(spark, V.occurrences(spark, sf), "occurrences")
    return stored(spark, nearby.event_features(stored(spark, rows, "features"), held), "comparison")


@query
def ablation_calendar(spark, sf):
    return comparison_facts(training.ablation_calendar(comparison_dataset(spark, sf)))


@query
def ablation_weather(spark, sf):
    return comparison_facts(training.ablation_weather(comparison_dataset(spark, sf)))


@query
def ablation_road(spark, sf):
    return comparison_facts(training.ablation_road(comparison_dataset(spark, sf)), relative=True)


@query
def ablation_events(spark, sf):
    return comparison_facts(training.ablation_events(comparison_dataset(spark, sf), CUTOFF), relative=True)


@query
def ablation_all(spark, sf):
    return comparison_facts(training.ablation_all(comparison_dataset(spark, sf), CUTOFF), relative=True)


@query
def model_comparison(spark, sf):
    return comparison_facts(training.model_comparison(comparison_dataset(spark, sf)))


@query
def train_report(spark, sf):
    return comparison_facts(training.train_report(comparison_dataset(spark, sf)))


# --- inference and serving ---------------------------------------------------------------------------


@query
def latest_observation_per_road(spark, sf):
    return serving.latest_observation_per_road(V.obs(spark, sf))


@query
def latest_timestamp_rows(spark, sf):
    return serving.latest_timestamp_rows(V.obs(spark, sf))


@query
def horizon_predictions_query(spark, sf):
    dataset = stored_features(spark, sf)
    model = learners.train_gbt(dataset, FEATURES_CORE, "target_k_2h")
    latest = serving.latest_observation_per_road(
        plans.build_prediction_features(V.obs(spark, sf), V.road_reference(spark, sf)))
    return prediction_facts(horizon_predictions(latest, model, "1", 2))


QUERIES["horizon_predictions"] = QUERIES.pop("horizon_predictions_query")


@query
def run_predictions_query(spark, sf):
    registry, store = registry_of(spark), run_folder(spark, "predictions")
    dataset = stored_features(spark, sf)
    training.train_all_horizons(registry, dataset, _now())
    registry.assign(registry.versions().select(
        "model_name", "horizon_hours", F.lit(training.CHAMPION).alias("alias"), "version"))
    run_predictions(V.obs(spark, sf), V.road_reference(spark, sf), registry, store)
    return prediction_facts(tables.read_store(spark, store), "first_write")


QUERIES["run_predictions"] = QUERIES.pop("run_predictions_query")


@query
def persistence_predictions(spark, sf):
    return serving.persistence_predictions(serving.latest_observation_per_road(V.obs(spark, sf)))


@query
def recent_window(spark, sf):
    return serving.recent_window(V.obs(spark, sf), 48)


@query
def latest_traffic_timestamp(spark, sf):
    return serving.latest_traffic_timestamp(V.obs(spark, sf))


@query
def latest_timestamp_by_road(spark, sf):
    return serving.latest_timestamp_by_road(V.obs(spark, sf), V.road_reference(spark, sf))


@query
def latest_n_for_road(spark, sf):
    return serving.latest_n_for_road(V.obs(spark, sf), n=24)


@query
def latest_predictions(spark, sf):
    return serving.latest_predictions(V.predictions(spark, sf), None)


@query
def latest_prediction_for_road(spark, sf):
    return serving.latest_prediction_for_road(V.predictions(spark, sf), horizon_hours=2)


@query
def road_history(spark, sf):
    return serving.road_history(V.obs(spark, sf), V.predictions(spark, sf), hours_back=24, horizon_hours=1)


@query
def list_roads(spark, sf):
    return rounded(reference.list_roads(V.segments(spark, sf)), 3, "road_length_m")


@query
def all_road_ids(spark, sf):
    return reference.all_road_ids(V.segments(spark, sf))


@query
def top_predicted(spark, sf):
    current = serving.latest_predictions(V.predictions(spark, sf), None)
    return serving.top_predicted(current).select(KEY, "horizon_hours", "predicted_k", "model_version")


@query
def response_projection(spark, sf):
    return serving.response_projection(V.predictions(spark, sf), "prediction")


# --- keyed writes ---------------------------------------------------------------------------------------


def traffic_batch(spark, sf):
    """A delivery that repeats some keys, adds new ones and carries nulls."""
    return V.obs_keyed(spark, sf).where(f"timestamp_utc >= timestamp '{CUTOFF}' or eid % 3 = 0").withColumns({
        "q": F.when(F.col("eid") % 4 != 0, F.col("q") + 1), "k": F.when(F.col("eid") % 6 != 0, F.col("k"))})


def stored_obs(spark, sf):
    return V.obs(spark, sf).where(f"timestamp_utc < timestamp '{CUTOFF}'")


@query
def upsert_traffic(spark, sf):
    """Through the store on disk: a first write, an upsert, and the same upsert again."""
    store = run_folder(spark, "store")
    tables.write_keyed(spark, store, keyed.traffic_batch(stored_obs(spark, sf)), keyed.merge_traffic)
    for _ in range(2):
        tables.write_keyed(spark, store, keyed.traffic_batch(traffic_batch(spark, sf)), keyed.merge_traffic)
    return tables.read_store(spark, store)


@query
def upsert_predictions(spark, sf):
    rows = V.predictions(spark, sf)
    stored = rows.where(f"prediction_timestamp_utc < timestamp '{CUTOFF}'")
    again = rows.where(f"prediction_timestamp_utc >= timestamp '{CUTOFF}' or first_write % 4 = 1").withColumns({
        "predicted_k": F.col("predicted_k") + 2, "first_write": F.col("first_write") + 1_000_000_000_000})
    return keyed.upsert_predictions(stored, again)


def new_segments(spark, sf):
    """The next reference: some roads gone, names changed."""
    return V.segments(spark, sf).where("cast(iu_ac as bigint) % 4 <> 1").withColumn(
        "libelle", F.concat("libelle", F.lit(" *")))


@query
def upsert_roads(spark, sf):
    store = run_folder(spark, "roads")
    tables.write_small(V.segments(spark, sf), store)
    ingest.upsert_road_store(spark, new_segments(spark, sf), store)
    return rounded(tables.read_store(spark, store), 3, "road_length_m")


@query
def sync_roads(spark, sf):
    """The stored segments after a sync: the table's second version."""
    store = run_folder(spark, "roads")
    tables.write_small(V.segments(spark, sf), store)
    tables.write_small(keyed.sync_roads(tables.read_store(spark, store), new_segments(spark, sf)), store)
    return rounded(tables.read_store(spark, store), 3, "road_length_m")


@query
def bulk_import(spark, sf):
    store = run_folder(spark, "store")
    ingest.bulk_import(spark, bulk_folder(spark, sf), V.road_reference(spark, sf), store)
    return tables.read_store(spark, store)


@query
def constraint_checks(spark, sf):
    shifted = V.predictions(spark, sf).withColumn("model_version", F.lit("1"))
    raw = clean.clean_traffic(V.obs_raw(spark, sf))
    return keyed.constraint_checks(raw, V.segments(spark, sf), shifted)


@query
def dataset_invariants(spark, sf):
    rows = plans.build_traffic_features(local_obs(spark, sf), V.weather(spark, sf), V.road_reference(spark, sf))
    rows = stored(spark, rows, "features")
    return keyed.dataset_invariants(plans.build_ml_dataset(rows), rows, V.obs(spark, sf))


@query
def weather_hour_checks(spark, sf):
    return keyed.weather_hour_checks(V.weather(spark, sf))


@query
def migrate_horizon(spark, sf):
    before = V.predictions(spark, sf).where("horizon_hours = 1").drop("horizon_hours")
    return keyed.migrate_horizon(before, strict=True)


# --- incremental and streaming -----------------------------------------------------------------------------


@query
def road_cursors(spark, sf):
    return inc.road_cursors(roads_of(spark, sf), earlier_obs(spark, sf))


@query
def bootstrap_window(spark, sf):
    cursor = inc.cursors(roads_of(spark, sf), earlier_obs(spark, sf))
    return inc.bootstrap_window(V.obs(spark, sf), cursor, NOW, bootstrap_hours=200)


@query
def incremental_ingest(spark, sf):
    store = run_folder(spark, "store")
    tables.write_keyed(spark, store, keyed.traffic_batch(earlier_obs(spark, sf)), keyed.merge_traffic, newest=True)
    ingest.incremental_ingest(spark, V.obs(spark, sf), roads_of(spark, sf), store, NOW, bootstrap_hours=300)
    return tables.read_store(spark, store)


@query
def stream_bulk_inbox(spark, sf):
    store = run_folder(spark, "store")
    stream = inbox.stream_bulk_inbox(
        spark, bulk_folder(spark, sf), V.road_reference(spark, sf).select(KEY), store, run_folder(spark, "state"),
        archive=run_folder(spark, "archive"))
    stream.awaitTermination()
    return tables.read_store(spark, store)


@query
def stream_dedupe(spark, sf):
    store = run_folder(spark, "deduped")
    rows = inbox.read_inbox(spark, bulk_folder(spark, sf), schema=BULK_EXPORT)
    inbox.stream_dedupe(rows, store, run_folder(spark, "state")).awaitTermination()
    return tables.read_store(spark, store)


@query
def freshness_gate(spark, sf):
    return rounded(inc.freshness_gate(V.obs(spark, sf), NOW), 6, "age_hours")


@query
def new_data_gate(spark, sf):
    gate = inc.new_data_gate(V.obs(spark, sf), ev.last_training_timestamp(V.training_runs(spark, sf)))
    return rounded(gate, 6, "new_data_hours")


@query
def refresh_job_query(spark, sf):
    """Files in the inbox to champions; a road's reference decides what is imported.

    A first model becomes champion unless persistence beats it.
    """
    decided = refresh_job(
        spark, bulk_folder(spark, sf), run_folder(spark, "archive"), run_folder(spark, "store"),
        run_folder(spark, "features"), V.road_reference(spark, sf), registry_of(spark), _now())
    first = F.col("reason") == "initial_champion"
    return decided.select(
        "horizon_hours", (F.col("mae").isNotNull() & F.col("rmse").isNotNull()).alias("has_errors"),
        (first | (F.col("reason") == "baseline_gate_failed")).alias("is_first_decision"),
        (F.col("promoted") == first).alias("promoted_as_decided"))


QUERIES["refresh_job"] = QUERIES.pop("refresh_job_query")


# --- monitoring ------------------------------------------------------------------------------------------------


@query
def observation_freshness(spark, sf):
    return monitoring.observation_freshness(V.obs(spark, sf), NOW)


@query
def prediction_coverage(spark, sf):
    return rounded(monitoring.prediction_coverage(V.predictions(spark, sf), V.segments(spark, sf)), 6, "coverage_ratio")


@query
def prediction_age(spark, sf):
    return monitoring.prediction_age(V.predictions(spark, sf), NOW)


@query
def champion_version_metric(spark, sf):
    return monitoring.champion_version_metric(V.predictions(spark, sf))


def alert_evaluations(spark, sf):
    return monitoring.alert_evaluations(V.obs(spark, sf), V.predictions(spark, sf), V.segments(spark, sf), NOW)


@query
def alerts(spark, sf):
    return rounded(monitoring.alerts(alert_evaluations(spark, sf)), 6, "value")


@query
def breach_runs(spark, sf):
    """All runs of breaches up to now, whether they fired or not."""
    return rounded(monitoring.breach_runs(alert_evaluations(spark, sf)), 6, "last_value")
