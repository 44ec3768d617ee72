"""Road-domain tables derived from the driver's tables.

Events play the sensor records: eight users make a road. Customers play reference
versions (sixty per road), city events and training runs. Everything grows with the
tables, and roads spread over more and more cities. The same derivations, written for
DuckDB, are in `oracle.py`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.occurrences import explode_occurrences, normalize_events
from kerbside.operators.reference import normalize_road_reference
from kerbside.session import pin_utc

USERS_PER_ROAD = 8
CUSTOMERS_PER_ROAD = 60
ISO = "yyyy-MM-dd'T'HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt over the cores: a table's file may be read by one task, however much is worked out from each row."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def obs_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly observations with the newest event id of the hour."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.expr(f"cast(user_id div {USERS_PER_ROAD} as string)").alias("iu_ac"),
            F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp_utc"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"), F.max("event_id").alias("eid"))
        .selectExpr(
            "iu_ac", "timestamp_utc",
            "case when eid % 13 <> 0 then cast(n as double) end as q",
            "case when eid % 11 <> 0 then v / 4 end as k",
            "eid",
        )
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs_keyed(spark, sf_dir).drop("eid")


RAW_Q = """case event_id % 13 when 0 then null when 1 then 'n/a' when 2 then '1e3' when 3 then '12f'
           when 4 then concat(' ', event_id % 500, ' ') else cast(event_id % 500 as string) end"""
RAW_K = """case event_id % 11 when 0 then null when 1 then 'nan' when 2 then ''
           else concat(cast(round(value * 100) as bigint) div 100, '.',
                       lpad(cast(cast(round(value * 100) as bigint) % 100 as string), 2, '0')) end"""


def obs_raw(spark: SparkSession, sf_dir: str, q: str = RAW_Q, k: str = RAW_K) -> DataFrame:
    """One landed record per event: padded and broken ids, bad numbers, three time styles."""
    local = "date_trunc('hour', cast(ts as timestamp))"
    point = (
        f"named_struct('lon', cast(22500 + (user_id div {USERS_PER_ROAD}) % 900 as double) / 10000D, "
        f"'lat', cast(488000 + (user_id div {USERS_PER_ROAD}) % 700 as double) / 10000D)"
    )
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        f"""case when event_id % 97 = 5 then '*' when event_id % 97 = 11 then 'ORA-03113'
                 when event_id % 97 = 17 then null
                 when event_id % 5 = 0 then concat('  ', user_id div {USERS_PER_ROAD}, ' ')
                 else cast(user_id div {USERS_PER_ROAD} as string) end as iu_ac""",
        f"concat('Rue ', user_id div {USERS_PER_ROAD}) as libelle",
        f"""case when event_id % 89 = 7 then 'not a time'
                 when event_id % 4 = 1 then concat(date_format({local} + interval 1 hour, "{ISO}"), '+01:00')
                 when event_id % 4 = 2 then concat(date_format({local}, "{ISO}"), 'Z')
                 else date_format({local}, 'yyyy-MM-dd HH:mm:ss') end as t_1h""",
        f"{q} as q",
        f"{k} as k",
        "case event_type when 'error' then 'Inconnu' when 'view' then null else 'Fluide' end as etat_trafic",
        "case when event_id % 29 = 0 then 'Invalide' when event_id % 29 = 1 then null else 'Ouvert' end as etat_barre",
        "concat(' ', user_id) as iu_nd_amont",
        "concat(user_id + 1, ' ') as iu_nd_aval",
        "case when event_id % 31 = 0 then 'bad' else concat('2020-01-', lpad(cast(1 + event_id % 28 as string), 2, '0')) end as date_debut",
        "case when event_id % 3 = 0 then concat('2025-02-', lpad(cast(1 + event_id % 28 as string), 2, '0')) end as date_fin",
        f"case when event_id % 7 <> 0 then {point} end as geo_point_2d",
        "case when event_id % 6 <> 0 then concat('{\"type\":\"Feature\",\"id\":', user_id, '}') end as geo_shape",
    )


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk export rows: ids and times as landed, q and k as numbers."""
    return obs_raw(spark, sf_dir, q="case when event_id % 13 <> 0 then cast(event_id % 500 as double) end",
                   k="case when event_id % 11 <> 0 then value / 4 end").select("event_id", "iu_ac", "t_1h", "q", "k")


def _place(key: str, dlat: str, dlon: str) -> tuple[str, str]:
    """Latitude and longitude in 1/10000 degree: fifty roads to a city, cities on a wide grid."""
    road = f"({key} div {CUSTOMERS_PER_ROAD})"
    lat = f"(488000 - 3000 * (({road} div 50) % 300) + 20 * ({road} % 50) + {dlat})"
    lon = f"(22500 + 5000 * ((({road} div 50) div 300) % 600) + 30 * (({road} * 7) % 50) + {dlon})"
    return lat, lon


#: Added to the ids of reference roads that nothing was observed on.
UNSEEN = 1_000_000_000


def road_ref_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty versions per road; one road in seven goes by an id that has no observations; broken dates and shapes."""
    road, v = f"(c_custkey div {CUSTOMERS_PER_ROAD})", f"(c_custkey % {CUSTOMERS_PER_ROAD})"
    lat, lon = _place("c_custkey", f"{v} % 7", f"{v} % 5")

    def degrees(e4: str) -> str:
        return f"cast({e4} as double) / 10000D"

    a = f"array({degrees(lon)}, {degrees(lat)})"
    b = f"array({degrees(lon + ' + 10')}, {degrees(lat + ' + 5')})"
    c = f"array({degrees(lon + ' + 25')}, {degrees(lat + ' + 2')})"

    def feature(kind: str, points: str) -> str:
        return f"named_struct('type', 'Feature', 'geometry', named_struct('type', '{kind}', 'coordinates', {points}))"

    return dealt(table(spark, sf_dir, "customer")).selectExpr(
        f"cast(case when {road} % 7 = 3 then {UNSEEN} + {road} else {road} end as string) as iu_ac",
        f"concat(c_mktsegment, ' ', {road}) as libelle",
        f"""case when {v} = 41 and {road} % 5 = 0 then 'unknown'
                 else date_format(date_add(date '2020-01-01', cast({v} * (1 + {road} % 3) as int)), 'yyyy-MM-dd') end as date_debut""",
        f"""case when {v} % 4 <> 0
                 then date_format(date_add(date '2020-01-01', cast(({v} + 1) * (1 + {road} % 3) as int)), 'yyyy-MM-dd') end as date_fin""",
        "concat('n', c_custkey) as iu_nd_amont",
        "concat('n', c_custkey + 1) as iu_nd_aval",
        f"case when {road} % 11 <> 9 then named_struct('lon', {degrees(lon)}, 'lat', {degrees(lat)}) end as geo_point_2d",
        f"""case when {road} % 17 = 8 then null
                 when {road} % 13 = 5 then {feature('Point', 'cast(null as array<array<double>>)')}
                 when {road} % 13 = 6 then {feature('LineString', f'array({a})')}
                 when {road} % 13 = 7 then {feature('LineString', f'array({a}, {b})')}
                 else {feature('LineString', f'array({a}, {b}, {c})')} end as geo_shape""",
    )


def road_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_road_reference(road_ref_raw(spark, sf_dir))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return road_reference(spark, sf_dir).selectExpr(
        "iu_ac", "libelle", "latitude", "longitude", "road_length_m", "geo_shape"
    )


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City events with packed occurrences in every state, and some repeated rows."""
    c = "c_custkey"
    lat, lon = _place(c, f"100 * ({c} % 3)", f"150 * ({c} % 5)")
    start = f"(timestamp '2024-01-01 00:00:00' + make_dt_interval(0, cast(({c} * 37) % 720 as int)))"
    days = f"(case when {c} % 10 = 0 then 45 else 0 end + case when {c} % 50 = 0 then 400 else 0 end)"
    length = f"case when {c} % 23 = 0 then -5 else cast({c} % 30 as int) + 24 * {days} end"

    def iso(time: str) -> str:
        return f"concat(date_format({time}, \"{ISO}\"), '+00:00')"

    def later(hours: str) -> str:
        return f"{start} + make_dt_interval(0, cast({hours} as int))"

    one = f"concat({iso(start)}, '_', {iso(later(f'1 + {c} % 5'))})"
    two = f"concat({iso(later('24'))}, '_', {iso(later('26'))})"
    fields = {
        "event_id": f"concat('ev-', {c})",
        "title": "c_name",
        "date_start": f"case when {c} % 41 = 3 then 'unknown' else {iso(start)} end",
        "date_end": f"case when {c} % 43 <> 5 then {iso(later(length))} end",
        "occurrences": f"""case when {c} % 4 = 1 then {one}
                 when {c} % 4 = 2 then concat({one}, '; ', {two}, ';', {one}, ';')
                 when {c} % 8 = 3 then 'tbd;morning_evening'
                 when {c} % 8 = 7 then '   ' end""",
        "lat_lon": f"""case when {c} % 19 <> 7 then named_struct('lon', cast({lon} as double) / 10000D,
                                                      'lat', cast({lat} as double) / 10000D) end""",
    }

    def event(**other: str) -> str:
        return "named_struct(" + ", ".join(f"'{name}', {text}" for name, text in {**fields, **other}.items()) + ")"

    # Both rows come from one reading, and parsers above filter the finished text without making it again.
    twins = f"array({event()}, {event(title="concat(c_name, ' (bis)')")})"
    return dealt(table(spark, sf_dir, "customer")).selectExpr(f"inline(case when {c} % 15 = 0 then {twins} else array({event()}) end)")


def city_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_events(events_raw(spark, sf_dir))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_occurrences(city_events(spark, sf_dir))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hour with events; one hour in seventeen is that of ten years later, so that it is missing where it was."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp_utc"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("e"), F.min("event_id").alias("lo"),
             F.max("user_id").alias("u"))
        .selectExpr(
            "case when e % 17 = 0 then timestamp_utc + make_dt_interval(3650) else timestamp_utc end as timestamp_utc",
            "cast(e % 300 as double) / 10D as temperature_2m",
            "cast(40 + n % 60 as double) as relative_humidity_2m",
            "cast(lo % 50 as double) / 10D as precipitation",
            "cast(lo % 50 as double) / 20D as rain",
            "cast(u % 40 as double) as wind_speed_10m",
            "cast(e % 4 as int) as weather_code",
        )
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three horizons per observation with k; every fifth one also by a second version."""
    rows = obs_keyed(spark, sf_dir).where("k is not null").withColumn(
        "horizon_hours", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    )
    lines = F.expr("""
        case when eid % 5 = 0 then array(
            named_struct('predicted_k', k, 'model_version', cast(1 + eid % 2 as string), 'first_write', eid * 10 + horizon_hours),
            named_struct('predicted_k', k + 1, 'model_version', '9', 'first_write', eid * 10 + horizon_hours + 5))
        else array(
            named_struct('predicted_k', k, 'model_version', case when eid % 7 = 0 then 'beta' else cast(1 + eid % 2 as string) end,
                         'first_write', eid * 10 + horizon_hours)) end""")
    return rows.withColumn("line", F.explode(lines)).selectExpr(
        "iu_ac", "timestamp_utc as prediction_timestamp_utc",
        "timestamp_utc + make_dt_interval(0, horizon_hours) as target_timestamp_utc",
        "horizon_hours", "line.predicted_k", "line.model_version", "line.first_write",
    )


def training_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of training runs: three horizons in turn, failed and unstamped runs among them."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('congestion-', 1 + c_custkey % 3, 'h') as model_name",
        "cast(1 + c_custkey % 3 as int) as horizon_hours",
        "cast(1 + c_custkey div 3 as int) as version",
        "concat('run-', c_custkey div 6) as run_id",
        "case c_custkey % 5 when 0 then 'champion' when 1 then 'candidate' end as alias",
        "case when c_custkey % 7 = 0 then 'FAILED' else 'FINISHED' end as status",
        "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(c_custkey as int)) as started_at",
        """case when c_custkey % 4 <> 0 then timestamp '2024-01-01 00:00:00'
                + make_dt_interval(0, cast(c_custkey % 700 as int)) end as dataset_max_timestamp""",
    )
