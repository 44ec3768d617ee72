"""The catalogue's queries as independent DuckDB SQL over the same tables.

Lags are self joins, radius joins are plain range joins, interval counts are correlated
counts: the SQL states the meaning and does not follow the Spark plans.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def view(name: str, body: str) -> None:
    VIEWS[name] = body.strip()


def sql(name: str, body: str) -> None:
    """Register a query with the views that it uses, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for v, definition in VIEWS.items():
            if v not in needed and re.search(rf"\b{v}\b", text):
                visit(definition)
                if v not in needed:
                    needed.append(v)

    visit(body)
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    ORACLE[name] = (f"WITH {ctes}\n" if ctes else "") + body.strip()


DIGITS = "[0-9]+"


def number(text: str) -> str:
    plain = f"trim({text}, ' \t')"
    return (f"CASE WHEN regexp_full_match({plain}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN TRY_CAST({plain} AS DOUBLE) END")


def day_text(text: str) -> str:
    return f"CAST(TRY_STRPTIME({text}, '%Y-%m-%d') AS TIMESTAMP)"


def utc_text(text: str) -> str:
    """The three time styles of the landed records."""
    return (f"CASE WHEN {text} LIKE '%+01:00' THEN TRY_STRPTIME(substr({text}, 1, 19), '%Y-%m-%dT%H:%M:%S') - INTERVAL 1 HOUR "
            f"WHEN {text} LIKE '%+00:00' THEN TRY_STRPTIME(substr({text}, 1, 19), '%Y-%m-%dT%H:%M:%S') "
            f"WHEN {text} LIKE '%Z' THEN TRY_STRPTIME(substr({text}, 1, 19), '%Y-%m-%dT%H:%M:%S') "
            f"ELSE TRY_STRPTIME({text}, '%Y-%m-%d %H:%M:%S') END")


def paris(time: str) -> str:
    return f"timezone('Europe/Paris', timezone('UTC', {time}))"


def great_circle(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = (f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))")
    return f"(2 * 6371000 * atan2(sqrt{a}, sqrt(1 - {a})))"


# --- views -------------------------------------------------------------------------------

view("obs_keyed", """
SELECT iu_ac, timestamp_utc,
       CASE WHEN eid % 13 <> 0 THEN CAST(n AS DOUBLE) END AS q,
       CASE WHEN eid % 11 <> 0 THEN v / 4 END AS k, eid
FROM (SELECT CAST(user_id // 8 AS VARCHAR) AS iu_ac, date_trunc('hour', ts) AS timestamp_utc,
             count(*) AS n, max(value) AS v, max(event_id) AS eid
      FROM events GROUP BY 1, 2)""")
view("obs", "SELECT iu_ac, timestamp_utc, q, k FROM obs_keyed")

RAW_ID = """CASE WHEN event_id % 97 = 5 THEN '*' WHEN event_id % 97 = 11 THEN 'ORA-03113' WHEN event_id % 97 = 17 THEN NULL
     WHEN event_id % 5 = 0 THEN '  ' || (user_id // 8) || ' ' ELSE CAST(user_id // 8 AS VARCHAR) END"""
RAW_TIME = """CASE WHEN event_id % 89 = 7 THEN 'not a time'
     WHEN event_id % 4 = 1 THEN strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') || '+01:00'
     WHEN event_id % 4 = 2 THEN strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') || 'Z'
     ELSE strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') END"""
view("obs_raw", f"""
SELECT event_id, {RAW_ID} AS iu_ac, 'Rue ' || (user_id // 8) AS libelle, {RAW_TIME} AS t_1h,
       CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN '1e3' WHEN 3 THEN '12f'
            WHEN 4 THEN ' ' || (event_id % 500) || ' ' ELSE CAST(event_id % 500 AS VARCHAR) END AS q,
       CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN ''
            ELSE (CAST(round(value * 100) AS BIGINT) // 100) || '.'
                 || lpad(CAST(CAST(round(value * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS k,
       CASE event_type WHEN 'error' THEN 'Inconnu' WHEN 'view' THEN NULL ELSE 'Fluide' END AS etat_trafic,
       CASE WHEN event_id % 29 = 0 THEN 'Invalide' WHEN event_id % 29 = 1 THEN NULL ELSE 'Ouvert' END AS etat_barre,
       ' ' || user_id AS iu_nd_amont, (user_id + 1) || ' ' AS iu_nd_aval,
       CASE WHEN event_id % 31 = 0 THEN 'bad' ELSE '2020-01-' || lpad(CAST(1 + event_id % 28 AS VARCHAR), 2, '0') END AS date_debut,
       CASE WHEN event_id % 3 = 0 THEN '2025-02-' || lpad(CAST(1 + event_id % 28 AS VARCHAR), 2, '0') END AS date_fin,
       CASE WHEN event_id % 7 <> 0 THEN CAST(22500 + (user_id // 8) % 900 AS DOUBLE) / 1e4 END AS lon,
       CASE WHEN event_id % 7 <> 0 THEN CAST(488000 + (user_id // 8) % 700 AS DOUBLE) / 1e4 END AS lat,
       CASE WHEN event_id % 6 <> 0 THEN '{{"type":"Feature","id":' || user_id || '}}' END AS geo_shape
FROM events""")
view("obs_clean", f"""
SELECT event_id, trim(iu_ac) AS iu_ac, CAST({utc_text('t_1h')} AS TIMESTAMP) AS timestamp_utc,
       {number('q')} AS q, {number('k')} AS k, etat_trafic, etat_barre,
       trim(iu_nd_amont) AS iu_nd_amont, trim(iu_nd_aval) AS iu_nd_aval,
       {day_text('date_debut')} AS date_debut, {day_text('date_fin')} AS date_fin,
       CASE WHEN lon IS NOT NULL THEN '{{"lon":' || lon || ',"lat":' || lat || '}}' END AS geo_point_2d, geo_shape
FROM obs_raw""")
view("bulk", f"""
SELECT event_id, {RAW_ID} AS iu_ac, {RAW_TIME} AS t_1h,
       CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 500 AS DOUBLE) END AS q,
       CASE WHEN event_id % 11 <> 0 THEN value / 4 END AS k
FROM events""")
view("bulk_normal", f"""
SELECT * FROM (SELECT event_id, iu_ac, CAST({utc_text('t_1h')} AS TIMESTAMP) AS timestamp_utc, q, k FROM bulk)
WHERE iu_ac IS NOT NULL AND timestamp_utc IS NOT NULL""")


def place(dlat: str, dlon: str) -> str:
    return (f"488000 - 3000 * ((road // 50) % 300) + 20 * (road % 50) + {dlat} AS lat_e4, "
            f"22500 + 5000 * (((road // 50) // 300) % 600) + 30 * ((road * 7) % 50) + {dlon} AS lon_e4")


view("ref_base", f"""
SELECT *, {place('v % 7', 'v % 5')} FROM (
    SELECT c_custkey, c_mktsegment, c_custkey // 60 AS road, c_custkey % 60 AS v FROM customer)""")
view("ref_raw", """
SELECT c_custkey, CAST(CASE WHEN road % 7 = 3 THEN 1000000000 + road ELSE road END AS VARCHAR) AS iu_ac, c_mktsegment || ' ' || road AS libelle,
       CASE WHEN v = 41 AND road % 5 = 0 THEN 'unknown'
            ELSE strftime(DATE '2020-01-01' + CAST(v * (1 + road % 3) AS INTEGER), '%Y-%m-%d') END AS date_debut,
       CASE WHEN v % 4 <> 0 THEN strftime(DATE '2020-01-01' + CAST((v + 1) * (1 + road % 3) AS INTEGER), '%Y-%m-%d') END AS date_fin,
       'n' || c_custkey AS iu_nd_amont, 'n' || (c_custkey + 1) AS iu_nd_aval,
       CASE WHEN road % 11 <> 9 THEN CAST(lon_e4 AS DOUBLE) / 1e4 END AS lon,
       CASE WHEN road % 11 <> 9 THEN CAST(lat_e4 AS DOUBLE) / 1e4 END AS lat,
       CASE WHEN road % 17 = 8 THEN 'none' WHEN road % 13 = 5 THEN 'Point' ELSE 'LineString' END AS shape,
       CASE WHEN road % 17 = 8 OR road % 13 = 5 THEN 0 WHEN road % 13 = 6 THEN 1 WHEN road % 13 = 7 THEN 2 ELSE 3 END AS n_points,
       CAST(lon_e4 AS DOUBLE) / 1e4 AS lon1, CAST(lat_e4 AS DOUBLE) / 1e4 AS lat1,
       CAST(lon_e4 + 10 AS DOUBLE) / 1e4 AS lon2, CAST(lat_e4 + 5 AS DOUBLE) / 1e4 AS lat2,
       CAST(lon_e4 + 25 AS DOUBLE) / 1e4 AS lon3, CAST(lat_e4 + 2 AS DOUBLE) / 1e4 AS lat3
FROM ref_base""")
LENGTH = (f"CASE WHEN n_points >= 2 THEN {great_circle('lon1', 'lat1', 'lon2', 'lat2')} "
          f"+ CASE WHEN n_points = 3 THEN {great_circle('lon2', 'lat2', 'lon3', 'lat3')} ELSE 0 END END")
SHAPE = """CASE WHEN shape = 'none' THEN NULL
     WHEN shape = 'Point' THEN '{"type":"Feature","geometry":{"type":"Point"}}'
     ELSE '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[' || lon1 || ',' || lat1 || ']'
          || CASE WHEN n_points > 1 THEN ',[' || lon2 || ',' || lat2 || ']' ELSE '' END
          || CASE WHEN n_points > 2 THEN ',[' || lon3 || ',' || lat3 || ']' ELSE '' END || ']}}' END"""
view("road_reference", f"""
SELECT iu_ac, libelle, {day_text('date_debut')} AS date_debut, {day_text('date_fin')} AS date_fin, iu_nd_amont, iu_nd_aval,
       CASE WHEN lon IS NOT NULL THEN '{{"lon":' || lon || ',"lat":' || lat || '}}' END AS geo_point_2d,
       {SHAPE} AS geo_shape, lon AS longitude, lat AS latitude, round({LENGTH}, 3) AS road_length_m
FROM ref_raw r
WHERE NOT EXISTS (SELECT 1 FROM ref_raw n WHERE n.iu_ac = r.iu_ac AND r.date_debut <> 'unknown'
                  AND (n.date_debut = 'unknown' OR n.date_debut > r.date_debut))""")
view("segments", "SELECT iu_ac, libelle, latitude, longitude, road_length_m, geo_shape FROM road_reference")

view("events_base", f"""
SELECT *, {place('100 * (c % 3)', '150 * (c % 5)')},
       TIMESTAMP '2024-01-01' + to_hours(CAST((c * 37) % 720 AS INTEGER)) AS s,
       CASE WHEN c % 23 = 0 THEN -5
            ELSE c % 30 + 24 * (CASE WHEN c % 10 = 0 THEN 45 ELSE 0 END + CASE WHEN c % 50 = 0 THEN 400 ELSE 0 END) END AS len
FROM (SELECT c_custkey AS c, c_name, c_custkey // 60 AS road FROM customer)""")


def iso(time: str) -> str:
    return f"(strftime({time}, '%Y-%m-%dT%H:%M:%S') || '+00:00')"


ONE = f"({iso('s')} || '_' || {iso('s + to_hours(CAST(1 + c % 5 AS INTEGER))')})"
TWO = f"({iso('s + INTERVAL 24 HOUR')} || '_' || {iso('s + INTERVAL 26 HOUR')})"
view("events_one", f"""
SELECT c, 'ev-' || c AS event_id, c_name AS title,
       CASE WHEN c % 41 = 3 THEN 'unknown' ELSE {iso('s')} END AS date_start,
       CASE WHEN c % 43 <> 5 THEN {iso('s + to_hours(CAST(len AS INTEGER))')} END AS date_end,
       CASE WHEN c % 4 = 1 THEN {ONE} WHEN c % 4 = 2 THEN {ONE} || '; ' || {TWO} || ';' || {ONE} || ';'
            WHEN c % 8 = 3 THEN 'tbd;morning_evening' WHEN c % 8 = 7 THEN '   ' END AS occurrences,
       CASE WHEN c % 19 <> 7 THEN CAST(lon_e4 AS DOUBLE) / 1e4 END AS lon,
       CASE WHEN c % 19 <> 7 THEN CAST(lat_e4 AS DOUBLE) / 1e4 END AS lat
FROM events_base""")
view("events_raw", """
SELECT * FROM events_one UNION ALL
SELECT * REPLACE (title || ' (bis)' AS title) FROM events_one WHERE c % 15 = 0""")
view("city_events", f"""
SELECT * FROM (SELECT event_id, title, CAST({utc_text('date_start')} AS TIMESTAMP) AS date_start,
                      CAST({utc_text('date_end')} AS TIMESTAMP) AS date_end, occurrences, lat AS latitude, lon AS longitude
               FROM events_raw)
WHERE date_start IS NOT NULL AND date_end IS NOT NULL AND title NOT LIKE '%(bis)'""")
view("pieces", """
SELECT event_id, title, latitude, longitude, trim(unnest(string_split(occurrences, ';'))) AS piece
FROM city_events WHERE trim(coalesce(occurrences, '')) <> ''""")
view("occurrence_rows", f"""
SELECT event_id, title,
       CAST({utc_text("split_part(piece, '_', 1)")} AS TIMESTAMP) AS occurrence_start,
       CAST({utc_text("split_part(piece, '_', 2)")} AS TIMESTAMP) AS occurrence_end, latitude, longitude
FROM pieces WHERE contains(piece, '_')
UNION ALL
SELECT event_id, title, date_start, date_end, latitude, longitude
FROM city_events WHERE trim(coalesce(occurrences, '')) = '' AND date_end - date_start <= INTERVAL 24 HOUR""")
view("occurrences_of", """
SELECT DISTINCT event_id, title, occurrence_start, occurrence_end, latitude, longitude
FROM occurrence_rows
WHERE occurrence_start IS NOT NULL AND occurrence_end IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL""")
view("weather", """
SELECT CASE WHEN e % 17 = 0 THEN timestamp_utc + to_days(3650) ELSE timestamp_utc END AS timestamp_utc,
       CAST(e % 300 AS DOUBLE) / 1e1 AS temperature_2m, CAST(40 + n % 60 AS DOUBLE) AS relative_humidity_2m,
       CAST(lo % 50 AS DOUBLE) / 1e1 AS precipitation, CAST(lo % 50 AS DOUBLE) / 2e1 AS rain,
       CAST(u % 40 AS DOUBLE) AS wind_speed_10m, CAST(e % 4 AS INTEGER) AS weather_code
FROM (SELECT date_trunc('hour', ts) AS timestamp_utc, count(*) AS n, max(event_id) AS e, min(event_id) AS lo, max(user_id) AS u
      FROM events GROUP BY 1)""")
view("predictions", """
SELECT iu_ac, timestamp_utc AS prediction_timestamp_utc, timestamp_utc + to_hours(h) AS target_timestamp_utc,
       CAST(h AS INTEGER) AS horizon_hours, k AS predicted_k,
       CASE WHEN eid % 5 <> 0 AND eid % 7 = 0 THEN 'beta' ELSE CAST(1 + eid % 2 AS VARCHAR) END AS model_version,
       eid * 10 + h AS first_write
FROM obs_keyed, (VALUES (1), (2), (3)) t(h) WHERE k IS NOT NULL
UNION ALL
SELECT iu_ac, timestamp_utc, timestamp_utc + to_hours(h), CAST(h AS INTEGER), k + 1, '9', eid * 10 + h + 5
FROM obs_keyed, (VALUES (1), (2), (3)) t(h) WHERE k IS NOT NULL AND eid % 5 = 0""")
view("training_runs", """
SELECT 'congestion-' || (1 + c_custkey % 3) || 'h' AS model_name, CAST(1 + c_custkey % 3 AS INTEGER) AS horizon_hours,
       CAST(1 + c_custkey // 3 AS INTEGER) AS version, 'run-' || (c_custkey // 6) AS run_id,
       CASE c_custkey % 5 WHEN 0 THEN 'champion' WHEN 1 THEN 'candidate' END AS alias,
       CASE WHEN c_custkey % 7 = 0 THEN 'FAILED' ELSE 'FINISHED' END AS status,
       TIMESTAMP '2024-01-01' + to_minutes(CAST(c_custkey AS INTEGER)) AS started_at,
       CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 700 AS INTEGER)) END AS dataset_max_timestamp
FROM customer""")

LAGGED = ", ".join(
    f"l{n}.q AS q_lag_{n}h, l{n}.k AS k_lag_{n}h" for n in (1, 2, 24))
LAG_JOINS = " ".join(
    f"LEFT JOIN obs l{n} ON l{n}.iu_ac = o.iu_ac AND l{n}.timestamp_utc = o.timestamp_utc - INTERVAL {n} HOUR" for n in (1, 2, 24))
TARGETS = ", ".join(f"t{n}.k AS target_k_{n}h" for n in (1, 2, 3))
TARGET_JOINS = " ".join(
    f"LEFT JOIN obs t{n} ON t{n}.iu_ac = o.iu_ac AND t{n}.timestamp_utc = o.timestamp_utc + INTERVAL {n} HOUR" for n in (1, 2, 3))
view("lagged", f"SELECT o.*, {LAGGED} FROM obs o {LAG_JOINS}")
view("targeted", f"SELECT o.*, {TARGETS} FROM obs o {TARGET_JOINS}")
view("road_stats", "SELECT iu_ac, count(*) AS n_observations, count(q) AS n_valid_q, count(k) AS n_valid_k FROM obs GROUP BY 1")
view("candidates", """
SELECT *, n_valid_q / n_observations AS valid_q_ratio, n_valid_k / n_observations AS valid_k_ratio FROM road_stats
WHERE n_observations >= 240 AND n_valid_q / n_observations >= CAST(0.85 AS DOUBLE)
  AND n_valid_k / n_observations >= CAST(0.85 AS DOUBLE)""")
view("eligible", """
SELECT c.*, latitude, longitude, road_length_m, geo_shape FROM candidates c JOIN segments USING (iu_ac)
WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND road_length_m IS NOT NULL AND geo_shape IS NOT NULL""")
view("earlier_obs", """
SELECT * FROM obs WHERE CAST(iu_ac AS BIGINT) % 6 <> 2
  AND timestamp_utc <= TIMESTAMP '2024-01-20' + to_hours(CAST(CAST(iu_ac AS BIGINT) % 48 AS INTEGER))""")
view("cursor_of", """
SELECT iu_ac, (SELECT max(timestamp_utc) FROM earlier_obs e WHERE e.iu_ac = r.iu_ac) AS latest_timestamp
FROM (SELECT DISTINCT iu_ac FROM obs) r""")
view("previous", "SELECT *, lag(timestamp_utc) OVER (PARTITION BY iu_ac ORDER BY timestamp_utc) AS previous_time FROM obs")
view("cutoff_at", """
SELECT timestamp_utc AS cutoff FROM (
  SELECT timestamp_utc, row_number() OVER (ORDER BY timestamp_utc) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT timestamp_utc FROM obs))
WHERE i = least(greatest(CAST(floor(CAST(n AS DOUBLE) * CAST(0.8 AS DOUBLE)) AS BIGINT), 1), n - 1)""")
view("version_errors", """
SELECT h AS horizon_hours, version, k, actual,
       CASE version WHEN '1' THEN k WHEN '2' THEN 5e-1 * k + 8 WHEN '3' THEN 25e-2 * k + 13 ELSE k + 10 END AS predicted
FROM (SELECT k, 1 AS h, target_k_1h AS actual FROM targeted WHERE timestamp_utc >= (SELECT cutoff FROM cutoff_at)
      UNION ALL SELECT k, 2, target_k_2h FROM targeted WHERE timestamp_utc >= (SELECT cutoff FROM cutoff_at)
      UNION ALL SELECT k, 3, target_k_3h FROM targeted WHERE timestamp_utc >= (SELECT cutoff FROM cutoff_at)),
     (VALUES ('1'), ('2'), ('3'), ('4')) t(version)
WHERE k IS NOT NULL AND actual IS NOT NULL""")
view("version_metrics", """
SELECT CAST(horizon_hours AS INTEGER) AS horizon_hours, version, avg(abs(actual - predicted)) AS mae,
       sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, count(*) AS n_samples
FROM version_errors GROUP BY 1, 2""")


def local_fields(source: str) -> str:
    return f"""
SELECT *, CAST(hour(timestamp_paris) AS INTEGER) AS hour, CAST(isodow(timestamp_paris) - 1 AS INTEGER) AS day_of_week,
       CAST(day(timestamp_paris) AS INTEGER) AS day_of_month, CAST(month(timestamp_paris) AS INTEGER) AS month,
       isodow(timestamp_paris) >= 6 AS is_weekend
FROM (SELECT *, {paris('timestamp_utc')} AS timestamp_paris FROM {source})"""


view("local_obs", local_fields("obs"))
# Holidays of 2024 and 2025 and, for the orders, 1994 to 2002: the movable ones listed.
view("easter", """
SELECT CAST(d AS DATE) AS d FROM (VALUES ('1994-04-03'), ('1995-04-16'), ('1996-04-07'), ('1997-03-30'), ('1998-04-12'),
  ('1999-04-04'), ('2000-04-23'), ('2001-04-15'), ('2002-03-31'), ('2023-04-09'), ('2024-03-31'), ('2025-04-20')) t(d)""")
view("holiday", """
SELECT CAST(year(d) || '-' || md AS DATE) AS d
FROM easter, (VALUES ('01-01'), ('05-01'), ('05-08'), ('07-14'), ('08-15'), ('11-01'), ('11-11'), ('12-25')) t(md)
UNION SELECT d + 1 FROM easter UNION SELECT d + 39 FROM easter UNION SELECT d + 50 FROM easter""")


def holiday_flags(source: str) -> str:
    known = f"(SELECT d FROM holiday WHERE year(d) IN (SELECT DISTINCT year(timestamp_paris) FROM {source}))"
    return f"""
SELECT *, CAST(timestamp_paris AS DATE) IN {known} AS is_public_holiday,
       CAST(timestamp_paris AS DATE) + 1 IN {known} AS is_day_before_public_holiday,
       CAST(timestamp_paris AS DATE) - 1 IN {known} AS is_day_after_public_holiday FROM {source}"""


view("order_times", f"SELECT o_orderkey, o_orderdate AS timestamp_utc, {paris('o_orderdate')} AS timestamp_paris FROM orders")
view("holiday_obs", holiday_flags("local_obs"))
WEATHER_AHEAD = ", ".join(f"w.{c} AS {c}_target_1h" for c in (
    "temperature_2m", "relative_humidity_2m", "precipitation", "rain", "wind_speed_10m", "weather_code"))
view("traffic_features", f"""
SELECT o.*, CAST(o.timestamp_paris AS DATE) BETWEEN DATE '2025-07-05' AND DATE '2025-08-31' AS is_school_holiday,
       {WEATHER_AHEAD}, latitude, longitude, road_length_m, {LAGGED}, t1.k AS target_k_1h
FROM holiday_obs o LEFT JOIN weather w ON w.timestamp_utc = o.timestamp_utc + INTERVAL 1 HOUR
LEFT JOIN road_reference r ON r.iu_ac = o.iu_ac {LAG_JOINS}
LEFT JOIN obs t1 ON t1.iu_ac = o.iu_ac AND t1.timestamp_utc = o.timestamp_utc + INTERVAL 1 HOUR""")
FEATURE_NAMES = ("q, k, hour, day_of_week, is_weekend, q_lag_1h, k_lag_1h, q_lag_2h, k_lag_2h, q_lag_24h, k_lag_24h, "
                 "temperature_2m_target_1h, relative_humidity_2m_target_1h, precipitation_target_1h, rain_target_1h, "
                 "wind_speed_10m_target_1h, weather_code_target_1h, latitude, longitude, road_length_m, target_k_1h")
view("ml_dataset", f"SELECT iu_ac, timestamp_utc, {FEATURE_NAMES} FROM traffic_features WHERE target_k_1h IS NOT NULL")
DISTANCE = great_circle("r.longitude", "r.latitude", "e.longitude", "e.latitude")
view("near", f"""
SELECT r.iu_ac, e.event_id, e.occurrence_start, e.occurrence_end, {DISTANCE} AS distance_m
FROM road_reference r JOIN occurrences_of e ON {DISTANCE} <= 5000""")
view("event_counts", """
SELECT o.iu_ac, o.timestamp_utc, CAST(coalesce(sum(
         CASE WHEN n.occurrence_start <= o.timestamp_utc + INTERVAL 1 HOUR THEN 1 ELSE 0 END
         - CASE WHEN n.occurrence_end < o.timestamp_utc + INTERVAL 1 HOUR THEN 1 ELSE 0 END), 0) AS INTEGER) AS n
FROM obs o LEFT JOIN near n ON n.iu_ac = o.iu_ac GROUP BY 1, 2""")
view("latest_per_horizon", """
SELECT * FROM predictions p WHERE prediction_timestamp_utc = (
  SELECT max(prediction_timestamp_utc) FROM predictions m WHERE m.horizon_hours = p.horizon_hours)""")
view("current_predictions", """
SELECT * FROM latest_per_horizon QUALIFY row_number() OVER (PARTITION BY horizon_hours, iu_ac ORDER BY first_write DESC) = 1""")
view("traffic_delivery", """
SELECT iu_ac, timestamp_utc, CASE WHEN eid % 4 <> 0 THEN q + 1 END AS q, CASE WHEN eid % 6 <> 0 THEN k END AS k
FROM obs_keyed WHERE timestamp_utc >= TIMESTAMP '2024-01-24' OR eid % 3 = 0""")
view("new_segments", "SELECT * REPLACE (libelle || ' *' AS libelle) FROM segments WHERE CAST(iu_ac AS BIGINT) % 4 <> 1")
view("bulk_rows", """
SELECT iu_ac, timestamp_utc, q, k FROM bulk_normal WHERE iu_ac IN (SELECT iu_ac FROM road_reference)
QUALIFY row_number() OVER (PARTITION BY iu_ac, timestamp_utc ORDER BY event_id DESC) = 1""")

# --- sources and sinks -------------------------------------------------------------------

RECORD = "b.iu_ac, r.libelle, b.t_1h, b.q, b.k, r.etat_trafic, r.etat_barre, r.iu_nd_amont, r.iu_nd_aval"
sql("src_traffic_pages", f"SELECT {RECORD} FROM bulk b JOIN obs_raw r USING (event_id)")
sql("src_road_reference_pages", """
SELECT iu_ac, libelle, date_debut, date_fin, iu_nd_amont, iu_nd_aval, lon, lat FROM ref_raw
WHERE iu_ac IN (SELECT iu_ac FROM obs)""")
sql("src_event_pages", "SELECT event_id, title, date_start, date_end, occurrences, lon, lat FROM events_raw")
sql("src_weather_payload", "SELECT * FROM weather")
sql("scan_bulk_parquet", "SELECT iu_ac, t_1h, q, k FROM bulk")
sql("scan_parquet", "SELECT * FROM customer")
sql("sink_parquet", "SELECT *, strftime(timestamp_utc, '%Y-%m') AS month FROM obs")
sql("union_sources", """
SELECT iu_ac, timestamp_utc, q, k FROM obs WHERE k >= 15
UNION ALL SELECT iu_ac, timestamp_utc, NULL, k FROM obs WHERE k < 15""")
sql("capped_per_road", "SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY iu_ac ORDER BY timestamp_utc) <= 200")
sql("ingest_traffic", f"""
SELECT b.iu_ac, b.t_1h, CAST({utc_text('b.t_1h')} AS TIMESTAMP) AS timestamp_utc, b.q, b.k, c.geo_point_2d
FROM bulk b JOIN obs_clean c USING (event_id)""")
sql("ingest_weather", "SELECT * FROM weather")
sql("ingest_events", "SELECT * FROM city_events")
FLAGS = """coalesce(regexp_full_match(iu_ac, '[0-9]+'), false) AS is_valid_iu_ac, q IS NOT NULL AS has_q, k IS NOT NULL AS has_k,
       q IS NOT NULL AND k IS NOT NULL AS has_complete_measurement,
       coalesce(etat_barre = 'Invalide', false) AS is_invalid_road_state,
       coalesce(etat_trafic = 'Inconnu', false) AS is_unknown_traffic_state"""
sql("process_traffic_file", f"""
SELECT c.*, r.libelle, r.t_1h, {paris('timestamp_utc')} AS timestamp_paris
FROM (SELECT *, {FLAGS} FROM obs_clean) c JOIN obs_raw r USING (event_id)""")
sql("load_traffic_table", "SELECT * FROM obs")

# --- projections, normalisation, predicates -------------------------------------------------

sql("normalize_traffic", f"""
SELECT event_id, r.iu_ac, timestamp_utc, c.q, c.k, geo_point_2d, CAST(NULL AS VARCHAR) AS geo_shape
FROM obs_clean c JOIN obs_raw r USING (event_id)""")
sql("clean_traffic", f"SELECT * EXCLUDE (etat_trafic, etat_barre), {paris('timestamp_utc')} AS timestamp_paris FROM obs_clean")
sql("normalize_json_text", "SELECT event_id, geo_point_2d, geo_shape, CAST(NULL AS VARCHAR) AS geo_number FROM obs_clean")
sql("utc_to_local", f"SELECT iu_ac, timestamp_utc, {paris('timestamp_utc')} AS timestamp_paris FROM obs")
sql("normalize_utc", "SELECT event_id, timestamp_utc FROM obs_clean")
sql("quality_flags", f"SELECT event_id, {FLAGS} FROM obs_clean")
sql("quality_counts", """
SELECT count(*) AS n_rows, count(*) FILTER (NOT coalesce(regexp_full_match(iu_ac, '[0-9]+'), false)) AS n_invalid_iu_ac,
       count(*) - count(k) AS n_missing_k, count(*) - count(q) AS n_missing_q,
       count(*) FILTER (q IS NOT NULL AND k IS NOT NULL) AS n_complete FROM obs_clean""")
sql("normalize_bulk", "SELECT iu_ac, timestamp_utc, q, k FROM bulk_normal")
sql("filter_eligible_ids", "SELECT * FROM obs WHERE iu_ac IN (SELECT iu_ac FROM road_reference)")
sql("normalize_events", "SELECT * FROM city_events")
sql("explode_occurrences", "SELECT * FROM occurrences_of")
sql("normalize_road_reference", "SELECT * FROM road_reference")
sql("latest_version_per_road", "SELECT iu_ac, libelle, date_debut, date_fin FROM road_reference")
sql("dedupe_keep_last", """
SELECT event_id, iu_ac, timestamp_utc, q, k FROM obs_clean WHERE iu_ac IS NOT NULL AND timestamp_utc IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY iu_ac, timestamp_utc ORDER BY event_id DESC) = 1""")
sql("sync_reference_projection", "SELECT * FROM segments")
sql("filter_complete", "SELECT * FROM obs WHERE q IS NOT NULL AND k IS NOT NULL")
sql("filter_road", """
SELECT * FROM obs WHERE iu_ac = '1' AND q IS NOT NULL AND k IS NOT NULL""")
sql("distinct_ids", "SELECT DISTINCT iu_ac FROM obs_clean WHERE iu_ac IS NOT NULL")
sql("incomplete_rows", """
SELECT event_id, iu_ac, timestamp_utc, q, k, etat_trafic, etat_barre FROM obs_clean WHERE q IS NULL OR k IS NULL""")
sql("congested_rows", f"SELECT iu_ac, {paris('timestamp_utc')} AS timestamp_paris, q, k FROM obs WHERE k >= 15")
sql("congestion_class", """
SELECT *, CASE WHEN k < 15 THEN 'fluid' WHEN k < 30 THEN 'pre-saturated' WHEN k < 50 THEN 'saturated'
               WHEN k >= 50 THEN 'blocked' END AS congestion FROM obs""")

# --- joins ----------------------------------------------------------------------------------

sql("traffic_lags", "SELECT * FROM lagged")
sql("traffic_targets", "SELECT * FROM targeted")
sql("traffic_target_single", "SELECT iu_ac, timestamp_utc, q, k, target_k_2h FROM targeted")
sql("weather_features", f"""
SELECT o.*, {WEATHER_AHEAD} FROM obs o LEFT JOIN weather w ON w.timestamp_utc = o.timestamp_utc + INTERVAL 1 HOUR""")
sql("road_features", """
SELECT o.*, latitude, longitude, road_length_m FROM obs o LEFT JOIN road_reference r ON r.iu_ac = o.iu_ac""")
sql("event_features", """
SELECT iu_ac, timestamp_utc, n AS event_count_nearby_target_1h,
       CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS TINYINT) AS has_event_nearby_target_1h FROM event_counts""")
sql("stats_reference_join", """
SELECT s.*, latitude, longitude, road_length_m, geo_shape FROM road_stats s JOIN segments USING (iu_ac)""")
sql("reference_for_eligible", "SELECT * FROM road_reference WHERE iu_ac IN (SELECT iu_ac FROM eligible)")
sql("roads_not_in_reference", "SELECT iu_ac, libelle FROM segments WHERE iu_ac NOT IN (SELECT iu_ac FROM eligible)")
sql("new_vs_known_roads", "SELECT iu_ac, iu_ac IN (SELECT iu_ac FROM obs) AS is_known FROM road_reference")
sql("missing_road_ids", "SELECT DISTINCT iu_ac FROM obs WHERE iu_ac NOT IN (SELECT iu_ac FROM road_reference)")
sql("events_overlapping_period", """
SELECT period_start, period_end, (SELECT count(*) FROM city_events WHERE date_start <= period_end AND date_end >= period_start) AS n_events
FROM (VALUES (TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-07 23:00:00'),
             (TIMESTAMP '2024-01-15 00:00:00', TIMESTAMP '2024-01-15 12:00:00'),
             (TIMESTAMP '2025-06-01 00:00:00', TIMESTAMP '2025-06-30 00:00:00')) t(period_start, period_end)""")
sql("cursor_filter", """
SELECT o.* FROM obs o JOIN cursor_of c USING (iu_ac) WHERE latest_timestamp IS NULL OR timestamp_utc > latest_timestamp""")

# --- aggregations, profiles, selection ---------------------------------------------------------

sql("road_statistics", """
SELECT iu_ac, count(*) AS n_observations, count(q) AS n_valid_q, count(k) AS n_valid_k
FROM obs_clean WHERE regexp_full_match(iu_ac, '[0-9]+') GROUP BY 1""")
sql("eligible_roads", """
SELECT * REPLACE (round(valid_q_ratio, 6) AS valid_q_ratio, round(valid_k_ratio, 6) AS valid_k_ratio,
                  round(road_length_m, 6) AS road_length_m)
FROM (SELECT * EXCLUDE (road_length_m, len), x.len AS road_length_m FROM eligible JOIN (
        SELECT iu_ac, """ + LENGTH + """ AS len FROM ref_raw JOIN (SELECT iu_ac, iu_nd_amont FROM road_reference) USING (iu_ac, iu_nd_amont)) x USING (iu_ac))""")
sql("candidate_roads", """
SELECT * REPLACE (round(valid_q_ratio, 6) AS valid_q_ratio, round(valid_k_ratio, 6) AS valid_k_ratio) FROM candidates""")
sql("top_roads_by_coverage", """
SELECT iu_ac, observations, k_available, round(k_available / observations, 6) AS k_coverage FROM (
  SELECT iu_ac, count(*) AS observations, count(k) AS k_available FROM obs_clean GROUP BY 1)
WHERE regexp_full_match(iu_ac, '[0-9]+') AND k_available / observations >= CAST(0.7 AS DOUBLE)
ORDER BY k_available DESC, iu_ac LIMIT 20""")
sql("observations_per_road", "SELECT iu_ac, count(*) AS n_observations FROM obs_clean GROUP BY 1")
sql("coverage_ratio", """
SELECT *, round(n_observations / (SELECT max(n_observations) FROM road_stats), 6) AS coverage_ratio FROM road_stats""")
sql("threshold_counts", """
SELECT CAST(threshold AS BIGINT) AS threshold, (SELECT count(*) FROM road_stats WHERE n_observations < threshold) AS n_roads
FROM (VALUES (1), (24), (168), (1000), (5000), (9000), (9700)) t(threshold)""")
sql("smallest_roads", "SELECT * FROM road_stats ORDER BY n_observations, iu_ac LIMIT 20")
sql("describe_numeric", """
SELECT count(n_observations) AS count, round(avg(n_observations), 6) AS mean, round(stddev_samp(n_observations), 6) AS std,
       CAST(min(n_observations) AS DOUBLE) AS min, round(quantile_cont(n_observations, 0.25), 6) AS p25,
       round(quantile_cont(n_observations, 0.5), 6) AS p50, round(quantile_cont(n_observations, 0.75), 6) AS p75,
       CAST(max(n_observations) AS DOUBLE) AS max FROM road_stats""")
sql("distinct_roads", "SELECT count(DISTINCT iu_ac) AS n_roads FROM obs")
sql("null_profile", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing FROM obs_clean" for c in (
        "iu_ac", "timestamp_utc", "q", "k", "etat_trafic", "etat_barre", "date_debut", "date_fin", "geo_point_2d", "geo_shape")))
sql("time_range", "SELECT min(timestamp_utc) AS min_timestamp, max(timestamp_utc) AS max_timestamp FROM obs")
sql("versions_per_road", "SELECT iu_ac, count(*) AS n_versions FROM ref_raw GROUP BY 1")
GAP = "(epoch_us(timestamp_utc) - epoch_us(previous_time)) / 3600000000"
sql("gap_histogram", f"""
SELECT {GAP} AS gap_hours, count(*) AS n FROM previous WHERE previous_time IS NOT NULL GROUP BY 1""")
sql("gaps_over_1h", f"SELECT *, {GAP} AS gap_hours FROM previous WHERE {GAP} > 1")
sql("gap_context", """
SELECT iu_ac, timestamp_utc, q, k, gap_time, CAST(i - g AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY iu_ac ORDER BY timestamp_utc) AS i FROM obs)
JOIN (SELECT iu_ac, timestamp_utc AS gap_time, i AS g FROM (
        SELECT *, row_number() OVER (PARTITION BY iu_ac ORDER BY timestamp_utc) AS i FROM previous)
      WHERE timestamp_utc - previous_time > INTERVAL 1 HOUR
      QUALIFY row_number() OVER (PARTITION BY iu_ac ORDER BY timestamp_utc) = 1) USING (iu_ac)
WHERE i - g BETWEEN -2 AND 2""")
sql("complete_count", "SELECT count(*) AS n_rows, count(*) FILTER (q IS NOT NULL AND k IS NOT NULL) AS n_complete FROM obs")
HOURS_LONG = "(epoch_us(date_end) - epoch_us(date_start)) / 1000000 / 3600"
sql("event_duration_profile", f"""
SELECT count(*) AS n_events, count(occurrences) AS n_with_occurrences, count(*) - count(occurrences) AS n_without_occurrences,
       count(*) FILTER (h <= 24) AS n_up_to_24h, count(*) FILTER (h > 24) AS n_over_24h, count(*) FILTER (h > 168) AS n_over_7d,
       count(*) FILTER (h > 720) AS n_over_30d, count(*) FILTER (h > 8760) AS n_over_365d
FROM (SELECT *, {HOURS_LONG} AS h FROM city_events)""")
sql("longest_events", f"""
SELECT event_id, title, date_start, date_end, round({HOURS_LONG}, 6) AS duration_hours, occurrences
FROM city_events ORDER BY {HOURS_LONG} DESC, event_id, date_start LIMIT 10""")
sql("rows_without_match", """
SELECT count(*) AS n_rows, count(*) FILTER (latitude IS NULL AND longitude IS NULL AND road_length_m IS NULL) AS n_without_match,
       'road' AS source FROM traffic_features
UNION ALL SELECT count(*), count(*) FILTER (NOT EXISTS (
  SELECT 1 FROM weather w WHERE w.timestamp_utc = o.timestamp_utc + INTERVAL 1 HOUR)), 'weather' FROM obs o""")
sql("targets_available", "\nUNION ALL ".join(
    f"SELECT 'target_k_{n}h' AS target, count(target_k_{n}h) AS n_available FROM targeted" for n in (1, 2, 3)))
sql("systematic_sample", """
SELECT iu_ac, timestamp_utc, q, k FROM (
  SELECT *, row_number() OVER (ORDER BY timestamp_utc, iu_ac) - 1 AS i, greatest(count(*) OVER () // 2000, 1) AS step FROM obs)
WHERE i % step = 0 AND i < step * 2000""")
sql("page_overlap", "SELECT iu_ac FROM road_stats INTERSECT SELECT iu_ac FROM road_reference")
sql("event_coverage", """
SELECT count(*) AS n_rows, round(avg(CASE WHEN n > 0 THEN 1e0 ELSE 0e0 END) * 100, 6) AS event_coverage_pct
FROM event_counts WHERE timestamp_utc > TIMESTAMP '2024-01-24'""")
sql("bulk_import_counts", """
SELECT file_name, CAST(sum(n) AS BIGINT) AS source_rows, CAST(sum(n_ok) AS BIGINT) AS eligible_rows, count(*) FILTER (n_ok > 0) AS upserted_rows
FROM (SELECT 'export-' || (b.event_id % 4) || '.parquet' AS file_name, count(*) AS n, count(o.event_id) AS n_ok
      FROM bulk b LEFT JOIN (SELECT * FROM bulk_normal WHERE iu_ac IN (SELECT iu_ac FROM road_reference)) o ON o.event_id = b.event_id
      GROUP BY 1, o.iu_ac, o.timestamp_utc)
GROUP BY ROLLUP (file_name)""")

# --- calendar and time ---------------------------------------------------------------------------

sql("time_features", "SELECT * EXCLUDE (q, k) FROM local_obs")
sql("public_holiday_features", holiday_flags("order_times"))
sql("school_holiday_features", """
SELECT o_orderkey, timestamp_paris + INTERVAL 27 YEAR AS timestamp_paris,
       CAST(timestamp_paris + INTERVAL 27 YEAR AS DATE) BETWEEN DATE '2025-07-05' AND DATE '2025-08-31' AS is_school_holiday
FROM order_times""")
sql("target_timestamp", "SELECT *, timestamp_utc + INTERVAL 3 HOUR AS target_timestamp_utc FROM obs")

# --- geometry ----------------------------------------------------------------------------------------

sql("haversine_m", f"""
SELECT event_id, date_start, date_end, round({great_circle('225e-2', '488e-1', 'longitude', 'latitude')}, 3) AS distance_m
FROM city_events WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
sql("haversine_pairs", f"""
SELECT r.iu_ac, r.latitude, r.longitude, e.latitude AS venue_latitude, e.longitude AS venue_longitude,
       round({DISTANCE}, 3) AS distance_m
FROM road_reference r JOIN (SELECT DISTINCT latitude, longitude FROM occurrences_of) e ON {DISTANCE} <= 5000""")
sql("linestring_length", f"SELECT iu_nd_amont, round({LENGTH}, 3) AS road_length_m FROM ref_raw")
sql("event_radius_pairs", "SELECT * REPLACE (round(distance_m, 3) AS distance_m) FROM near")
sql("active_interval_count", f"""
SELECT o.iu_ac, o.timestamp_utc, CAST(coalesce(sum(CASE WHEN s <= timestamp_utc THEN 1 ELSE 0 END
       - CASE WHEN e < timestamp_utc THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_active
FROM obs o LEFT JOIN (
  SELECT CAST(c // 60 AS VARCHAR) AS iu_ac, CAST({utc_text('date_start')} AS TIMESTAMP) AS s, CAST({utc_text('date_end')} AS TIMESTAMP) AS e
  FROM events_raw) i ON i.iu_ac = o.iu_ac AND s IS NOT NULL AND e IS NOT NULL
GROUP BY 1, 2""")

# --- feature and dataset jobs ----------------------------------------------------------------------------

sql("build_traffic_features", "SELECT * FROM traffic_features")
sql("build_ml_dataset", "SELECT * FROM ml_dataset")
sql("make_training_dataset", f"""
SELECT *, {paris('timestamp_utc')} AS timestamp_paris FROM obs
WHERE timestamp_utc >= (SELECT max(timestamp_utc) FROM obs) - INTERVAL 240 HOUR""")
view("training_rows", f"""
SELECT o.*, latitude, longitude, road_length_m, {LAGGED}, {TARGETS}
FROM local_obs o JOIN road_reference r ON r.iu_ac = o.iu_ac {LAG_JOINS} {TARGET_JOINS}""")
sql("build_training_features", "SELECT * FROM training_rows")
view("window_obs", "SELECT * FROM obs WHERE timestamp_utc >= (SELECT max(timestamp_utc) FROM obs) - INTERVAL 48 HOUR")
view("window_local", local_fields("window_obs"))
sql("build_prediction_features", f"""
SELECT o.*, latitude, longitude, road_length_m, {LAGGED}
FROM window_local o JOIN road_reference r ON r.iu_ac = o.iu_ac {LAG_JOINS.replace('JOIN obs', 'JOIN window_obs')}""")
sql("multi_road_dataset", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing FROM traffic_features" for c in [
        *[w.split(" AS ")[1] for w in WEATHER_AHEAD.split(", ")], "latitude", "longitude", "road_length_m",
        *[x.split(" AS ")[1] for x in LAGGED.split(", ")], "target_k_1h"]))
sql("multi_road_rows", "SELECT * FROM ml_dataset")
sql("multi_road_coverage", """
SELECT iu_ac, count(*) AS n_observations, (SELECT count(*) FROM ml_dataset d WHERE d.iu_ac = o.iu_ac) AS n_rows,
       iu_ac NOT IN (SELECT iu_ac FROM ml_dataset) AS dropped
FROM obs o GROUP BY 1""")
sql("excluded_roads", """
SELECT DISTINCT iu_ac FROM obs EXCEPT SELECT iu_ac FROM ml_dataset WHERE latitude IS NOT NULL""")

# --- split, metrics, gate -----------------------------------------------------------------------------------

sql("temporal_split", """
SELECT *, CASE WHEN timestamp_utc < (SELECT cutoff FROM cutoff_at) THEN 'train' ELSE 'test' END AS part FROM obs""")
sql("fixed_cutoff_split", """
SELECT *, CASE WHEN timestamp_utc <= TIMESTAMP '2024-01-24' THEN 'train' ELSE 'test' END AS part FROM obs""")
sql("persistence_baseline", """
SELECT horizon_hours, round(mae, 6) AS mae, round(rmse, 6) AS rmse, n_samples FROM version_metrics WHERE version = '1'""")
sql("regression_metrics", """
SELECT horizon_hours, version, round(mae, 6) AS mae, round(rmse, 6) AS rmse, n_samples FROM version_metrics""")
sql("evaluation_rows", """
SELECT * FROM targeted WHERE timestamp_utc >= (SELECT cutoff FROM cutoff_at) AND k IS NOT NULL AND target_k_2h IS NOT NULL""")
IMPROVEMENT = "CASE WHEN {r} = 0 THEN CASE WHEN {c} = 0 THEN 0e0 ELSE CAST('-Infinity' AS DOUBLE) END ELSE ({r} - {c}) / {r} * 100 END"
sql("improvement_pct", f"""
SELECT iu_ac, reference_mae, candidate_mae, round({IMPROVEMENT.format(r='reference_mae', c='candidate_mae')}, 5) AS improvement_pct
FROM (SELECT iu_ac,
        CASE WHEN CAST(iu_ac AS BIGINT) % 5 = 0 THEN 0e0 ELSE round(avg(abs(target_k_1h - k)), 6) END AS reference_mae,
        CASE WHEN CAST(iu_ac AS BIGINT) % 10 = 0 THEN 0e0 ELSE round(avg(abs(target_k_1h - (k * 5e-1 + 8))), 6) END AS candidate_mae
      FROM targeted WHERE k IS NOT NULL AND target_k_1h IS NOT NULL GROUP BY 1)""")
view("gate_aliases", """
SELECT * FROM (VALUES ('worse than persistence', 1, '4', '2'), ('first champion', 2, '2', NULL), ('same version', 3, '2', '2'),
  ('better than champion', 1, '3', '2'), ('worse than champion', 2, '1', '3'), ('equal to persistence', 3, '1', NULL))
  t(model_name, horizon_hours, cand, champ)""")


def gate(metric: str, margin: float, extra: str = "") -> str:
    vs_base = IMPROVEMENT.format(r=f"b.{metric}", c=f"c.{metric}")
    vs_champion = IMPROVEMENT.format(r=f"h.{metric}", c=f"c.{metric}")
    return f"""
SELECT CAST(horizon_hours AS INTEGER) AS horizon_hours, model_name, reason IN ('initial_champion', 'quality_gate_passed') AS promoted, reason,
       cand AS candidate_version,
       CASE WHEN reason IN ('initial_champion', 'quality_gate_passed') THEN cand
            WHEN reason <> 'baseline_gate_failed' THEN champ END AS champion_version, '{metric}' AS metric,
       round(b_mae, 5) AS baseline_mae, round(b_rmse, 5) AS baseline_rmse, round(c_mae, 5) AS candidate_mae, round(c_rmse, 5) AS candidate_rmse,
       round(CASE WHEN reason IN ('baseline_gate_failed', 'initial_champion') THEN NULL ELSE h_mae END, 5) AS champion_mae,
       round(CASE WHEN reason IN ('baseline_gate_failed', 'initial_champion') THEN NULL ELSE h_rmse END, 5) AS champion_rmse,
       round(vb, 5) AS baseline_improvement_pct,
       round(CASE WHEN reason = 'candidate_already_champion' THEN 0
                  WHEN reason IN ('quality_gate_passed', 'champion_gate_failed') THEN vc END, 5) AS champion_improvement_pct,
       n_samples AS evaluation_rows{extra}
FROM (SELECT *, CASE WHEN vb < 0 THEN 'baseline_gate_failed' WHEN champ IS NULL THEN 'initial_champion'
                     WHEN champ = cand THEN 'candidate_already_champion' WHEN vc >= {margin} THEN 'quality_gate_passed'
                     ELSE 'champion_gate_failed' END AS reason
      FROM (SELECT g.*, b.mae AS b_mae, b.rmse AS b_rmse, c.mae AS c_mae, c.rmse AS c_rmse, h.mae AS h_mae, h.rmse AS h_rmse,
                   b.n_samples, {vs_base} AS vb, {vs_champion} AS vc
            FROM gate_aliases g
            JOIN version_metrics b ON b.horizon_hours = g.horizon_hours AND b.version = '1'
            JOIN version_metrics c ON c.horizon_hours = g.horizon_hours AND c.version = g.cand
            LEFT JOIN version_metrics h ON h.horizon_hours = g.horizon_hours AND h.version = g.champ))"""


sql("quality_gate", gate("mae", 0))
sql("promote_all", gate("rmse", 0.5, """,
       CASE WHEN reason IN ('initial_champion', 'quality_gate_passed') THEN 'PROMOTED' ELSE 'NOT PROMOTED' END AS status"""))
sql("model_version_lookup", """
SELECT model_name, run_id, max(version) AS version, 'run' AS lookup FROM training_runs GROUP BY 1, 2
UNION ALL SELECT model_name, arg_max(run_id, version), max(version), 'champion' FROM training_runs WHERE alias = 'champion' GROUP BY 1""")
sql("last_training_timestamp", """
SELECT arg_max(dataset_max_timestamp, started_at) AS last_trained FROM (
  SELECT * FROM training_runs WHERE horizon_hours = 1 AND status = 'FINISHED')
WHERE dataset_max_timestamp IS NOT NULL""")

# --- learners: all but the models' own numbers --------------------------------------------------------------------


def cutoff(source: str) -> str:
    """The first test time of a temporal split."""
    return f"""(
SELECT timestamp_utc FROM (
  SELECT timestamp_utc, row_number() OVER (ORDER BY timestamp_utc) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT timestamp_utc FROM {source}))
WHERE i = least(greatest(CAST(floor(CAST(n AS DOUBLE) * CAST(0.8 AS DOUBLE)) AS BIGINT), 1), n - 1))"""


view("training_cut", f"SELECT *, timestamp_utc >= {cutoff('training_rows')} AS is_test FROM training_rows")
sql("train_gbt", "SELECT iu_ac, timestamp_utc, k, target_k_1h, true AS has_prediction FROM training_cut WHERE is_test")
sql("train_hist_gbt", f"""
SELECT iu_ac, timestamp_utc, k, target_k_1h, true AS has_prediction FROM ml_dataset WHERE timestamp_utc >= {cutoff('ml_dataset')}""")


def version(h: int) -> str:
    return f"""
SELECT 'congestion-{h}h' AS model_name, CAST({h} AS INTEGER) AS horizon_hours, CAST(1 AS INTEGER) AS version, 'candidate' AS alias,
       'FINISHED' AS status, TIMESTAMP '2024-01-31 06:00:00' AS started_at, true AS has_errors, CAST(14 AS INTEGER) AS n_features,
       count(target_k_{h}h) FILTER (NOT is_test) AS train_rows, count(target_k_{h}h) FILTER (is_test) AS test_rows,
       count(*) AS dataset_rows, min(timestamp_utc) AS dataset_min_timestamp, max(timestamp_utc) AS dataset_max_timestamp
FROM training_cut"""


sql("train_horizon", version(2))
sql("train_one_horizon", version(1))
sql("train_all_horizons", "\nUNION ALL ".join(map(version, (1, 2, 3))))


def comparison(features: dict[str, int], test: str, relative: bool = False) -> str:
    """The lines of a comparison on the test rows with k and target; `relative` to a model and not to persistence."""
    lines = ", ".join(f"('{name}', {n})" for name, n in {"Persistence": 1, **features}.items())
    alone = "t.model = 'Persistence'"
    return f"""
SELECT t.model, CAST(t.n AS INTEGER) AS n_features, count(*) AS n_samples, true AS has_errors, true AS one_best,
       round(CASE WHEN {alone} THEN avg(abs(target_k_1h - k)) END, 6) AS persistence_mae,
       round(CASE WHEN {alone} THEN sqrt(avg((target_k_1h - k) * (target_k_1h - k))) END, 6) AS persistence_rmse,
       CASE WHEN {"t.model = 'flow'" if relative else alone} THEN 0e0 END AS own_gain_pct
FROM traffic_features, (VALUES {lines}) t(model, n)
WHERE {test} AND k IS NOT NULL AND target_k_1h IS NOT NULL GROUP BY t.model, t.n"""


LATE = f"timestamp_utc >= {cutoff('traffic_features')}"
AFTER = "timestamp_utc > TIMESTAMP '2024-01-24'"
sql("ablation_calendar", comparison({"flow": 11, "flow, holidays": 14, "flow, calendar": 15}, LATE))
sql("ablation_weather", comparison({"flow": 11, "flow, weather": 17}, LATE))
sql("ablation_road", comparison({"flow": 11, "flow, road": 14}, LATE, relative=True))
sql("ablation_events", comparison({"flow": 11, "flow, city events": 13}, AFTER, relative=True))
sql("ablation_all", comparison({"flow": 11, "flow, calendar": 15, "flow, weather": 17, "flow, road": 14, "flow, city events": 13,
                                "flow, road, city events": 16}, AFTER, relative=True))
sql("model_comparison", comparison({"Histogram boosting": 11, "Boosted trees": 11}, LATE))
sql("train_report", comparison({"Histogram boosting": 17}, LATE))


def newest(h: int) -> str:
    return f"""
SELECT iu_ac, timestamp_utc AS prediction_timestamp_utc, timestamp_utc + INTERVAL {h} HOUR AS target_timestamp_utc,
       CAST({h} AS INTEGER) AS horizon_hours, '1' AS model_version, true AS has_prediction
FROM window_obs o WHERE iu_ac IN (SELECT iu_ac FROM road_reference)
  AND timestamp_utc = (SELECT max(timestamp_utc) FROM window_obs m WHERE m.iu_ac = o.iu_ac)"""


sql("horizon_predictions", newest(2))
sql("run_predictions", "SELECT *, CAST(1 AS BIGINT) AS first_write FROM (" + "\nUNION ALL ".join(map(newest, (1, 2, 3))) + ")")
sql("refresh_job", """
SELECT CAST(h AS INTEGER) AS horizon_hours, true AS has_errors, true AS is_first_decision, true AS promoted_as_decided
FROM (VALUES (1), (2), (3)) t(h)""")

# --- inference and serving ---------------------------------------------------------------------------------------

sql("latest_observation_per_road", """
SELECT * FROM obs o WHERE timestamp_utc = (SELECT max(timestamp_utc) FROM obs m WHERE m.iu_ac = o.iu_ac)""")
sql("latest_timestamp_rows", "SELECT * FROM obs WHERE timestamp_utc = (SELECT max(timestamp_utc) FROM obs)")
sql("persistence_predictions", """
SELECT iu_ac, timestamp_utc AS prediction_timestamp_utc, timestamp_utc + to_hours(h) AS target_timestamp_utc,
       CAST(h AS INTEGER) AS horizon_hours, k AS predicted_k, 'persistence' AS model_version
FROM obs o, (VALUES (1), (2), (3)) t(h) WHERE timestamp_utc = (SELECT max(timestamp_utc) FROM obs m WHERE m.iu_ac = o.iu_ac)""")
sql("recent_window", "SELECT * FROM window_obs")
sql("latest_traffic_timestamp", "SELECT max(timestamp_utc) AS latest_timestamp FROM obs")
sql("latest_timestamp_by_road", """
SELECT iu_ac, max(timestamp_utc) AS latest_timestamp FROM obs WHERE iu_ac IN (SELECT iu_ac FROM road_reference) GROUP BY 1""")
sql("latest_n_for_road", "SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY iu_ac ORDER BY timestamp_utc DESC) <= 24")
sql("latest_predictions", "SELECT * FROM current_predictions")
sql("latest_prediction_for_road", """
SELECT * FROM predictions WHERE horizon_hours = 2
QUALIFY row_number() OVER (PARTITION BY iu_ac ORDER BY prediction_timestamp_utc DESC, first_write DESC) = 1""")
sql("road_history", """
SELECT o.*, p.* EXCLUDE (iu_ac, first_write) FROM obs o
LEFT JOIN (SELECT * FROM predictions WHERE horizon_hours = 1
           QUALIFY row_number() OVER (PARTITION BY iu_ac ORDER BY prediction_timestamp_utc DESC, first_write DESC) = 1) p USING (iu_ac)
WHERE timestamp_utc >= (SELECT max(timestamp_utc) FROM obs m WHERE m.iu_ac = o.iu_ac) - INTERVAL 24 HOUR""")
sql("list_roads", "SELECT * FROM segments")
sql("all_road_ids", "SELECT iu_ac FROM segments")
sql("top_predicted", "SELECT iu_ac, horizon_hours, predicted_k, model_version FROM current_predictions")
sql("response_projection", "SELECT * EXCLUDE (first_write) FROM predictions")

# --- keyed writes ----------------------------------------------------------------------------------------------------

sql("upsert_traffic", """
SELECT * FROM traffic_delivery UNION ALL
SELECT o.* FROM obs o WHERE timestamp_utc < TIMESTAMP '2024-01-24' AND NOT EXISTS (
  SELECT 1 FROM traffic_delivery d WHERE d.iu_ac = o.iu_ac AND d.timestamp_utc = o.timestamp_utc)""")
sql("upsert_predictions", """
SELECT iu_ac, prediction_timestamp_utc, target_timestamp_utc, horizon_hours,
       CASE WHEN prediction_timestamp_utc >= TIMESTAMP '2024-01-24' OR first_write % 4 = 1 THEN predicted_k + 2 ELSE predicted_k END AS predicted_k,
       model_version,
       CASE WHEN prediction_timestamp_utc >= TIMESTAMP '2024-01-24' THEN first_write + 1000000000000 ELSE first_write END AS first_write
FROM predictions""")
sql("upsert_roads", """
SELECT * FROM new_segments UNION ALL SELECT * FROM segments WHERE iu_ac NOT IN (SELECT iu_ac FROM new_segments)""")
sql("sync_roads", "SELECT * FROM new_segments")
sql("bulk_import", "SELECT * FROM bulk_rows")
sql("constraint_checks", """
SELECT 'observations unique key' AS rule, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_violations
  FROM (SELECT count(*) AS n FROM obs_clean GROUP BY iu_ac, timestamp_utc)
UNION ALL SELECT 'observations not null', count(*) FROM obs_clean WHERE iu_ac IS NULL OR timestamp_utc IS NULL
UNION ALL SELECT 'segments unique key', count(*) - count(DISTINCT iu_ac) FROM segments
UNION ALL SELECT 'segments not null', count(*) FROM segments WHERE iu_ac IS NULL OR latitude IS NULL OR longitude IS NULL
UNION ALL SELECT 'predictions unique key', CAST(sum(n - 1) AS BIGINT) FROM (
  SELECT count(*) AS n FROM predictions GROUP BY iu_ac, prediction_timestamp_utc, horizon_hours)
UNION ALL SELECT 'predictions not null', count(*) FROM predictions WHERE predicted_k IS NULL
UNION ALL SELECT 'predictions horizon above zero', count(*) FROM predictions WHERE horizon_hours <= 0""")
sql("dataset_invariants", """
SELECT count(*) > 0 AS not_empty, count(DISTINCT iu_ac) > 1 AS several_roads,
       count(DISTINCT iu_ac) <= (SELECT count(DISTINCT iu_ac) FROM obs) AS no_new_roads,
       count(*) = count(target_k_1h) AS target_complete,
       count(*) FILTER (latitude IS NULL OR longitude IS NULL OR road_length_m IS NULL) = 0 AS road_complete,
       count(*) <= (SELECT count(*) FROM traffic_features) AS not_longer_than_input FROM ml_dataset""")
sql("weather_hour_checks", """
SELECT count(*) AS n_rows, count(DISTINCT timestamp_utc) AS n_hours, min(timestamp_utc) AS first_hour,
       max(timestamp_utc) AS last_hour, count(*) = count(DISTINCT timestamp_utc) AS hours_unique FROM weather""")
sql("migrate_horizon", "SELECT * REPLACE (CAST(1 AS INTEGER) AS horizon_hours) FROM predictions WHERE horizon_hours = 1")

# --- incremental and streaming --------------------------------------------------------------------------------------------

sql("road_cursors", """
SELECT latest_timestamp, count(*) AS n_roads, min(iu_ac) AS first_road, max(iu_ac) AS last_road FROM cursor_of GROUP BY 1""")

def increment(hours: int) -> str:
    return f"""
SELECT o.* FROM obs o JOIN cursor_of c USING (iu_ac)
WHERE timestamp_utc > coalesce(latest_timestamp, TIMESTAMP '2024-01-31 06:00:00' - INTERVAL {hours} HOUR)"""


sql("bootstrap_window", increment(200))
sql("incremental_ingest", f"SELECT * FROM earlier_obs UNION ALL {increment(300)}")
sql("stream_bulk_inbox", "SELECT * FROM bulk_rows")
sql("stream_dedupe", """
SELECT iu_ac, timestamp_utc, q, k FROM bulk_normal
QUALIFY row_number() OVER (PARTITION BY iu_ac, timestamp_utc ORDER BY event_id DESC) = 1""")
sql("freshness_gate", """
SELECT latest_timestamp, round(age, 6) AS age_hours, age <= 24 AS is_fresh
FROM (SELECT max(timestamp_utc) AS latest_timestamp,
             (epoch_us(TIMESTAMP '2024-01-31 06:00:00') - epoch_us(max(timestamp_utc))) / 3600000000 AS age FROM obs)""")
sql("new_data_gate", """
SELECT latest_timestamp, last_trained, round((epoch_us(latest_timestamp) - epoch_us(last_trained)) / 3600000000, 6) AS new_data_hours,
       last_trained IS NULL OR latest_timestamp > last_trained AS training_required
FROM (SELECT max(timestamp_utc) AS latest_timestamp FROM obs), (
  SELECT arg_max(dataset_max_timestamp, started_at) AS last_trained FROM (
    SELECT * FROM training_runs WHERE horizon_hours = 1 AND status = 'FINISHED')
  WHERE dataset_max_timestamp IS NOT NULL)""")

# --- monitoring ---------------------------------------------------------------------------------------------------------------

view("fresh", """
SELECT epoch_us(max(timestamp_utc)) / 1000000 AS latest_observation_epoch,
       greatest(0, (epoch_us(TIMESTAMP '2024-01-31 06:00:00') - epoch_us(max(timestamp_utc))) / 1000000) AS observation_age_seconds FROM obs""")
view("coverage", """
SELECT CAST(h AS INTEGER) AS horizon_hours, (SELECT count(*) FROM current_predictions WHERE horizon_hours = h) AS predicted_roads,
       (SELECT count(*) FROM segments) AS total_roads FROM (VALUES (1), (2), (3)) t(h)""")
sql("observation_freshness", "SELECT * FROM fresh")
sql("prediction_coverage", "SELECT *, round(predicted_roads / total_roads, 6) AS coverage_ratio FROM coverage")
sql("prediction_age", """
SELECT horizon_hours, epoch_us(max(prediction_timestamp_utc)) / 1000000 AS latest_prediction_epoch,
       greatest(0, (epoch_us(TIMESTAMP '2024-01-31 06:00:00') - epoch_us(max(prediction_timestamp_utc))) / 1000000) AS prediction_age_seconds
FROM predictions GROUP BY 1""")
sql("champion_version_metric", """
SELECT horizon_hours, TRY_CAST(arg_min(model_version, iu_ac) AS DOUBLE) AS champion_version FROM current_predictions
GROUP BY 1 HAVING TRY_CAST(arg_min(model_version, iu_ac) AS DOUBLE) IS NOT NULL""")
view("metric_points", """
SELECT 'stale observations' AS alert, CAST(NULL AS INTEGER) AS horizon_hours, timestamp_utc AS t, CAST(NULL AS BIGINT) AS n
FROM (SELECT DISTINCT timestamp_utc FROM obs)
UNION ALL SELECT 'low prediction coverage', horizon_hours, prediction_timestamp_utc, count(DISTINCT iu_ac)
FROM predictions WHERE horizon_hours IN (1, 2, 3) GROUP BY 2, 3
UNION ALL SELECT 'low prediction coverage', CAST(h AS INTEGER), (SELECT min(timestamp_utc) FROM obs), 0 FROM (VALUES (1), (2), (3)) t(h)""")
view("evaluated", """
SELECT alert, horizon_hours, seen_at,
       CASE WHEN n IS NULL THEN (epoch_us(seen_at) - epoch_us(t)) / 1000000 ELSE n / (SELECT count(*) FROM segments) END AS value, n
FROM (SELECT *, coalesce(lead(t) OVER (PARTITION BY alert, horizon_hours ORDER BY t, n) - INTERVAL 1 MICROSECOND,
                         TIMESTAMP '2024-01-31 06:00:00') AS until FROM metric_points) p
JOIN (SELECT unnest(generate_series(date_trunc('hour', (SELECT min(t) FROM metric_points)), TIMESTAMP '2024-01-31 06:00:00',
                                    INTERVAL 5 MINUTE)) AS seen_at) g ON g.seen_at BETWEEN p.t AND p.until""")
view("breach_islands", """
SELECT alert, horizon_hours, min(seen_at) AS started_at, max(seen_at) AS ended_at, count(*) AS n_evaluations, arg_max(value, seen_at) AS last_value, list(seen_at) AS times
FROM (SELECT *, row_number() OVER (PARTITION BY alert, horizon_hours ORDER BY seen_at)
               - row_number() OVER (PARTITION BY alert, horizon_hours, breached ORDER BY seen_at) AS island
      FROM (SELECT *, CASE WHEN n IS NULL THEN value > 21600 ELSE value < CAST(0.95 AS DOUBLE) END AS breached FROM evaluated))
WHERE breached GROUP BY alert, horizon_hours, island""")
view("runs_of_breaches", """
SELECT alert, horizon_hours, started_at, ended_at, list_min(list_filter(times, lambda x: x >= started_at + INTERVAL 15 MINUTE)) AS fired_at,
       n_evaluations, round(last_value, 6) AS last_value FROM breach_islands""")
sql("breach_runs", "SELECT * FROM runs_of_breaches")
sql("alerts", """
SELECT alert, horizon_hours, last_value AS value, started_at AS breached_since FROM runs_of_breaches r
WHERE fired_at IS NOT NULL AND ended_at = (SELECT max(seen_at) FROM evaluated e WHERE e.alert = r.alert AND e.horizon_hours IS NOT DISTINCT FROM r.horizon_hours)""")
