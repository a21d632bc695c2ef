"""Pieces of SQL shared by the checks."""

from aerolith.operators.features import (
    AIR, CHANGES, HORIZONS, LAG_HOURS, MEAN_HOURS, SUM_HOURS,
)

READINGS = """readings AS (
  SELECT event_id, event_type AS station, ts, value, user_id,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events)"""

WEATHER_CTE = """weather AS (
  SELECT station, date_trunc('hour', ts) AS ts,
         avg(k) AS temperature_2m, max(k) AS relative_humidity_2m, min(k) AS dew_point_2m,
         avg(k + value / 991) AS apparent_temperature,
         greatest(max(k) - 80, 0.0) / 10 AS precipitation, greatest(max(k) - 90, 0.0) / 10 AS rain,
         avg(user_id) / 991 + 1000 AS surface_pressure, CAST(count(*) AS DOUBLE) AS cloud_cover,
         stddev_samp(value) AS wind_speed_10m, CAST(max(user_id) AS DOUBLE) AS wind_direction_10m,
         (max(value) - min(value)) / 0.997 AS wind_gusts_10m
  FROM readings GROUP BY 1, 2)"""

AIR_CTE = """air AS (
  SELECT station, date_trunc('hour', ts + INTERVAL 30 MINUTE) AS ts,
         min(value) AS pm2_5, avg(value) / 0.997 AS pm10, avg(value * value) / 997 AS ozone,
         avg(abs(value - 50)) / 0.997 AS nitrogen_dioxide, sum(value) / 10 AS sulphur_dioxide,
         sum(k) AS carbon_monoxide, CAST(min(user_id) AS DOUBLE) AS dust,
         (max(k) - min(k)) / 100 AS aerosol_optical_depth, max(value) / 0.997 AS us_aqi
  FROM readings GROUP BY 1, 2)"""

OBS = f"""{READINGS}, {WEATHER_CTE}, {AIR_CTE}, obs AS (
  SELECT weather.*, {', '.join('air.' + c for c in AIR)}
  FROM weather JOIN air ON weather.station = air.station AND weather.ts = air.ts)"""

SERIES = f"""{READINGS}, series AS (
  SELECT station, date_trunc('hour', ts) AS ts, max(value) / 0.997 AS us_aqi, sum(value) AS rain, count(*) AS n
  FROM readings GROUP BY 1, 2)"""

DAILY = """daily AS (
  SELECT o_orderpriority AS station, date_trunc('day', o_orderdate) AS ts,
         avg(o_totalprice) / 2111 AS us_aqi
  FROM orders GROUP BY 1, 2)"""

BY_STATION = "PARTITION BY station ORDER BY ts"


def lag(source, k, name=None):
    return f"lag({source}, {k}) OVER ({BY_STATION}) AS {name or f'{source}_lag_{k}h'}"


def lead(source, k, name):
    return f"lead({source}, {k}) OVER ({BY_STATION}) AS {name}"


def rolling(function, source, n, name):
    frame = f"OVER ({BY_STATION} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({source}) {frame} = {n} THEN {function}({source}) {frame} END AS {name}"


def change(source, name, k=1):
    return f"{source} - lag({source}, {k}) OVER ({BY_STATION}) AS {name}"


def cycles():
    angles = [("hour", "hour(ts)", 24), ("day", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12)]
    return [f"{f}(2 * pi() * {column} / {period}) AS {name}_{f}"
            for name, column, period in angles for f in ("sin", "cos")]


def standard_features():
    parts = [lag(s, k) for s, ks in LAG_HOURS.items() for k in ks]
    parts += [rolling("avg", s, n, f"{s}_rolling_mean_{n}h") for s, ns in MEAN_HOURS.items() for n in ns]
    parts += [rolling("sum", s, n, f"{s}_rolling_sum_{n}h") for s, ns in SUM_HOURS.items() for n in ns]
    return parts + [change(s, name) for name, s in CHANGES.items()]


def horizon_leads():
    return [lead("us_aqi", k, name) for name, k in HORIZONS.items()]


FEATURES = f"""{OBS}, features AS (
  SELECT *, {', '.join(cycles() + standard_features())} FROM obs)"""

TRAINING = f"""{OBS}, features AS (
  SELECT *, {', '.join(cycles() + standard_features() + horizon_leads())} FROM obs)"""

# Rows numbered from 0 in time order, with the length of the series.
INDEXED = """indexed AS (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts) - 1 AS idx,
         count(*) OVER (PARTITION BY station) AS n FROM {source})"""

SMALL_TARGETS = f"""{SERIES}, targets AS (
  SELECT station, ts, us_aqi, {', '.join(horizon_leads())} FROM series)"""
