"""Queries that read, join, store and publish."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolith import session
from aerolith.functions import columns as C
from aerolith.operators import analogues, audits, explain, features, metrics
from aerolith.operators.features import FEATURE_COLUMNS, HORIZONS, STORED_COLUMNS, WEATHER, AIR, mean
from aerolith.plans import sql
from aerolith.plans.evaluation import similar_sql
from aerolith.plans.registry import query, shown
from aerolith.sources import landing, outputs, store, tables

KEYS = "station ts"
CITY = "Springfield"


@query("explode_hourly", shown(
    f"WITH {sql.READINGS}, {sql.WEATHER_CTE}, slots AS (SELECT d.station, d.day + h.h * INTERVAL 1 HOUR AS ts "
    "FROM (SELECT DISTINCT station, date_trunc('day', ts) AS day FROM weather) AS d, range(24) AS h(h)) "
    f"SELECT s.station, '{CITY}' AS city, s.ts, {', '.join('w.' + c for c in WEATHER)} FROM slots AS s "
    "LEFT JOIN weather AS w ON w.station = s.station AND w.ts = s.ts", KEYS + " city", " ".join(WEATHER)))
def explode_hourly(spark, sf_dir):
    """Weather landed as JSON responses of a station and day, read from the files; lines broken on the way are put aside."""
    path = session.scratch(spark, "responses")
    weather = session.store(tables.weather(spark, sf_dir), "weather")
    landing.write_responses(landing.pack_hourly(weather, WEATHER), WEATHER, path, CITY)
    broken = weather.select("station").distinct().select(F.concat(F.lit('{"station": "'), "station", F.lit('", "hourly": {"rain": [1.0')).alias("value"))
    broken.write.mode("append").text(path)
    responses, _ = landing.read_responses(spark, path, WEATHER)
    return landing.explode_hourly(responses, WEATHER)


@query("broken_responses", f"WITH {sql.READINGS} SELECT 'not readable' AS reason, count(DISTINCT station) AS lines FROM readings "
       "UNION ALL SELECT 'arrays of another length', count(DISTINCT station) FROM readings")
def broken_responses(spark, sf_dir):
    """Of every station a cut line and one whose arrays are too short, among whole ones: what is put aside and why."""
    path = session.scratch(spark, "responses")
    weather = session.store(tables.weather(spark, sf_dir), "weather")
    landing.write_responses(landing.pack_hourly(weather, WEATHER), WEATHER, path, CITY)
    lines = spark.read.text(path).select("value", F.get_json_object("value", "$.station").alias("station"))
    one = lines.groupBy("station").agg(F.min("value").alias("value"))
    cut = one.select(F.expr("substring(value, 1, length(value) div 2)").alias("value"))
    longer = one.select(F.regexp_replace("value", '"end":(\\d+)', '"end":9$1').alias("value"))
    session.store(cut.unionByName(longer), "broken").write.mode("append").text(path)
    _, broken = landing.read_responses(spark, path, WEATHER)
    return broken.groupBy("reason").agg(F.count("*").alias("lines"))


@query("scan_date_range", shown(
    "SELECT event_id, event_type AS station, ts, value FROM events "
    "WHERE ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-14 12:00:00'", "event_id " + KEYS, "value"))
def scan_date_range(spark, sf_dir):
    events = landing.between(tables.table(spark, sf_dir, "events"), "2024-01-08", "2024-01-14 12:00:00")
    return tables.as_readings(events).select("event_id", "station", "ts", "value")


def _stored_features(spark, sf_dir):
    """Path of a stored feature table made from the whole of the observations."""
    path = session.scratch(spark, "features")
    built = features.build(tables.observations(spark, sf_dir), HORIZONS)
    store.create(store.project(built), path)
    return path


_STORED = [c for c in STORED_COLUMNS if c not in ("station", "ts")]


@query("scan_features", shown(
    f"WITH {sql.TRAINING} SELECT * FROM features WHERE ts >= TIMESTAMP '2024-01-05' "
    "AND ts <= TIMESTAMP '2024-01-20 06:00:00'", KEYS, " ".join(_STORED)))
def scan_features(spark, sf_dir):
    rows = store.read(spark, _stored_features(spark, sf_dir), "2024-01-05", "2024-01-20 06:00:00")
    return store.require_rows(rows, "the feature table").orderBy("ts", "station")


@query("existing_keys", f"WITH {sql.OBS} SELECT DISTINCT station, ts FROM obs")
def existing_keys(spark, sf_dir):
    return store.existing_keys(spark, _stored_features(spark, sf_dir))


@query("project_sink", shown(f"WITH {sql.TRAINING} SELECT * FROM features", KEYS, " ".join(_STORED)))
def project_sink(spark, sf_dir):
    built = features.build(tables.observations(spark, sf_dir), HORIZONS)
    return store.project(built.withColumn("comment", F.lit("left out")))


def _batches(spark, sf_dir):
    """All readings as a first and a second delivery; the second repeats every key
    with another value, so ignoring and replacing give different tables."""
    rows = tables.readings(spark, sf_dir).select("station", "ts", "value", "event_id")
    middle = F.lit("2024-01-16").cast("timestamp")
    return rows.where(F.col("ts") < middle), rows.withColumn("value", F.col("value") + 1000)


def _append_twice(spark, sf_dir, mode):
    first, second = _batches(spark, sf_dir)
    path = session.scratch(spark, f"append-{mode}")
    store.create(first, path)
    for _ in range(2):
        store.append(spark, second, path, mode)
    return store.read(spark, path)


@query("append_new_rows", shown(
    "SELECT event_type AS station, ts, event_id, "
    "CASE WHEN ts < TIMESTAMP '2024-01-16' THEN value ELSE value + 1000 END AS value FROM events",
    KEYS + " event_id", "value"))
def append_new_rows(spark, sf_dir):
    return _append_twice(spark, sf_dir, "ignore")


@query("upsert_latest", shown(
    "SELECT event_type AS station, ts, event_id, value + 1000 AS value FROM events", KEYS + " event_id", "value"))
def upsert_latest(spark, sf_dir):
    return _append_twice(spark, sf_dir, "latest")


@query("new_rows_anti_join", shown(
    f"WITH {sql.READINGS}, {sql.WEATHER_CTE}, {sql.AIR_CTE} SELECT station, ts, us_aqi FROM air "
    "WHERE NOT EXISTS (SELECT 1 FROM weather WHERE weather.station = air.station AND weather.ts = air.ts)",
    KEYS, "us_aqi"))
def new_rows_anti_join(spark, sf_dir):
    air = tables.air_quality(spark, sf_dir).select("station", "ts", "us_aqi")
    return store.new_rows(air, tables.weather(spark, sf_dir).select("station", "ts"))


@query("join_weather_aq", shown(f"WITH {sql.OBS} SELECT * FROM obs", KEYS, " ".join(WEATHER + AIR)))
def join_weather_aq(spark, sf_dir):
    return landing.join_sources(tables.weather(spark, sf_dir), tables.air_quality(spark, sf_dir))


_PERIOD = "WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-28'"


@query("backfill_training", shown(
    f"WITH {sql.TRAINING.replace('FROM obs)', f'FROM obs {_PERIOD})')} SELECT * FROM features WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLUMNS + list(HORIZONS)),
    KEYS, " ".join(FEATURE_COLUMNS + list(HORIZONS))))
def backfill_training(spark, sf_dir):
    return landing.backfill(tables.weather(spark, sf_dir), tables.air_quality(spark, sf_dir),
                            "2024-01-02", "2024-01-28")


@query("missing_hours", f"""WITH {sql.SERIES}, span AS (
  SELECT station, min(ts) AS a, max(ts) AS b FROM series GROUP BY 1), spine AS (
  SELECT station, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span)
  SELECT station, ts FROM spine WHERE NOT EXISTS (
    SELECT 1 FROM series WHERE series.station = spine.station AND series.ts = spine.ts)""")
def missing_hours(spark, sf_dir):
    return audits.missing_hours(tables.series(spark, sf_dir))


@query("latest_row", shown(
    f"WITH {sql.OBS} SELECT * FROM obs WHERE ts = (SELECT max(o.ts) FROM obs AS o WHERE o.station = obs.station)",
    KEYS, " ".join(WEATHER + AIR)))
def latest_row(spark, sf_dir):
    return outputs.latest_rows(tables.observations(spark, sf_dir))


_NEWEST = ", ".join(
    f"round_even(arg_max({c}, ts) FILTER (WHERE {c} IS NOT NULL), 1) AS {c}"
    for c in ("pm2_5", "pm10", "nitrogen_dioxide", "ozone"))


@query("latest_pollutants", shown(
    f"WITH {sql.OBS} SELECT station, {_NEWEST} FROM obs GROUP BY station",
    "station", "pm2_5 pm10 nitrogen_dioxide ozone"))
def latest_pollutants(spark, sf_dir):
    return outputs.latest_pollutants(tables.observations(spark, sf_dir))


# The limits as SQL sees them.
_LIMITS = """limits(place, pollutant, source, limit_value, unit) AS (VALUES
  (1, 'PM2.5', 'pm2_5', 35, 'µg/m³'), (2, 'PM10', 'pm10', 150, 'µg/m³'),
  (3, 'NO2', 'nitrogen_dioxide', 53, 'ppb'), (4, 'O3', 'ozone', 70, 'ppb'))"""
_STATE = f"""newest AS (SELECT station, {_NEWEST} FROM obs GROUP BY station), {_LIMITS},
state AS (SELECT place, station, pollutant, v AS value, unit, limit_value,
  CAST(trunc(v / limit_value * 100) AS INTEGER) AS percent_of_limit,
  CASE WHEN v / limit_value <= 0.5 THEN 'Good' WHEN v / limit_value <= 1 THEN 'Moderate'
       WHEN v / limit_value <= 2 THEN 'Unhealthy' WHEN v IS NOT NULL THEN 'Hazardous' END AS status
  FROM (SELECT *, CASE source WHEN 'pm2_5' THEN pm2_5 WHEN 'pm10' THEN pm10
          WHEN 'ozone' THEN ozone ELSE nitrogen_dioxide END AS v FROM newest, limits) AS x)"""


@query("pollutant_limits", shown(
    f"WITH {sql.OBS}, {_STATE} SELECT * FROM state",
    "station pollutant unit limit_value percent_of_limit status", "value"))
def pollutant_limits(spark, sf_dir):
    return outputs.against_limits(outputs.latest_pollutants(tables.observations(spark, sf_dir)))


@query("nan_to_null", shown(
    f"WITH {sql.READINGS} SELECT station, count(*) AS rows, count(CASE WHEN k <= 90 THEN value END) AS known, "
    "avg(CASE WHEN k <= 90 THEN value END) AS mean_value, "
    "count(CASE WHEN k <= 90 AND value > 150 THEN 1 END) AS heavy FROM readings GROUP BY station",
    "station rows known heavy", "mean_value"))
def nan_to_null(spark, sf_dir):
    faulty = tables.readings(spark, sf_dir).withColumn(
        "value", F.when(F.col("k") > 90, F.lit(float("nan"))).otherwise(F.col("value")))
    return C.clean(faulty, ["value"]).groupBy("station").agg(
        F.count("*").alias("rows"), F.count("value").alias("known"), F.avg("value").alias("mean_value"),
        F.count(F.when(F.col("value") > 150, 1)).alias("heavy"))


@query("json_props", shown(
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, "
    "'{\"station\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || '}' AS text "
    "FROM events", "event_id k text", ""))
def json_props(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    k = F.from_json("props", "k bigint")["k"]
    return events.select("event_id", k.alias("k"),
                         F.to_json(F.struct(F.col("event_type").alias("station"), k.alias("k"))).alias("text"))


@query("scalar_functions", shown("""
  SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS weekday, month(ts) AS month, year(ts) AS year,
    dayname(ts) AS day_name, monthname(ts) AS month_name,
    CAST(floor(epoch(ts)) AS BIGINT) AS epoch_seconds,
    make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS from_epoch,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso_text,
    strftime(ts, '%b %d, %Y') AS long_date,
    CAST(CAST(ts AS DATE) - INTERVAL 3 YEAR AS TIMESTAMP) AS three_years_back,
    ts - INTERVAL 10 DAY AS ten_days_back,
    (TIMESTAMP '2024-02-01' - ts) >= INTERVAL 7 DAY AS week_old,
    exp(-0.5 * date_diff('microsecond', ts, TIMESTAMP '2024-02-01') / 1e6 / (365.25 * 24 * 3600)) AS decay,
    round_even(value, 1) AS half_even, CAST(trunc(value) AS INTEGER) AS cut, sqrt(value) AS root,
    abs(value - 50) AS distance, least(98.8, greatest(30, value)) AS clamped,
    upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' Lag ' || CAST(hour(ts) AS VARCHAR) || 'H' AS title,
    contains(event_type, 'ick') AS has_part,
    'Wind ' || printf('%.1f', round_even(value, 1)) || ' km/h' AS wind_text,
    CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END || CASE WHEN hour(ts) < 12 THEN ' AM' ELSE ' PM' END AS clock,
    hour(ts) BETWEEN 6 AND 18 AS is_day,
    substr(dayname(ts + INTERVAL 2 DAY), 1, 3) AS day_after_next,
    strftime(ts + INTERVAL 2 DAY, '%b ') || CAST(day(ts + INTERVAL 2 DAY) AS VARCHAR) AS label_after_next
  FROM events""",
    "event_id hour weekday month year day_name month_name epoch_seconds from_epoch iso_text long_date "
    "three_years_back ten_days_back week_old cut title has_part wind_text clock is_day day_after_next "
    "label_after_next", "decay half_even root distance clamped"))
def scalar_functions(spark, sf_dir):
    rows = tables.readings(spark, sf_dir)
    now = F.lit("2024-02-01").cast("timestamp")
    age = (F.unix_micros(now) - F.unix_micros("ts")) / 1e6
    value = F.col("value")
    name = F.concat(F.col("station"), F.lit("_lag_"), F.hour("ts").cast("string"), F.lit("h"))
    return rows.select(
        "event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), F.month("ts").alias("month"),
        F.year("ts").alias("year"), F.date_format("ts", "EEEE").alias("day_name"),
        F.date_format("ts", "MMMM").alias("month_name"), F.unix_seconds("ts").alias("epoch_seconds"),
        F.timestamp_seconds(F.unix_seconds("ts")).alias("from_epoch"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("iso_text"),
        F.date_format("ts", "MMM dd, yyyy").alias("long_date"),
        landing.years_back(F.to_date("ts")).cast("timestamp").alias("three_years_back"),
        (F.col("ts") - F.expr("INTERVAL 10 DAYS")).alias("ten_days_back"),
        (F.col("ts") <= now - F.expr("INTERVAL 7 DAYS")).alias("week_old"),
        F.exp(-0.5 * age / (365.25 * 24 * 3600)).alias("decay"),
        F.bround(value, 1).alias("half_even"), value.cast("int").alias("cut"), F.sqrt(value).alias("root"),
        F.abs(value - 50).alias("distance"), F.least(F.lit(98.8), F.greatest(F.lit(30.0), value)).alias("clamped"),
        C.title_name(name).alias("title"), F.contains("station", F.lit("ick")).alias("has_part"),
        F.format_string("Wind %.1f km/h", F.bround(value, 1)).alias("wind_text"),
        C.clock_label("ts").alias("clock"), C.is_daylight("ts").alias("is_day"),
        F.date_format(F.date_add("ts", 2), "EEE").alias("day_after_next"),
        F.date_format(F.date_add("ts", 2), "MMM d").alias("label_after_next"))


def _forecast(obs):
    """Newest row per station with stand-in predictions: means of the last day,
    two days and three days, floored at 30."""
    built = features.add(obs.select("station", "ts", "us_aqi"), [mean("us_aqi", n) for n in HORIZONS.values()])
    newest = outputs.latest_rows(built)
    floor = lambda c: F.bround(F.greatest(F.lit(30.0), F.col(c)), 1)
    return newest.select(
        "station", "ts", F.bround("us_aqi", 1).alias("today"),
        *[floor(f"us_aqi_rolling_mean_{n}h").alias(f"day{i}") for i, n in enumerate(HORIZONS.values(), 1)])


_FORECAST = f"""means AS (
  SELECT station, ts, us_aqi, {', '.join(sql.rolling('avg', 'us_aqi', n, f'm{n}') for n in HORIZONS.values())},
         row_number() OVER (PARTITION BY station ORDER BY ts DESC) AS back FROM obs),
forecast AS (SELECT station, ts, round_even(us_aqi, 1) AS today,
  {', '.join(f'round_even(greatest(30.0, m{n}), 1) AS day{i}' for i, n in enumerate(HORIZONS.values(), 1))}
  FROM means WHERE back = 1)"""
_BAND = "CASE " + " ".join(f"WHEN {{v}} <= {u} THEN '{t}'" for u, t, _ in C.BANDS[:-1]) \
    + f" WHEN {{v}} IS NOT NULL THEN '{C.BANDS[-1][1]}' END"
_ADVICE = "CASE " + " ".join(f"WHEN {{v}} <= {u} THEN '{t}'" for u, _, t in C.BANDS[:-1]) \
    + f" WHEN {{v}} IS NOT NULL THEN '{C.BANDS[-1][2]}' END"
_LONG = f"""long AS (SELECT station, horizon, day, date_add(ts, to_days(CAST(day AS INTEGER))) AS d, CAST(round_even(aqi, 0) AS INTEGER) AS aqi FROM (
  SELECT station, ts, 'today' AS horizon, 0 AS day, today AS aqi FROM forecast UNION ALL
  SELECT station, ts, 'day1', 1, day1 FROM forecast UNION ALL
  SELECT station, ts, 'day2', 2, day2 FROM forecast UNION ALL
  SELECT station, ts, 'day3', 3, day3 FROM forecast) AS u)"""
_LONG_SELECT = f"""SELECT station, horizon,
  CASE WHEN day = 0 THEN 'Today' ELSE substr(dayname(d), 1, 3) END AS day_name,
  strftime(d, '%b ') || CAST(day(d) AS VARCHAR) AS date_label, aqi, {_BAND.format(v='aqi')} AS band FROM long"""


@query("forecast_long", f"WITH {sql.OBS}, {_FORECAST}, {_LONG} SELECT *, {_ADVICE.format(v='aqi')} AS advice FROM ({_LONG_SELECT})")
def forecast_long(spark, sf_dir):
    return outputs.forecast_long(_forecast(tables.observations(spark, sf_dir)))


@query("forecast_csv", f"WITH {sql.OBS}, {_FORECAST}, {_LONG} SELECT l.*, "
       "round_even(o.wind_speed_10m, 1) AS wind, round_even(o.relative_humidity_2m, 1) AS humidity, "
       f"round_even(o.pm2_5, 1) AS pm2_5 FROM ({_LONG_SELECT}) AS l JOIN obs AS o ON o.station = l.station "
       "AND o.ts = (SELECT max(x.ts) FROM obs AS x WHERE x.station = o.station)")
def forecast_csv(spark, sf_dir):
    obs = session.store(tables.observations(spark, sf_dir), "hours")
    newest = outputs.latest_rows(obs)
    state = newest.select("station", F.bround("wind_speed_10m", 1).alias("wind"),
                          F.bround("relative_humidity_2m", 1).alias("humidity"), F.bround("pm2_5", 1).alias("pm2_5"))
    rows = outputs.forecast_long(_forecast(obs)).drop("advice").join(state, "station")
    path = session.scratch(spark, "forecast-csv")
    outputs.write_csv(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


_MODELS = {f"day{i}": f"mean of {n} hours" for i, n in enumerate(HORIZONS.values(), 1)}
_TOP = 6


def _shares(features_built):
    """The newest complete row's largest shares in a one-feature linear model of the next day's index, ranked."""
    newest = outputs.latest_rows(features.complete(features_built, FEATURE_COLUMNS)).select("station", "ts", *FEATURE_COLUMNS)
    shares = explain.linear_shapley(newest, explain.slopes(features_built, FEATURE_COLUMNS, "aqi_day1"))
    order = Window.partitionBy("station").orderBy(F.desc(F.abs("value")), "feature")
    return shares.withColumn("place", F.row_number().over(order)).where(F.col("place") <= _TOP).select(
        "station", "place", "feature", C.title_name(F.col("feature")).alias("name"), F.bround(F.abs("value"), 1).alias("impact"),
        F.lit("linear share").alias("method"))


_SHARES_SQL = f"""ahead AS (SELECT *, {sql.lead('us_aqi', 24, 'aqi_day1')} FROM features),
slopes AS (SELECT station AS st, {', '.join(
    f'coalesce(CASE WHEN var_pop({c}) > 0 THEN regr_slope(aqi_day1, {c}) END, 0) AS {c}_b, avg({c}) AS {c}_m' for c in FEATURE_COLUMNS)}
  FROM ahead WHERE aqi_day1 IS NOT NULL GROUP BY 1),
shares AS ({' UNION ALL '.join(f"SELECT station, '{c}' AS feature, {c}_b * ({c} - {c}_m) AS share FROM now_row JOIN slopes ON st = station"
                               for c in FEATURE_COLUMNS)}),
top_shares AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY abs(share) DESC, feature) AS place,
  regexp_replace(array_to_string(list_transform(string_split(feature, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' '), '([0-9])h$', '\\1H') AS name
  FROM shares QUALIFY place <= {_TOP}),
importances AS (SELECT station, to_json(list({{'feature': feature, 'name': name, 'impact': round_even(abs(share), 1), 'method': 'linear share'}}
  ORDER BY place)) AS importances FROM top_shares GROUP BY 1)"""


@query("forecast_payload", f"""WITH {sql.FEATURES}, {_FORECAST}, {_STATE},
  {similar_sql(FEATURE_COLUMNS)}, {_SHARES_SQL},
  pollutants AS (SELECT station, to_json(list({{'pollutant': pollutant, 'value': value, 'unit': unit,
    'limit_value': limit_value, 'percent_of_limit': percent_of_limit, 'status': status}} ORDER BY place)) AS pollutants
    FROM state GROUP BY 1),
  days AS (SELECT station, to_json(list({{'date': date, 'historical_aqi': historical_aqi, 'similarity': similarity,
    'humidity_high': humidity_high}} ORDER BY place)) AS similar_days FROM similar_days GROUP BY 1)
  SELECT f.station, strftime(f.ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_updated,
    CAST(to_json({{'today': today, 'day1': day1, 'day2': day2, 'day3': day3}}) AS VARCHAR) AS predictions,
    CAST(to_json({{{', '.join(f"'{d}': '{m}'" for d, m in _MODELS.items())}}}) AS VARCHAR) AS models,
    CAST(to_json({{'forecast': CASE WHEN today IS NULL OR day1 IS NULL OR day2 IS NULL OR day3 IS NULL THEN 'incomplete' ELSE 'ok' END}}) AS VARCHAR) AS status,
    CAST(pollutants AS VARCHAR) AS pollutants, CAST(similar_days AS VARCHAR) AS similar_days, CAST(importances AS VARCHAR) AS importances
  FROM forecast AS f LEFT JOIN pollutants AS p ON p.station = f.station LEFT JOIN days AS d ON d.station = f.station
  LEFT JOIN importances AS i ON i.station = f.station""")
def forecast_payload(spark, sf_dir):
    """Predictions with their models and status, pollutants, analogue days on all features and importances, as JSON written and read back."""
    built = session.store(features.build(tables.observations(spark, sf_dir), {"aqi_day1": 24}), "features")
    nested = outputs.payload(
        _forecast(built), outputs.against_limits(outputs.latest_pollutants(built)),
        analogues.top_days(built, FEATURE_COLUMNS), _shares(built), _MODELS)
    path = session.scratch(spark, "payload")
    nested.write.json(path)
    return outputs.payload_json(spark.read.schema(nested.schema).json(path))


_LOGGED = {h: ("mean_24h", scaler, weight) for h, scaler, weight in zip(
    HORIZONS, ("standard", "robust", None), ("weight_recency", "weight_event", None))}


def _text(value):
    return "NULL::VARCHAR" if value is None else f"'{value}'"


@query("metrics_log_append", shown(
    f"""WITH {sql.SERIES}, wide AS (SELECT station, ts, us_aqi, {sql.rolling('avg', 'us_aqi', 24, 'mean_24h')},
  {', '.join(sql.lead('us_aqi', k, h) for h, k in HORIZONS.items())} FROM series),
e AS ({' UNION ALL '.join(f"SELECT '{h}' AS horizon, '{m}' AS model, {h} AS t, {c} AS p FROM wide"
                          for h in HORIZONS for m, c in (('persistence', 'us_aqi'), ('mean_24h', 'mean_24h')))}),
m AS (SELECT horizon, model, count(*) AS n, sqrt(avg((t - p) * (t - p))) AS rmse, avg(abs(t - p)) AS mae,
  1 - avg((t - p) * (t - p)) / var_pop(t) AS r2 FROM e WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)
SELECT run_at, m.horizon, m.model, c.scaler, c.weighting, 'models/' || m.horizon AS artifact, m.n, m.rmse, m.mae, m.r2,
  b.rmse AS persistence_rmse, (b.rmse - m.rmse) / nullif(b.rmse, 0) * 100 AS edge_pct
FROM m JOIN m AS b ON b.horizon = m.horizon AND b.model = 'persistence'
JOIN (VALUES {', '.join(f"('{h}', {_text(s)}, {_text(w)})" for h, (_, s, w) in _LOGGED.items())}) AS c(horizon, scaler, weighting) ON c.horizon = m.horizon,
  (VALUES (TIMESTAMP '2024-03-01'), (TIMESTAMP '2024-03-02')) AS r(run_at)
WHERE m.model = 'mean_24h'""", "run_at horizon model scaler weighting artifact n", "rmse mae r2 persistence_rmse edge_pct"))
def metrics_log_append(spark, sf_dir):
    """Two runs appended to one log: a model's errors, how it was made, and its edge over persistence."""
    wide = features.add(tables.series(spark, sf_dir).select("station", "ts", "us_aqi"), [mean("us_aqi", 24)], HORIZONS)
    long = session.store(metrics.by_horizon(wide, dict.fromkeys(HORIZONS, "us_aqi_rolling_mean_24h"), list(HORIZONS), ["us_aqi"]), "errors")
    scores = metrics.regression(long, "truth", "pred", ["horizon"])
    baseline = metrics.regression(long, "truth", "us_aqi", ["horizon"])
    path = session.scratch(spark, "metrics-log")
    for run_at in ("2024-03-01", "2024-03-02"):
        outputs.log_metrics(outputs.log_entries(scores, baseline, _LOGGED, run_at, "models"), path)
    return spark.read.parquet(path)
