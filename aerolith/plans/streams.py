"""Streaming queries, run to the end of the given tables.

Windows that are still open are published too, so the SQL is that of the whole table.
"""

from pyspark.sql import functions as F

from aerolith import session
from aerolith.operators import features, models
from aerolith.operators.models import Config
from aerolith.plans import sql
from aerolith.plans.registry import query, shown
from aerolith.sources import tables
from aerolith.streaming import streams

KEYS = "station ts"


def _events(spark, sf_dir):
    schema = tables.table(spark, sf_dir, "events").schema
    return tables.as_readings(streams.read(spark, f"{sf_dir}/events.parquet", schema))


def _index(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("us_aqi", F.col("value") / 0.997)


def _landed(df, name):
    """A derived table written to the shared folder and read as a stream."""
    path = session.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return streams.read(df.sparkSession, path, df.schema)


@query("stream_ingest", shown(
    "SELECT event_type AS station, ts, event_id, value FROM events", KEYS + " event_id", "value"))
def stream_ingest(spark, sf_dir):
    """Every event delivered twice, by two runs of the job, is stored once."""
    path = session.scratch(spark, "ingested")
    for _ in range(2):
        streams.ingest(_events(spark, sf_dir).select("station", "ts", "event_id", "value"), path)
    return spark.read.parquet(path).drop("day")


@query("stream_dedup", shown(
    "SELECT event_type AS station, ts, event_id, value FROM events", KEYS + " event_id", "value"))
def stream_dedup(spark, sf_dir):
    """Every event arrives twice and is stored once, late ones too."""
    arrivals = _events(spark, sf_dir).unionByName(_events(spark, sf_dir)).select("station", "ts", "event_id", "value")
    path = session.scratch(spark, "deduplicated")
    streams.dedup_into(arrivals, path, session.scratch(spark, "late"))
    return spark.read.parquet(path).drop("day")


@query("stream_tumbling", shown(
    "SELECT event_type AS station, date_trunc('hour', ts) AS window_start, "
    "date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, avg(value / 0.997) AS mean_us_aqi, count(*) AS n FROM events "
    "GROUP BY 1, 2, 3", "station window_start window_end n", "mean_us_aqi"))
def stream_tumbling(spark, sf_dir):
    return streams.published(streams.tumbling(_index(spark, sf_dir), "us_aqi"), "tumbling", ["station", "window_start", "window_end"])


@query("stream_sliding", shown(
    "SELECT event_type AS station, date_trunc('hour', ts) - k.k * INTERVAL 1 HOUR AS window_start, "
    "date_trunc('hour', ts) - k.k * INTERVAL 1 HOUR + INTERVAL 24 HOUR AS window_end, avg(value / 0.997) AS mean_us_aqi, "
    "count(*) AS n FROM events, range(24) AS k(k) GROUP BY 1, 2, 3",
    "station window_start window_end n", "mean_us_aqi"))
def stream_sliding(spark, sf_dir):
    days = streams.tumbling(_index(spark, sf_dir), "us_aqi", "24 hours", "1 hour")
    return streams.published(days, "sliding", ["station", "window_start", "window_end"])


def _shifted_sql(offsets):
    joins = " ".join(f"LEFT JOIN series AS s{i} ON s{i}.station = s.station AND s{i}.ts = s.ts - INTERVAL '{k} hours'"
                     for i, k in enumerate(offsets.values()))
    columns = ", ".join(f"s{i}.us_aqi AS {name}" for i, name in enumerate(offsets))
    return shown(
        f"WITH {sql.SERIES} SELECT s.station, s.ts, s.us_aqi, {columns} FROM series AS s {joins}",
        KEYS, "us_aqi " + " ".join(offsets))


_LAGS = {f"us_aqi_lag_{k}h": k for k in features.LAG_HOURS["us_aqi"]}
_AHEAD = {name: -k for name, k in features.HORIZONS.items()}


def _hourly(spark, sf_dir):
    return _landed(tables.series(spark, sf_dir).select("station", "ts", "us_aqi"), "hourly")


@query("stream_lags", _shifted_sql(_LAGS))
def stream_lags(spark, sf_dir):
    return streams.published(streams.shifted(_hourly(spark, sf_dir), "us_aqi", _LAGS), "lags", ["station", "ts"])


@query("stream_targets", _shifted_sql(_AHEAD))
def stream_targets(spark, sf_dir):
    return streams.published(streams.shifted(_hourly(spark, sf_dir), "us_aqi", _AHEAD), "targets", ["station", "ts"])


_MEANS = {f"us_aqi_rolling_mean_{n}h": n for n in features.MEAN_HOURS["us_aqi"]}


def _range_mean(name, n):
    frame = f"OVER (PARTITION BY station ORDER BY ts RANGE BETWEEN INTERVAL {n - 1} HOURS PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(us_aqi) {frame} = {n} THEN avg(us_aqi) {frame} END AS {name}"


@query("stream_rolling", shown(
    f"WITH {sql.SERIES} SELECT station, ts, us_aqi, {', '.join(_range_mean(c, n) for c, n in _MEANS.items())} "
    "FROM series WHERE us_aqi IS NOT NULL", KEYS, "us_aqi " + " ".join(_MEANS)))
def stream_rolling(spark, sf_dir):
    """Rolling means kept in state by station and block of hours."""
    return streams.published(streams.rolling(_hourly(spark, sf_dir), "us_aqi", _MEANS), "rolling", ["station", "ts"])


@query("stream_labels", shown(
    f"WITH {sql.SERIES} SELECT s.station, s.ts, s.us_aqi, h.horizon, t.us_aqi AS label FROM series AS s, (VALUES "
    + ", ".join(f"('{h}', {k})" for h, k in features.HORIZONS.items()) + ") AS h(horizon, hours) JOIN series AS t "
    "ON t.station = s.station AND t.ts = s.ts + h.hours * INTERVAL 1 HOUR", KEYS + " horizon", "us_aqi label"))
def stream_labels(spark, sf_dir):
    """Every hour's index a day, two and three days later, from an interval join of two streams."""
    rows, truth = _hourly(spark, sf_dir), _hourly(spark, sf_dir)
    return streams.result(streams.labels(rows, truth, features.HORIZONS, keep=["us_aqi"]), "labels")


@query("stream_join", shown(f"WITH {sql.OBS} SELECT station, ts, {', '.join(features.MEASURES)} FROM obs", KEYS, " ".join(features.MEASURES)))
def stream_join(spark, sf_dir):
    """Weather and air quality, every column of both, met by station and hour."""
    weather = _landed(tables.weather(spark, sf_dir).select("station", "ts", *features.WEATHER), "weather")
    air = _landed(tables.air_quality(spark, sf_dir).select("station", "ts", *features.AIR), "air")
    return streams.result(streams.join(weather, air), "joined")


@query("stream_score")
def stream_score(spark, sf_dir):
    columns = features.FEATURE_COLUMNS
    rows = session.store(features.build(tables.observations(spark, sf_dir), {"aqi_day1": 24}), "scored-rows")
    model = models.fit(rows, columns, "aqi_day1", Config("ridge", "standard"))
    path = session.scratch(spark, "scores")
    streams.score(_landed(rows.select("station", "ts", *columns), "arriving"), model, columns, path)
    return spark.read.parquet(path).drop("batch")
