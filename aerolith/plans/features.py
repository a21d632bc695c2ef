"""Feature and target queries."""

from pyspark.sql import functions as F

from aerolith import session
from aerolith.operators import audits, features
from aerolith.operators.features import (
    CANDIDATES, CYCLES, FEATURE_COLUMNS, HORIZONS, REBUILT, change, lag, mean, total,
)
from aerolith.plans import sql
from aerolith.plans.registry import query, shown
from aerolith.sources import tables

KEYS = "station ts"


def _over_obs(parts, names):
    return shown(f"WITH {sql.OBS} SELECT station, ts, {', '.join(parts)} FROM obs", KEYS, " ".join(names))


def _subset(name, wanted):
    """A query that adds some features to the observations it needs, and nothing else."""
    made = {"lag": lambda f: sql.lag(f.source, f.hours, f.name),
            "mean": lambda f: sql.rolling("avg", f.source, f.hours, f.name),
            "sum": lambda f: sql.rolling("sum", f.source, f.hours, f.name),
            "std": lambda f: sql.rolling("stddev_samp", f.source, f.hours, f.name),
            "change": lambda f: sql.change(f.source, f.name, f.hours)}
    names = [f.name for f in wanted]
    sources = sorted({f.source for f in wanted})

    @query(name, _over_obs([made[f.kind](f) for f in wanted], names))
    def run(spark, sf_dir):
        obs = tables.observations(spark, sf_dir).select("station", "ts", *sources)
        return features.add(obs, wanted).select("station", "ts", *names)


_subset("aqi_lags", [lag("us_aqi", k) for k in features.LAG_HOURS["us_aqi"]])
_subset("aqi_rolling_mean", [mean("us_aqi", n) for n in features.MEAN_HOURS["us_aqi"]])
_subset("change_rate", [change(n, s) for n, s in features.CHANGES.items()])
_subset("pm25_features", [lag("pm2_5", k) for k in features.LAG_HOURS["pm2_5"]] + [mean("pm2_5", 24)])
_subset("pm10_lags", [lag("pm10", k) for k in features.LAG_HOURS["pm10"]])
_subset("weather_lags", [lag(s, k) for s in ("temperature_2m", "wind_speed_10m", "relative_humidity_2m",
                                             "surface_pressure") for k in features.LAG_HOURS[s]])
_subset("pressure_roll", [mean("surface_pressure", 24)])
_subset("rolling_sum", [total(s, n) for s, ns in features.SUM_HOURS.items() for n in ns])
_subset("candidate_features", CANDIDATES)


@query("cyclic_time", shown(
    f"WITH {sql.SERIES} SELECT station, ts, {', '.join(sql.cycles())} FROM series", KEYS, " ".join(CYCLES)))
def cyclic_time(spark, sf_dir):
    return features.calendar(tables.series(spark, sf_dir).select("station", "ts"))


@query("feature_table", shown(
    f"WITH {sql.FEATURES} SELECT * FROM features", KEYS, " ".join(FEATURE_COLUMNS)))
def feature_table(spark, sf_dir):
    return features.build(tables.observations(spark, sf_dir))


@query("derive_missing_features", shown(
    f"WITH {sql.FEATURES} SELECT * FROM features", KEYS, " ".join(["us_aqi_lag_1h", *REBUILT])))
def derive_missing_features(spark, sf_dir):
    obs = tables.observations(spark, sf_dir).select("station", "ts", "us_aqi", "pm2_5", "surface_pressure")
    stored = session.store(features.add(obs, [lag("us_aqi", 1)]), "features")
    return features.ensure(stored, ["us_aqi_lag_1h", *REBUILT]).select(
        "station", "ts", "us_aqi_lag_1h", *REBUILT)


@query("targets_row", shown(
    f"WITH {sql.SMALL_TARGETS} SELECT * FROM targets", KEYS, "us_aqi " + " ".join(HORIZONS)))
def targets_row(spark, sf_dir):
    return features.targets(tables.series(spark, sf_dir).select("station", "ts", "us_aqi"))


_AHEAD = " ".join(
    f"LEFT JOIN series AS s{k} ON s{k}.station = s.station AND s{k}.ts = s.ts + INTERVAL {k} HOUR"
    for k in HORIZONS.values())


@query("targets_time", shown(
    f"WITH {sql.SERIES} SELECT s.station, s.ts, s.us_aqi, "
    + ", ".join(f"s{k}.us_aqi AS {name}" for name, k in HORIZONS.items())
    + f" FROM series AS s {_AHEAD}", KEYS, "us_aqi " + " ".join(HORIZONS)))
def targets_time(spark, sf_dir):
    return features.targets(tables.series(spark, sf_dir).select("station", "ts", "us_aqi"), mode="time")


_BACK = " ".join(
    f"LEFT JOIN series AS s{k} ON s{k}.station = s.station AND s{k}.ts = s.ts - INTERVAL {k} HOUR"
    for k in (1, 24, 96))
_RANGE = f"OVER ({sql.BY_STATION} RANGE BETWEEN INTERVAL 23 HOURS PRECEDING AND CURRENT ROW)"


@query("aqi_lag_time", shown(
    f"WITH {sql.SERIES} SELECT s.station, s.ts, s1.us_aqi AS us_aqi_lag_1h, s24.us_aqi AS us_aqi_lag_24h, "
    f"s96.us_aqi AS us_aqi_lag_96h, w.us_aqi_rolling_mean_24h FROM series AS s {_BACK} JOIN ("
    f"SELECT station, ts, CASE WHEN count(us_aqi) {_RANGE} = 24 THEN avg(us_aqi) {_RANGE} END "
    "AS us_aqi_rolling_mean_24h FROM series) AS w ON w.station = s.station AND w.ts = s.ts",
    KEYS, "us_aqi_lag_1h us_aqi_lag_24h us_aqi_lag_96h us_aqi_rolling_mean_24h"))
def aqi_lag_time(spark, sf_dir):
    wanted = [lag("us_aqi", k) for k in (1, 24, 96)] + [mean("us_aqi", 24)]
    hours = tables.series(spark, sf_dir).select("station", "ts", "us_aqi")
    return features.add(hours, wanted, mode="time").drop("us_aqi")


@query("complete_cases", shown(
    f"WITH {sql.TRAINING} SELECT * FROM features WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLUMNS + list(HORIZONS)),
    KEYS, " ".join(FEATURE_COLUMNS + list(HORIZONS))))
def complete_cases(spark, sf_dir):
    return features.complete(features.build(tables.observations(spark, sf_dir), HORIZONS))


@query("fill_zero", shown(
    f"WITH {sql.OBS} SELECT station, ts, coalesce(wind_speed_10m, 0) AS wind_speed_10m, us_aqi, "
    f"coalesce({sql.lag('us_aqi', 24).split(' AS ')[0]}, 0) AS us_aqi_lag_24h FROM obs",
    KEYS, "wind_speed_10m us_aqi us_aqi_lag_24h"))
def fill_zero(spark, sf_dir):
    obs = tables.observations(spark, sf_dir).select("station", "ts", "wind_speed_10m", "us_aqi")
    return features.add(obs, [lag("us_aqi", 24)]).na.fill(0.0)


_ALIGNED = ["us_aqi", "wind_speed_10m", "us_aqi_lag_24h", "uv_index"]


@query("align_features", shown(
    f"WITH {sql.FEATURES} SELECT station, ts, coalesce(us_aqi, 0) AS us_aqi, "
    "coalesce(wind_speed_10m, 0) AS wind_speed_10m, coalesce(us_aqi_lag_24h, 0) AS us_aqi_lag_24h, "
    "0.0 AS uv_index, 1 + CASE WHEN us_aqi IS NULL THEN 1 ELSE 0 END "
    "+ CASE WHEN wind_speed_10m IS NULL THEN 1 ELSE 0 END "
    "+ CASE WHEN us_aqi_lag_24h IS NULL THEN 1 ELSE 0 END AS n_missing FROM features",
    KEYS + " n_missing", " ".join(_ALIGNED)))
def align_features(spark, sf_dir):
    obs = tables.observations(spark, sf_dir).select("station", "ts", "us_aqi", "wind_speed_10m")
    return features.align(features.add(obs, [lag("us_aqi", 24)]), _ALIGNED)


@query("peak_ramp", shown(
    f"WITH {sql.SERIES}, steps AS (SELECT station, ts, us_aqi, {sql.change('us_aqi', 'delta')}, "
    "row_number() OVER (PARTITION BY station ORDER BY ts) AS rn, "
    "row_number() OVER (PARTITION BY station ORDER BY us_aqi DESC, ts) AS top FROM series) "
    "SELECT s.station, s.ts, s.us_aqi, s.delta, s.rn - p.rn AS \"offset\" FROM steps AS s JOIN steps AS p "
    "ON p.station = s.station AND p.top = 1 AND abs(s.rn - p.rn) <= 5", KEYS + ' "offset"', "us_aqi delta"))
def peak_ramp(spark, sf_dir):
    return audits.peak_ramp(tables.series(spark, sf_dir))
