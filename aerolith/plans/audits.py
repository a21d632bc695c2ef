"""Audit and profile queries."""

from pyspark.sql import functions as F

from aerolith import session
from aerolith.functions.columns import BANDS
from aerolith.operators import audits, correlation, features, metrics
from aerolith.operators.features import HORIZONS, lag
from aerolith.plans import sql
from aerolith.plans.registry import query, shown
from aerolith.sources import tables



def _written(hours):
    """The hourly table an audit reads several times, written once; the raw tables
    are then read once."""
    return session.store(hours, "hours")


_AUDITED = ["station", "ts", *features.FEATURE_COLUMNS]


@query("missing_audit", shown(
    f"WITH {sql.FEATURES} SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
        f"(count(*) - count({c})) * 100.0 / count(*) AS missing_pct FROM features" for c in _AUDITED)
    + ") AS u WHERE missing_count > 0", "column_name missing_count", "missing_pct"))
def missing_audit(spark, sf_dir):
    return audits.missing(features.build(tables.observations(spark, sf_dir)), _AUDITED).orderBy(
        F.desc("missing_count"), "column_name")


@query("gap_audit", shown(
    f"WITH {sql.SERIES}, steps AS (SELECT station, ts, lag(ts) OVER ({sql.BY_STATION}) AS previous_ts FROM series) "
    "SELECT *, date_diff('second', previous_ts, ts) / 3600.0 AS gap_hours FROM steps "
    "WHERE ts - previous_ts > INTERVAL 1 HOUR", "station ts previous_ts", "gap_hours"))
def gap_audit(spark, sf_dir):
    return audits.gaps(tables.series(spark, sf_dir))


@query("dataset_summary", f"WITH {sql.OBS} SELECT station, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, "
       "22 AS columns FROM obs GROUP BY station")
def dataset_summary(spark, sf_dir):
    return audits.summary(tables.observations(spark, sf_dir))


_STATS = ("avg(us_aqi) AS mean_us_aqi, stddev_samp(us_aqi) AS std_us_aqi, median(us_aqi) AS median_us_aqi")


@query("diurnal_profile", shown(
    f"WITH {sql.SERIES} SELECT station, hour(ts) AS hour, {_STATS} FROM series GROUP BY 1, 2",
    "station hour", "mean_us_aqi std_us_aqi median_us_aqi"))
def diurnal_profile(spark, sf_dir):
    return audits.diurnal(tables.series(spark, sf_dir))


@query("peak_hour", shown(
    f"WITH {sql.SERIES}, h AS (SELECT station, hour(ts) AS hour, avg(us_aqi) AS m FROM series GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY m DESC, hour) AS down, "
    "row_number() OVER (PARTITION BY station ORDER BY m, hour) AS up FROM h) "
    "SELECT a.station, a.hour AS peak_hour, a.m AS peak_mean, b.hour AS lowest_hour, b.m AS lowest_mean "
    "FROM r AS a JOIN r AS b ON a.station = b.station AND a.down = 1 AND b.up = 1",
    "station peak_hour lowest_hour", "peak_mean lowest_mean"))
def peak_hour(spark, sf_dir):
    return audits.peak_hours(tables.series(spark, sf_dir))


def _spine(column, values):
    return f"SELECT s.station, v.{column} FROM (SELECT DISTINCT station FROM daily) AS s, range({values}) AS v({column})"


@query("weekday_profile", shown(
    f"WITH {sql.DAILY}, g AS (SELECT station, isodow(ts) - 1 AS weekday, {_STATS} FROM daily GROUP BY 1, 2) "
    f"SELECT p.station, p.weekday, CASE p.weekday WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday' "
    "WHEN 3 THEN 'Thursday' WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday' ELSE 'Sunday' END AS day_name, "
    f"mean_us_aqi, std_us_aqi, median_us_aqi FROM ({_spine('weekday', '0, 7')}) AS p "
    "LEFT JOIN g ON g.station = p.station AND g.weekday = p.weekday",
    "station weekday day_name", "mean_us_aqi std_us_aqi median_us_aqi"))
def weekday_profile(spark, sf_dir):
    return audits.weekdays(tables.daily(spark, sf_dir))


@query("monthly_profile", shown(
    f"WITH {sql.DAILY}, g AS (SELECT station, month(ts) AS month, {_STATS} FROM daily GROUP BY 1, 2) "
    "SELECT p.station, p.month, strftime(make_date(2000, CAST(p.month AS INTEGER), 1), '%b') AS month_name, "
    f"mean_us_aqi, std_us_aqi FROM ({_spine('month', '1, 13')}) AS p "
    "LEFT JOIN g ON g.station = p.station AND g.month = p.month",
    "station month month_name", "mean_us_aqi std_us_aqi"))
def monthly_profile(spark, sf_dir):
    return audits.months(tables.daily(spark, sf_dir))


@query("season_contrast", shown(
    f"WITH {sql.DAILY} SELECT station, avg(us_aqi) FILTER (WHERE month(ts) IN (11, 12, 1, 2)) AS winter_mean, "
    "avg(us_aqi) FILTER (WHERE month(ts) NOT IN (11, 12, 1, 2)) AS rest_mean FROM daily GROUP BY station",
    "station", "winter_mean rest_mean"))
def season_contrast(spark, sf_dir):
    return audits.season_contrast(tables.daily(spark, sf_dir))


@query("yoy_summary", shown(
    f"WITH {sql.DAILY} SELECT station, year(ts) AS year, count(us_aqi) AS count_us_aqi, max(us_aqi) AS max_us_aqi, "
    f"{_STATS} FROM daily GROUP BY 1, 2",
    "station year count_us_aqi", "mean_us_aqi median_us_aqi std_us_aqi max_us_aqi"))
def yoy_summary(spark, sf_dir):
    return audits.years(tables.daily(spark, sf_dir))


@query("rain_contrast", shown(
    f"WITH {sql.OBS} SELECT station, coalesce(precipitation > 0.1, false) AS has_rain, count(us_aqi) AS count_us_aqi, "
    f"{_STATS} FROM obs GROUP BY 1, 2",
    "station has_rain count_us_aqi", "mean_us_aqi median_us_aqi std_us_aqi"))
def rain_contrast(spark, sf_dir):
    return audits.rain_contrast(_written(
        tables.observations(spark, sf_dir).select("station", "ts", "precipitation", "us_aqi")))


_LABELS = [label for _, label, _ in BANDS] + ["Unknown"]
_VALUE_BAND = "CASE " + " ".join(f"WHEN value <= {u} THEN '{t}'" for u, t, _ in BANDS[:-1]) \
    + f" WHEN value IS NOT NULL THEN '{BANDS[-1][1]}' ELSE 'Unknown' END"


@query("aqi_categories", shown(
    f"WITH {sql.READINGS}, labels_in_order(place, category) AS (VALUES "
    + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_LABELS, 1))
    + f"), c AS (SELECT station, {_VALUE_BAND} AS category, count(*) AS hours FROM readings GROUP BY 1, 2), "
    "t AS (SELECT station, count(*) AS n FROM readings GROUP BY 1) "
    "SELECT t.station, place, l.category, coalesce(hours, 0) AS hours, coalesce(hours, 0) * 100.0 / n AS pct "
    "FROM t CROSS JOIN labels_in_order AS l LEFT JOIN c ON c.station = t.station AND c.category = l.category",
    "station place category hours", "pct"))
def aqi_categories(spark, sf_dir):
    return audits.bands(tables.readings(spark, sf_dir), "value")


@query("aqi_histogram", shown(
    f"WITH {sql.SERIES}, b AS (SELECT station, min(us_aqi) AS lo, max(us_aqi) AS hi FROM series GROUP BY 1), "
    "c AS (SELECT s.station, least(49, CAST(floor((us_aqi - lo) / (hi - lo) * 50) AS INTEGER)) AS bin, count(*) AS hours "
    "FROM series AS s JOIN b ON b.station = s.station GROUP BY 1, 2) "
    "SELECT b.station, r.bin, lo + r.bin * ((hi - lo) / 50) AS left_edge, coalesce(hours, 0) AS hours "
    "FROM b CROSS JOIN range(50) AS r(bin) LEFT JOIN c ON c.station = b.station AND c.bin = r.bin",
    "station bin hours", "left_edge"))
def aqi_histogram(spark, sf_dir):
    return audits.histogram(tables.series(spark, sf_dir), "us_aqi")


@query("box_stats", shown(
    f"WITH {sql.DAILY}, q AS (SELECT station, year(ts) AS year, quantile_cont(us_aqi, 0.25) AS q1, "
    "quantile_cont(us_aqi, 0.5) AS median, quantile_cont(us_aqi, 0.75) AS q3 FROM daily GROUP BY 1, 2) "
    "SELECT q.station, q.year, q1, median, q3, min(us_aqi) AS whisker_low, max(us_aqi) AS whisker_high "
    "FROM daily AS d JOIN q ON q.station = d.station AND q.year = year(d.ts) "
    "WHERE us_aqi BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 GROUP BY ALL",
    "station year", "q1 median q3 whisker_low whisker_high"))
def box_stats(spark, sf_dir):
    years = tables.daily(spark, sf_dir).withColumn("year", F.year("ts"))
    return audits.box_stats(years, ["station", "year"], "us_aqi")


# Interpolated edges written out: position p * (n - 1) between two ordered values.
_EDGES = """ordered AS (SELECT station, x, row_number() OVER (PARTITION BY station ORDER BY x) - 1 AS i,
    count(*) OVER (PARTITION BY station) AS n FROM points WHERE x IS NOT NULL),
wanted AS (SELECT DISTINCT o.station, p.p, round((p.p / 20.0::DOUBLE) * (n - 1), 9) AS h FROM ordered AS o, range(21) AS p(p)),
edges AS (SELECT DISTINCT w.station, a.x + (b.x - a.x) * (w.h - floor(w.h)) AS edge FROM wanted AS w
  JOIN ordered AS a ON a.station = w.station AND a.i = floor(w.h)
  JOIN ordered AS b ON b.station = w.station AND b.i = ceil(w.h)),
binned AS (SELECT t.station, t.x, t.y, greatest(1, (SELECT count(*) FROM edges AS e
    WHERE e.station = t.station AND e.edge < t.x)) AS bin FROM points AS t WHERE t.x IS NOT NULL)"""


@query("quantile_trend", shown(
    f"WITH {sql.OBS}, points AS (SELECT station, wind_gusts_10m AS x, us_aqi AS y FROM obs), {_EDGES} "
    "SELECT station, bin, avg(x) AS mean_wind_gusts_10m, avg(y) AS mean_us_aqi, count(*) AS hours "
    "FROM binned GROUP BY 1, 2", "station bin hours", "mean_wind_gusts_10m mean_us_aqi"))
def quantile_trend(spark, sf_dir):
    return audits.quantile_trend(_written(
        tables.observations(spark, sf_dir).select("station", "wind_gusts_10m", "us_aqi")), "wind_gusts_10m", "us_aqi")


def _sql_corr(x, y):
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    spread = f"(stddev_pop({x}) {both} * stddev_pop({y}) {both})"
    return f"CASE WHEN {spread} > 0 THEN covar_pop({x}, {y}) / {spread} END"


@query("corr_pair", shown(
    f"WITH {sql.OBS} SELECT station, {_sql_corr('wind_speed_10m', 'us_aqi')} AS corr, "
    f"{_sql_corr('one', 'us_aqi')} AS corr_constant FROM (SELECT *, 1.0::DOUBLE AS one FROM obs) AS o GROUP BY station",
    "station", "corr corr_constant"))
def corr_pair(spark, sf_dir):
    obs = tables.observations(spark, sf_dir).withColumn("one", F.lit(1.0))
    pairs = correlation.matrix(obs, ["us_aqi", "wind_speed_10m", "one"])
    return pairs.where("column_b = 'us_aqi'").groupBy("station").agg(
        F.max(F.when(F.col("column_a") == "wind_speed_10m", F.col("corr"))).alias("corr"),
        F.max(F.when(F.col("column_a") == "one", F.col("corr"))).alias("corr_constant"))


MATRIX = ["us_aqi", "pm2_5", "pm10", "nitrogen_dioxide", "ozone", "temperature_2m",
          "relative_humidity_2m", "wind_speed_10m", "surface_pressure", "cloud_cover"]
PAIRS = [(a, b) for i, a in enumerate(MATRIX) for b in MATRIX[:i]]
MATRIX_SQL = f"""wide AS (SELECT station, {', '.join(f'{_sql_corr(a, b)} AS c{i}' for i, (a, b) in enumerate(PAIRS))}
  FROM obs GROUP BY station), matrix AS (""" + " UNION ALL ".join(
    f"SELECT station, '{a}' AS column_a, '{b}' AS column_b, c{i} AS corr FROM wide"
    for i, (a, b) in enumerate(PAIRS)) + ")"


@query("corr_matrix", shown(f"WITH {sql.OBS}, {MATRIX_SQL} SELECT * FROM matrix",
                            "station column_a column_b", "corr"))
def corr_matrix(spark, sf_dir):
    return correlation.matrix(tables.observations(spark, sf_dir), MATRIX)


def _acf_sql(lags):
    return (
        f"{sql.SERIES}, c AS (SELECT station, us_aqi - avg(us_aqi) OVER (PARTITION BY station) AS x, "
        "row_number() OVER (PARTITION BY station ORDER BY ts) AS i FROM series), "
        "d AS (SELECT station, count(*) AS n, sum(x * x) AS d FROM c GROUP BY 1), "
        f"a AS (SELECT c.station, k.k AS lag, sum(c.x * p.x) AS s FROM c JOIN range(1, {lags + 1}) AS k(k) ON true "
        "JOIN c AS p ON p.station = c.station AND p.i = c.i - k.k GROUP BY 1, 2), "
        "r AS (SELECT a.station, lag, n, s / d AS acf FROM a JOIN d ON d.station = a.station)")


@query("acf", shown(
    f"WITH {_acf_sql(120)} "
    "SELECT *, 1.959963984540054 * sqrt((1 + 2 * coalesce(sum(acf * acf) OVER (PARTITION BY station ORDER BY lag "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) AS band FROM r",
    "station lag n", "acf band"))
def acf(spark, sf_dir):
    return correlation.acf(_written(tables.series(spark, sf_dir).select("station", "ts", "us_aqi")))


# One recursion step per lag: the list `phi` holds the coefficients so far.
@query("pacf", shown(
    f"WITH RECURSIVE {_acf_sql(48)}, rho AS (SELECT station, n, list(acf ORDER BY lag) AS rho FROM r GROUP BY 1, 2), "
    "steps AS (SELECT station, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS phi, CAST(1 AS DOUBLE) AS err, "
    "CAST(NULL AS DOUBLE) AS pacf FROM rho UNION ALL "
    "SELECT station, k + 1, list_concat(list_transform(range(1, k + 1), lambda i: phi[i] - refl * phi[k + 1 - i]), [refl]), "
    "err * (1 - refl * refl), refl FROM (SELECT s.station, k, phi, err, (rho[k + 1] - coalesce(list_sum("
    "list_transform(range(1, k + 1), lambda i: phi[i] * rho[k + 1 - i])), 0)) / err AS refl "
    "FROM steps AS s JOIN rho ON rho.station = s.station WHERE k < 48) AS x) "
    "SELECT s.station, s.k AS lag, s.pacf, 1.959963984540054 / sqrt(n) AS band FROM steps AS s "
    "JOIN rho ON rho.station = s.station WHERE k > 0", "station lag", "pacf band"))
def pacf(spark, sf_dir):
    return correlation.pacf(_written(tables.series(spark, sf_dir).select("station", "ts", "us_aqi")))


@query("r2_identity", shown(
    f"WITH {sql.SMALL_TARGETS}, e AS ("
    + " UNION ALL ".join(f"SELECT '{h}' AS horizon, {h} AS t, us_aqi AS p FROM targets" for h in HORIZONS)
    + ") SELECT horizon, count(*) AS n, sqrt(avg((t - p) * (t - p))) AS rmse, avg(abs(t - p)) AS mae, "
    "1 - avg((t - p) * (t - p)) / var_pop(t) AS r2, min(t) AS min_truth, max(t) AS max_truth, avg(t) AS mean_truth, "
    "var_pop(t) AS var_truth, 1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)) AS r2_from_variance, "
    "true AS agrees FROM e WHERE t IS NOT NULL GROUP BY 1",
    "horizon n agrees", "rmse mae r2 min_truth max_truth mean_truth var_truth r2_from_variance"))
def r2_identity(spark, sf_dir):
    rows = features.targets(tables.series(spark, sf_dir).select("station", "ts", "us_aqi"))
    long = metrics.by_horizon(rows, {h: "us_aqi" for h in HORIZONS}, list(HORIZONS))
    return metrics.variance_identity(long, "truth", "pred", ["horizon"])
