"""Split, weight, scaler, metric and analogue queries."""

from pyspark.sql import functions as F

from aerolith import session
from aerolith.operators import analogues, features, metrics, scaling, splits
from aerolith.operators.features import FEATURE_COLUMNS, HORIZONS, mean
from aerolith.operators.series import INDEX
from aerolith.plans import sql
from aerolith.plans.registry import query, shown
from aerolith.sources import forecasts, tables

KEYS = "station ts"
INDEXED = f"{sql.SMALL_TARGETS}, {sql.INDEXED.format(source='targets')}"


def _rows(spark, sf_dir):
    return tables.series(spark, sf_dir).select("station", "ts", "us_aqi")


def _targets(spark, sf_dir):
    """Targets with their row numbers, so that a split need not number again."""
    return features.targets(_rows(spark, sf_dir), keep=INDEX)


@query("chrono_split", f"WITH {INDEXED} SELECT station, ts, "
       "CASE WHEN idx < floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM indexed")
def chrono_split(spark, sf_dir):
    return splits.chrono(_rows(spark, sf_dir)).drop("us_aqi")


def _starts(val=0.0):
    return f"""cuts AS (SELECT *, floor(n * (1 - 0.2::DOUBLE)) AS c2,
      floor(n * (1 - (0.2::DOUBLE + {val}::DOUBLE))) AS c1 FROM indexed),
    starts AS (SELECT station, min(ts) FILTER (WHERE idx >= c2) AS test_start,
      min(ts) FILTER (WHERE idx >= c1) AS val_start FROM cuts GROUP BY 1)"""


@query("embargo_split", f"WITH {INDEXED}, {_starts()} SELECT c.station, ts, CASE WHEN idx >= c2 THEN 'test' "
       "WHEN ts + INTERVAL 72 HOUR < test_start THEN 'train' ELSE 'embargo' END AS split "
       "FROM cuts AS c JOIN starts AS s ON s.station = c.station")
def embargo_split(spark, sf_dir):
    return splits.embargoed(_rows(spark, sf_dir)).drop("us_aqi")


_THREE = ("CASE WHEN idx >= c2 THEN 'test' WHEN idx >= c1 THEN CASE WHEN ts + INTERVAL 72 HOUR < test_start "
          "THEN 'validation' ELSE 'embargo' END WHEN ts + INTERVAL 72 HOUR < val_start THEN 'train' ELSE 'embargo' END")


@query("three_way_split", f"WITH {INDEXED}, {_starts(0.2)} SELECT c.station, ts, {_THREE} AS split "
       "FROM cuts AS c JOIN starts AS s ON s.station = c.station")
def three_way_split(spark, sf_dir):
    return splits.embargoed(_rows(spark, sf_dir), val_ratio=0.2).drop("us_aqi")


@query("ablation_split", f"WITH {INDEXED}, {_starts(0.2)}, s AS (SELECT c.station, ts, {_THREE} AS split "
       "FROM cuts AS c JOIN starts AS s ON s.station = c.station) SELECT station, ts, split AS split_all, "
       "CASE WHEN split = 'train' AND ts < TIMESTAMP '2024-01-09' THEN 'unused' ELSE split END AS split_recent FROM s")
def ablation_split(spark, sf_dir):
    """The same test rows with all and with only the recent training rows."""
    rows = session.store(splits.indexed(_rows(spark, sf_dir)), "indexed")
    whole = splits.embargoed(rows, val_ratio=0.2).withColumnRenamed("split", "split_all")
    recent = splits.embargoed(rows, val_ratio=0.2, train_since="2024-01-09").select(
        "station", "ts", F.col("split").alias("split_recent"))
    return whole.join(recent, ["station", "ts"]).drop("us_aqi")


@query("ts_folds", f"WITH {INDEXED}, f AS (SELECT *, n - (4 - fold) * (n // 4) AS start, n // 4 AS size "
       "FROM indexed, range(1, 4) AS r(fold)), g AS (SELECT *, min(ts) FILTER (WHERE idx >= start AND idx < start + size) "
       "OVER (PARTITION BY station, fold) AS test_start FROM f) SELECT station, ts, fold, "
       "CASE WHEN idx < start THEN 'train' ELSE 'test' END AS role FROM g "
       "WHERE idx < start + size AND (idx >= start OR ts + INTERVAL 72 HOUR < test_start)")
def ts_folds(spark, sf_dir):
    return splits.folds(_rows(spark, sf_dir), 3).drop("us_aqi")


@query("window_consistency", f"WITH {INDEXED}, t AS (SELECT * FROM indexed WHERE idx >= floor(n * (1 - 0.2::DOUBLE))) "
       + " UNION ALL ".join(
           f"SELECT station, '{h}' AS horizon, count({h}) AS rows, min(ts) FILTER (WHERE {h} IS NOT NULL) AS first_ts, "
           f"max(ts) FILTER (WHERE {h} IS NOT NULL) AS last_ts FROM t GROUP BY station" for h in HORIZONS))
def window_consistency(spark, sf_dir):
    test = splits.chrono(_targets(spark, sf_dir)).where("split = 'test'")
    return splits.window_consistency(test, list(HORIZONS))


_TRAIN = f"{INDEXED}, train AS (SELECT * FROM indexed WHERE idx < floor(n * (1 - 0.2::DOUBLE)))"


def _train(spark, sf_dir):
    """Training rows, written once: fitting a weight and applying it read them twice."""
    return session.store(splits.chrono(_targets(spark, sf_dir)).where("split = 'train'").drop("split"), "train")


@query("recency_weights", shown(
    f"WITH {_TRAIN}, w AS (SELECT station, ts, exp(-0.5 * date_diff('second', ts, max(ts) OVER (PARTITION BY station)) "
    "/ (365.25 * 24 * 3600)) AS w FROM train) "
    "SELECT station, ts, w / avg(w) OVER (PARTITION BY station) AS weight_recency FROM w", KEYS, "weight_recency"))
def recency_weights(spark, sf_dir):
    return splits.recency_weight(_train(spark, sf_dir)).select("station", "ts", "weight_recency")


@query("smog_weights", shown(
    f"WITH {_TRAIN}, w AS (SELECT station, ts, CASE WHEN us_aqi > 150 OR aqi_day2 > 150 THEN 2.5 ELSE 1.0 END AS w "
    "FROM train) SELECT station, ts, w / avg(w) OVER (PARTITION BY station) AS weight_event FROM w",
    KEYS, "weight_event"))
def smog_weights(spark, sf_dir):
    return splits.event_weight(_train(spark, sf_dir), splits.smog()).select("station", "ts", "weight_event")


_SCALED = [*FEATURE_COLUMNS, "flat"]
_SCALED_SQL = f"""{sql.FEATURES}, numbered AS (SELECT station, ts, {', '.join(FEATURE_COLUMNS)}, 3.0::DOUBLE AS flat,
    row_number() OVER (PARTITION BY station ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY station) AS n FROM features),
  fitted AS (SELECT * FROM numbered WHERE idx < floor(n * (1 - 0.2::DOUBLE)))"""


def _standard(c):
    return f"avg({c}) AS {c}_c, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS {c}_s"


def _robust(c):
    box = f"(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"
    return f"median({c}) AS {c}_c, CASE WHEN {box} = 0 THEN 1 ELSE {box} END AS {c}_s"


def _scaled_sql(parameters):
    return shown(
        f"WITH {_SCALED_SQL}, p AS (SELECT station AS st, {', '.join(map(parameters, _SCALED))} FROM fitted GROUP BY 1) "
        f"SELECT station, ts, {', '.join(f'({c} - {c}_c) / {c}_s AS {c}' for c in _SCALED)} "
        "FROM numbered JOIN p ON p.st = numbered.station", KEYS, " ".join(_SCALED))


def _to_scale(spark, sf_dir):
    built = features.build(tables.observations(spark, sf_dir)).withColumn("flat", F.lit(3.0)).select("station", "ts", *_SCALED)
    return session.store(splits.chrono(session.store(built, "features")), "to-scale")


def _scale(spark, sf_dir, kind, through=lambda params: params):
    """Parameters come from training rows only and are applied to all rows."""
    rows = _to_scale(spark, sf_dir)
    params = through(scaling.fit(rows.where("split = 'train'"), _SCALED, kind))
    return scaling.apply(rows, params, _SCALED).drop("split")


@query("standard_scale", _scaled_sql(_standard))
def standard_scale(spark, sf_dir):
    return _scale(spark, sf_dir, "standard")


@query("robust_scale", _scaled_sql(_robust))
def robust_scale(spark, sf_dir):
    return _scale(spark, sf_dir, "robust")


@query("scale_with_saved", _scaled_sql(_standard))
def scale_with_saved(spark, sf_dir):
    return _scale(spark, sf_dir, "standard", lambda params: session.store(params, "scaler"))


# Two forecasts beside each other: persistence and the mean of the last day.
_ERRORS = f"""{sql.SERIES}, f AS (SELECT station, ts, us_aqi, {', '.join(sql.horizon_leads())},
    {sql.rolling('avg', 'us_aqi', 24, 'm24')}, {sql.rolling('avg', 'us_aqi', 72, 'm72')} FROM series),
  e AS (""" + " UNION ALL ".join(
    f"SELECT station, ts, us_aqi, '{h}' AS horizon, '{m}' AS model, {h} AS t, {p} AS p FROM f"
    for h in HORIZONS for m, p in (("persistence", "us_aqi"), ("mean_24h", "m24"), ("mean_72h", "m72"))) + ")"


def _score(by, where="true"):
    return (f"SELECT {by}, count(*) AS n, sqrt(avg((t - p) * (t - p))) AS rmse, avg(abs(t - p)) AS mae, "
            f"1 - avg((t - p) * (t - p)) / nullif(var_pop(t), 0) AS r2 FROM e "
            f"WHERE t IS NOT NULL AND p IS NOT NULL AND {where} GROUP BY {by}")


@query("persistence_metrics", shown(
    f"WITH {_ERRORS} {_score('station, horizon', chr(39).join(['model = ', 'persistence', '']))}",
    "station horizon n", "rmse mae r2"))
def persistence_metrics(spark, sf_dir):
    return metrics.persistence(_targets(spark, sf_dir), list(HORIZONS), by=("station", "horizon"), keep=("station",))


def _forecasts(spark, sf_dir):
    """Long rows of truth and prediction for three simple models."""
    wide = features.add(_rows(spark, sf_dir), [mean("us_aqi", 24), mean("us_aqi", 72)], HORIZONS)
    models = {"persistence": "us_aqi", "mean_24h": "us_aqi_rolling_mean_24h", "mean_72h": "us_aqi_rolling_mean_72h"}
    rows = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("model"), F.col(h).alias("truth"), F.col(c).alias("pred"))
        for h in HORIZONS for m, c in models.items()])
    return wide.select("station", "ts", "us_aqi", F.inline(rows))


@query("forecast_metrics", shown(f"WITH {_ERRORS} {_score('station, horizon, model')}",
                                 "station horizon model n", "rmse mae r2"))
def forecast_metrics(spark, sf_dir):
    return metrics.regression(_forecasts(spark, sf_dir), "truth", "pred", ["station", "horizon", "model"])


_COMPARED = f"""WITH {_ERRORS}, m AS ({_score('station, horizon, model')}),
c AS (SELECT m.*, b.rmse AS base_rmse, b.mae AS base_mae, b.r2 AS base_r2,
    (b.rmse - m.rmse) / nullif(b.rmse, 0) * 100 AS rmse_improvement_pct,
    (b.mae - m.mae) / nullif(b.mae, 0) * 100 AS mae_improvement_pct,
    m.rmse < b.rmse AS beats_rmse, m.mae < b.mae AS beats_mae, m.rmse < b.rmse AND m.mae < b.mae AS beats_baseline
  FROM m JOIN m AS b ON b.station = m.station AND b.horizon = m.horizon AND b.model = 'persistence'
  WHERE m.model <> 'persistence')"""


def _compared(spark, sf_dir):
    scores = session.store(forecast_metrics(spark, sf_dir), "scores")
    baseline = scores.where("model = 'persistence'")
    return metrics.against(scores.where("model <> 'persistence'"), baseline, ["station", "horizon"])


@query("improvement", shown(
    f"{_COMPARED} SELECT * FROM c", "station horizon model n",
    "rmse mae r2 base_rmse base_mae base_r2 rmse_improvement_pct mae_improvement_pct"))
def improvement(spark, sf_dir):
    return _compared(spark, sf_dir)


@query("baseline_gate", f"{_COMPARED} SELECT station, horizon, model, beats_rmse, beats_mae, beats_baseline FROM c")
def baseline_gate(spark, sf_dir):
    return metrics.gate(_compared(spark, sf_dir)).select(
        "station", "horizon", "model", "beats_rmse", "beats_mae", "beats_baseline")


_DECLARED = "declared(horizon, title, max_mae, max_rmse, min_r2) AS (VALUES " + ", ".join(
    f"('{h}', '{t}', {a}, {b}, {c})" for h, t, a, b, c, _ in metrics.TARGETS) + ")"


@query("benchmark_compliance", shown(
    f"{_COMPARED}, {_DECLARED}, j AS (SELECT c.*, title, mae <= max_mae AS meets_mae, rmse <= max_rmse AS meets_rmse, "
    "r2 >= min_r2 AS meets_r2 FROM c JOIN declared AS d ON d.horizon = c.horizon) "
    "SELECT *, beats_baseline AND meets_mae AND meets_rmse AND meets_r2 AS meets_all, "
    "CASE WHEN beats_baseline AND meets_mae AND meets_rmse AND meets_r2 THEN 'MET' "
    "WHEN beats_baseline THEN 'BEATS BASELINE' ELSE 'REJECTED' END AS status FROM j",
    "station horizon model title meets_mae meets_rmse meets_r2 meets_all beats_baseline status",
    "rmse mae r2 base_rmse base_mae"))
def benchmark_compliance(spark, sf_dir):
    return metrics.compliance(metrics.gate(_compared(spark, sf_dir))).select(
        "station", "horizon", "model", "title", "meets_mae", "meets_rmse", "meets_r2", "meets_all",
        "beats_baseline", "status", "rmse", "mae", "r2", "base_rmse", "base_mae")


@query("regime_metrics", shown(
    f"WITH {_ERRORS.replace('  e AS (', '  e0 AS (')}, e AS (SELECT *, CASE WHEN us_aqi > 150 THEN 'heavy' "
    f"ELSE 'calm' END AS regime FROM e0) {_score('horizon, model, regime')}",
    "horizon model regime n", "rmse mae r2"))
def regime_metrics(spark, sf_dir):
    return metrics.regimes(_forecasts(spark, sf_dir), "us_aqi", by=("horizon", "model"))


_VALIDATION = f"""indexed AS (SELECT station, ts, row_number() OVER (PARTITION BY station ORDER BY ts) - 1 AS idx,
    count(*) OVER (PARTITION BY station) AS n FROM series), {_starts(0.15)},
  held AS (SELECT c.station, ts FROM cuts AS c JOIN starts AS s ON s.station = c.station WHERE {_THREE} = 'validation')"""


@query("select_winner", shown(
    f"WITH {_ERRORS}, {_VALIDATION}, m AS ("
    + _score("horizon, model", "(station, ts) IN (SELECT (station, ts) FROM held)")
    + "), r AS (SELECT *, row_number() OVER "
    "(PARTITION BY horizon ORDER BY rmse, model) AS place FROM m) SELECT horizon, model AS winner, rmse AS winner_rmse, "
    "CASE WHEN horizon = 'aqi_day2' THEN 'mean_24h' ELSE model END AS chosen, "
    "CASE WHEN horizon = 'aqi_day2' THEN model <> 'mean_24h' ELSE false END AS overridden FROM r WHERE place = 1",
    "horizon winner chosen overridden", "winner_rmse"))
def select_winner(spark, sf_dir):
    """The model with the least error on the validation part; the test part is not looked at."""
    held = splits.embargoed(_rows(spark, sf_dir), val_ratio=0.15).where("split = 'validation'").select("station", "ts")
    rows = _forecasts(spark, sf_dir).join(held, ["station", "ts"], "left_semi")
    scores = metrics.regression(rows, "truth", "pred", ["horizon", "model"])
    return metrics.select_winner(scores, override={"aqi_day2": "mean_24h"})


@query("cosine_topk", shown("""
  WITH q AS (SELECT vec_id, embedding FROM embeddings ORDER BY vec_id DESC LIMIT 1),
  s AS (SELECT e.vec_id, e.label, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])
    / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))
     * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS similarity
    FROM embeddings AS e, q WHERE e.vec_id <> q.vec_id)
  SELECT * FROM s ORDER BY similarity DESC, vec_id LIMIT 10""", "vec_id label", "similarity"))
def cosine_topk(spark, sf_dir):
    vectors = tables.vectors(spark, sf_dir)
    newest = vectors.orderBy(F.desc("vec_id")).limit(1)
    return analogues.nearest(vectors, newest, 10).select("vec_id", "label", "similarity")


def similar_sql(columns):
    """CTEs from the feature rows to the table `similar_days`."""
    def z(table, c):
        return f"(({table}.{c} - p.{c}_c) / p.{c}_s)"

    def length(table):
        total = " + ".join(f"{z(table, c)} * {z(table, c)}" for c in columns)
        return f"CASE WHEN {total} = 0 THEN 1 ELSE sqrt({total}) END"

    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"""rows_known AS (SELECT * FROM features WHERE {known}),
p AS (SELECT station, max(ts) AS now_ts, {', '.join(map(_standard, columns))} FROM rows_known GROUP BY 1),
now_row AS (SELECT r.* FROM rows_known AS r JOIN p ON p.station = r.station AND p.now_ts = r.ts),
scored AS (SELECT r.*, p.now_ts, ({' + '.join(f"{z('r', c)} * {z('q', c)}" for c in columns)})
    / (({length('r')}) * ({length('q')})) AS cosine
  FROM rows_known AS r JOIN p ON p.station = r.station JOIN now_row AS q ON q.station = r.station
  WHERE r.ts < p.now_ts),
usable AS (SELECT *, ts <= now_ts - INTERVAL 7 DAY AS old, max(CASE WHEN ts <= now_ts - INTERVAL 7 DAY THEN 1 ELSE 0 END)
    OVER (PARTITION BY station) AS any_old FROM scored),
best AS (SELECT *, row_number() OVER (PARTITION BY station, CAST(ts AS DATE) ORDER BY cosine DESC, ts) AS of_day
  FROM usable WHERE old OR any_old = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY cosine DESC, ts) AS place FROM best WHERE of_day = 1),
similar_days AS (SELECT station, place, strftime(ts, '%b %d, %Y') AS date,
  CAST(round_even(us_aqi, 0) AS INTEGER) AS historical_aqi,
  cosine, round_even((cosine + 1) / 2 * 100, 1) AS similarity, round_even(wind_speed_10m, 1) AS wind,
  round_even(relative_humidity_2m, 1) AS humidity, round_even(relative_humidity_2m, 1) > 70 AS humidity_high
FROM ranked WHERE place <= 4)"""


@query("analogue_days", shown(f"WITH {sql.FEATURES}, {similar_sql(FEATURE_COLUMNS)} SELECT * FROM similar_days", "station place date historical_aqi humidity_high",
                              "cosine similarity wind humidity"))
def analogue_days(spark, sf_dir):
    built = session.store(features.build(tables.observations(spark, sf_dir)), "features")
    found = analogues.top_days(built, FEATURE_COLUMNS)
    return session.store(found, "analogues")


_ISSUED_SQL = f"""{sql.SERIES}, rolled AS (SELECT station, ts, us_aqi, {sql.rolling('avg', 'us_aqi', 24, 'mean_24h')} FROM series),
issued AS (SELECT station, model, horizon, ts AS issued, ts + hours * INTERVAL 1 HOUR AS valid,
    CASE model WHEN 'persistence' THEN us_aqi ELSE mean_24h END AS prediction
  FROM rolled, (VALUES ('persistence'), ('mean_24h')) AS m(model),
       (VALUES {', '.join(f"('{h}', {k})" for h, k in HORIZONS.items())}) AS h(horizon, hours)),
pairs AS (SELECT i.*, s.us_aqi AS truth FROM issued AS i LEFT JOIN series AS s ON s.station = i.station AND s.ts = i.valid
  WHERE prediction IS NOT NULL)"""


@query("forecast_vs_truth", shown(
    f"WITH {_ISSUED_SQL} SELECT station, model, horizon, count(*) AS issued, count(truth) AS n, count(*) - count(truth) AS pending, "
    "sqrt(avg((truth - prediction) * (truth - prediction))) AS rmse, avg(abs(truth - prediction)) AS mae, "
    "1 - avg((truth - prediction) * (truth - prediction)) / nullif(var_pop(truth), 0) AS r2 FROM pairs GROUP BY 1, 2, 3",
    "station model horizon issued n pending", "rmse mae r2"))
def forecast_vs_truth(spark, sf_dir):
    """Forecasts of every hour, stored in two runs, against observations that arrive later in four scrambled deliveries, one of them twice."""
    rows = session.store(features.add(_rows(spark, sf_dir), [mean("us_aqi", 24)]), "issued")
    long = forecasts.lead_forecasts(rows, HORIZONS, {"persistence": "us_aqi", "mean_24h": "us_aqi_rolling_mean_24h"})
    path, truth = session.scratch(spark, "forecasts"), session.scratch(spark, "truth")
    part = F.pmod(F.xxhash64("station", F.to_date("ts")), F.lit(4))
    for publish in (long.where("hour(issued) < 12"), long):
        forecasts.publish(spark, publish, path)
    for delivery in (2, 0, 3, 1, 0):
        forecasts.mature(spark, rows.where(part == delivery), path, truth)
    return forecasts.scores(spark, path, truth)
