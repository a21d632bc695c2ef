"""Training, scoring and explanation queries.

Iterative fits and sampled explanations have no SQL; tests check them against
known signals and identities. The booster runs fewer rounds here than by default.
"""

from pyspark.sql import functions as F

from aerolith import session
from aerolith.operators import correlation, explain, features, models, splits
from aerolith.operators.features import FEATURE_COLUMNS, HORIZONS, MEASURES, lag
from aerolith.operators.models import Config
from aerolith.plans import sql
from aerolith.plans.audits import MATRIX, MATRIX_SQL
from aerolith.plans.registry import query, shown
from aerolith.sources import outputs, tables

ROUNDS = {"maxIter": 20}


def _built(spark, sf_dir):
    """The feature table with its targets, written once."""
    return session.store(features.build(tables.observations(spark, sf_dir), HORIZONS), "features")


def _training(spark, sf_dir, columns=FEATURE_COLUMNS, built=None):
    """Complete rows with targets and split labels; both tables are written once, as
    numbering the rows and every fit read them again."""
    rows = features.complete(built or _built(spark, sf_dir)).select("station", "ts", *columns, *HORIZONS)
    return session.store(splits.embargoed(rows, test_ratio=0.2, val_ratio=0.15), "training")


def _configs(rounds=ROUNDS):
    third = models.DEFAULT["aqi_day3"]
    return {**models.DEFAULT, "aqi_day3": third._replace(options={**third.options, **rounds})}


def _one(spark, sf_dir, horizon, config):
    rows = _training(spark, sf_dir)
    return models.train_all(rows, FEATURE_COLUMNS, {horizon: config}, [horizon])[1]


@query("train_rff")
def train_rff(spark, sf_dir):
    return _one(spark, sf_dir, "aqi_day1", Config("kernel", "standard", "weight_recency"))


@query("train_gbt")
def train_gbt(spark, sf_dir):
    return _one(spark, sf_dir, "aqi_day3", Config("boosted", "none", None, ROUNDS))


@query("train_ridge")
def train_ridge(spark, sf_dir):
    return _one(spark, sf_dir, "aqi_day1", Config("ridge", "robust"))


@query("train_rf")
def train_rf(spark, sf_dir):
    return _one(spark, sf_dir, "aqi_day2", Config("forest", "none"))


@query("train_all")
def train_all(spark, sf_dir):
    return models.train_all(_training(spark, sf_dir), FEATURE_COLUMNS, _configs())[1]


@query("model_roundtrip", shown(
    f"WITH {sql.TRAINING} SELECT station, count(*) AS rows, 0.0::DOUBLE AS largest_difference FROM features WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLUMNS + list(HORIZONS)) + " GROUP BY station",
    "station rows", "largest_difference"))
def model_roundtrip(spark, sf_dir):
    """Predictions of a pipeline before saving and after loading, side by side."""
    rows = _training(spark, sf_dir)
    train = models.with_weights(rows.where("split = 'train'"))
    fitted = models.fit(train, FEATURE_COLUMNS, "aqi_day2", models.DEFAULT["aqi_day2"])
    path = session.scratch(spark, "model")
    models.save(fitted, path)
    both = models.predict(models.load(path), models.predict(fitted, rows, "before"), "after")
    return both.groupBy("station").agg(
        F.count("*").alias("rows"), F.max(F.abs(F.col("before") - F.col("after"))).alias("largest_difference"))


@query("score_latest")
def score_latest(spark, sf_dir):
    """The newest row of each station scored for all horizons."""
    built = _built(spark, sf_dir)
    fitted, _ = models.train_all(_training(spark, sf_dir, built=built), FEATURE_COLUMNS, {h: Config("ridge", "standard") for h in HORIZONS})
    scored = outputs.latest_rows(built.drop(*HORIZONS))
    for horizon, model in fitted.items():
        scored = models.score(scored, model, FEATURE_COLUMNS, max_missing=3, name=horizon)
    return scored.select("station", "ts", "us_aqi", "n_missing", "status",
                         *[c for h in HORIZONS for c in (f"raw_{h}", h)])


@query("top_importances")
def top_importances(spark, sf_dir):
    rows = _training(spark, sf_dir)
    model = models.fit(rows.where("split = 'train'"), FEATURE_COLUMNS, "aqi_day3",
                       Config("boosted", "none", None, ROUNDS))
    return models.importances(model, FEATURE_COLUMNS)


@query("feature_search")
def feature_search(spark, sf_dir):
    """Lags, rolling values, changes, cycles and the further candidates tried one after another on top of what is measured."""
    built = features.add(tables.observations(spark, sf_dir), features.STANDARD + features.CANDIDATES, HORIZONS)
    tried = [c for c in FEATURE_COLUMNS if c not in MEASURES] + [f.name for f in features.CANDIDATES]
    rows = features.complete(features.calendar(built).select("station", "ts", *MEASURES, *tried, *HORIZONS), MEASURES + tried + list(HORIZONS))
    parts = splits.embargoed(session.store(rows, "candidates"), test_ratio=0.2, val_ratio=0.15)
    return models.feature_search(session.store(parts, "searched"), MEASURES, tried, "aqi_day1")[1]


@query("cv_compare")
def cv_compare(spark, sf_dir):
    rows = _training(spark, sf_dir).drop("split")
    return models.compare_by_fold(rows, FEATURE_COLUMNS, "aqi_day2", {
        "ridge": Config("ridge", "robust"), "kernel": Config("kernel", "robust")}, n_splits=5)


def _explained(spark, sf_dir):
    return session.store(features.complete(_built(spark, sf_dir)).select("station", "ts", *FEATURE_COLUMNS, *HORIZONS), "explained")


#: Walks of a row in the queries; two to a pair.
_WALKS = 4
_NONLINEAR = {"forest": Config("forest", "none"), "kernel": Config("kernel", "standard")}


def _sampled(spark, sf_dir):
    """All rows and features explained, once for a forest and once for the kernel model: one row per model and hour."""
    rows = _explained(spark, sf_dir)
    tables_of = []
    for name, config in _NONLINEAR.items():
        model = models.fit(rows, FEATURE_COLUMNS, "aqi_day1", config)
        values = explain.shapley(model, rows, FEATURE_COLUMNS, rows, _WALKS)
        sums = values.groupBy("station", "ts").agg(
            F.sum("value").alias("total"), F.max("base").alias("base"), F.count("*").alias("features"),
            F.max_by("feature", F.abs("value")).alias("strongest"))
        tables_of.append(sums.join(models.predict(model, rows), ["station", "ts"]).select(
            F.lit(name).alias("model"), "station", "ts", "strongest", "features", "total", "base", "pred",
            (F.col("base") + F.col("total") - F.col("pred")).alias("residue")))
    return tables_of[0].unionByName(tables_of[1])


@query("shapley_sampled", digits=4)
def shapley_sampled(spark, sf_dir):
    """Values of a row add up to its prediction minus base."""
    return _sampled(spark, sf_dir).drop("features")


@query("shapley_identity", shown(
    f"WITH {sql.TRAINING} SELECT model, station, count(*) AS rows, {len(FEATURE_COLUMNS)} * count(*) AS shares, 0.0::DOUBLE AS largest_residue "
    "FROM features, (VALUES ('forest'), ('kernel')) AS m(model) WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLUMNS + list(HORIZONS)) + " GROUP BY 1, 2",
    "model station rows shares", "largest_residue"))
def shapley_identity(spark, sf_dir):
    """Per model and station: rows explained, shares given, and how far any row's shares miss its prediction."""
    return _sampled(spark, sf_dir).groupBy("model", "station").agg(
        F.count("*").alias("rows"), F.sum("features").alias("shares"), F.max(F.abs("residue")).alias("largest_residue"))


_LINEAR = FEATURE_COLUMNS
_SLOPES_SQL = f"""{sql.FEATURES}, t AS (SELECT *, {sql.lead('us_aqi', 24, 'aqi_day1')} FROM features),
s AS (SELECT station AS st, {', '.join(
    f'coalesce(CASE WHEN var_pop({c}) > 0 THEN regr_slope(aqi_day1, {c}) END, 0) AS {c}_b, avg({c}) AS {c}_m' for c in _LINEAR)}
  FROM t WHERE aqi_day1 IS NOT NULL GROUP BY 1)"""


@query("shapley_linear", shown(
    f"WITH {_SLOPES_SQL} " + " UNION ALL ".join(
        f"SELECT station, ts, '{c}' AS feature, {c}_b * ({c} - {c}_m) AS value FROM t JOIN s ON st = station"
        for c in _LINEAR), "station ts feature", "value"))
def shapley_linear(spark, sf_dir):
    built = features.build(tables.observations(spark, sf_dir), {"aqi_day1": 24}).select("station", "ts", *_LINEAR, "aqi_day1")
    rows = session.store(built, "targets")
    return explain.linear_shapley(rows.drop("aqi_day1"), explain.slopes(rows, _LINEAR, "aqi_day1"))


@query("fold_importance")
def fold_importance(spark, sf_dir):
    return explain.fold_importance(_explained(spark, sf_dir), FEATURE_COLUMNS, "aqi_day1", _NONLINEAR["forest"], samples=_WALKS)


_PRUNED = [*FEATURE_COLUMNS, "flat"]
_LEAST = 0.01
_FOLD_SQL = f"""WITH {sql.FEATURES}, t AS (SELECT *, 3.0::DOUBLE AS flat, {sql.lead('us_aqi', 24, 'aqi_day1')} FROM features),
known AS (SELECT station, ts, aqi_day1, {', '.join(_PRUNED)}, row_number() OVER (PARTITION BY station ORDER BY ts) - 1 AS idx,
  count(*) OVER (PARTITION BY station) AS n FROM t WHERE aqi_day1 IS NOT NULL),
f0 AS (SELECT *, CASE WHEN idx < n - (4 - fold) * (n // 4) THEN 'train' ELSE 'test' END AS role
  FROM known, range(1, 4) AS r(fold) WHERE idx < n - (4 - fold) * (n // 4) + n // 4),
f1 AS (SELECT *, min(ts) FILTER (WHERE role = 'test') OVER (PARTITION BY station, fold) AS test_start FROM f0),
f AS (SELECT * FROM f1 WHERE role = 'test' OR ts + INTERVAL 72 HOUR < test_start),
s AS (SELECT station AS st, fold AS fo, {', '.join(
    f'coalesce(CASE WHEN var_pop({c}) > 0 THEN regr_slope(aqi_day1, {c}) END, 0) AS {c}_b, avg({c}) AS {c}_m'
    for c in _PRUNED)} FROM f WHERE role = 'train' GROUP BY 1, 2),
i AS (""" + " UNION ALL ".join(
    f"SELECT fold, '{c}' AS feature, avg(abs({c}_b * ({c} - {c}_m))) AS importance FROM f JOIN s ON st = station "
    f"AND fo = fold WHERE role = 'test' GROUP BY 1" for c in _PRUNED) + ")"


@query("prune_states", shown(
    f"{_FOLD_SQL} SELECT feature, avg(importance) AS mean_importance, max(importance) AS max_importance, "
    f"CASE WHEN avg(importance) >= {_LEAST} THEN 'active' WHEN max(importance) < {_LEAST} THEN 'prunable' "
    "ELSE 'weak' END AS state FROM i GROUP BY 1", "feature state", "mean_importance max_importance"))
def prune_states(spark, sf_dir):
    """Exact importances of one-feature linear models over three folds."""
    built = features.build(tables.observations(spark, sf_dir), {"aqi_day1": 24}).withColumn("flat", F.lit(3.0))
    known = built.where("aqi_day1 IS NOT NULL").select("station", "ts", *_PRUNED, "aqi_day1")
    rows = session.store(splits.folds(session.store(known, "known"), 3), "folds")
    params = explain.slopes(rows.where("role = 'train'"), _PRUNED, "aqi_day1", by=("station", "fold"))
    test = rows.where("role = 'test'").unpivot(["station", "ts", "fold"], _PRUNED, "feature", "x")
    effect = F.abs(F.col("coefficient") * (F.col("x") - F.col("mean")))
    importances = test.join(params, ["station", "fold", "feature"]).groupBy("fold", "feature").agg(
        F.avg(effect).alias("importance"))
    return explain.prune_states(importances, _LEAST)


# Partners from the first bound on; from the second on the reference lets one absorb the other's credit.
_CLOSE, _ALIKE = 0.5, 0.85
_PARTNERS_SQL = f"""{sql.OBS}, {MATRIX_SQL}, pairs AS (SELECT station, column_a AS feature, column_b AS partner, corr FROM matrix WHERE abs(corr) > {_CLOSE}
  UNION ALL SELECT station, column_b, column_a, corr FROM matrix WHERE abs(corr) > {_CLOSE})"""


@query("corr_partners", shown(
    f"WITH {_PARTNERS_SQL} SELECT *, abs(corr) > {_ALIKE} AS alike FROM pairs", "station feature partner alike", "corr"))
def corr_partners(spark, sf_dir):
    """Both directions of every correlated pair, and whether it is close enough for the reference's guard."""
    found = correlation.matrix(tables.observations(spark, sf_dir), MATRIX)
    return correlation.partners(found, threshold=_CLOSE).withColumn("alike", F.abs("corr") > _ALIKE)


@query("prune_decision", f"""WITH RECURSIVE {sql.OBS}, {MATRIX_SQL}, near AS (
  SELECT DISTINCT feature, partner FROM (SELECT column_a AS feature, column_b AS partner FROM matrix WHERE abs(corr) > {_CLOSE}
    UNION ALL SELECT column_b, column_a FROM matrix WHERE abs(corr) > {_CLOSE})),
listed AS (SELECT f.feature, row_number() OVER (ORDER BY f.feature) AS i, list(partner ORDER BY partner) FILTER (partner IS NOT NULL) AS others
  FROM (VALUES {', '.join(f"('{c}')" for c in MATRIX)}) AS f(feature) LEFT JOIN near ON near.feature = f.feature GROUP BY 1),
walk AS (
  SELECT 0::BIGINT AS i, []::VARCHAR[] AS gone, NULL::VARCHAR AS feature, NULL::VARCHAR AS kept_partners
  UNION ALL
  SELECT l.i, CASE WHEN others IS NULL OR len(list_filter(others, lambda x: NOT list_contains(gone, x))) > 0
      THEN list_append(gone, l.feature) ELSE gone END, l.feature,
    coalesce(array_to_string(list_filter(others, lambda x: NOT list_contains(gone, x)), ', '), '')
  FROM walk JOIN listed AS l ON l.i = walk.i + 1)
SELECT feature, list_contains(gone, feature) AS dropped, kept_partners FROM walk WHERE i > 0""")
def prune_decision(spark, sf_dir):
    """If every measured column were prunable: which go, and which correlated partners stay for them."""
    found = correlation.matrix(tables.observations(spark, sf_dir), MATRIX)
    partners = correlation.partners(found, threshold=_CLOSE).select("feature", "partner").distinct()
    candidates = spark.createDataFrame([(c,) for c in MATRIX], "feature string")
    return explain.prune(candidates, partners)


def _sql_corr(x, y):
    both = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    spread = f"(stddev_pop({x}) {both} * stddev_pop({y}) {both})"
    return f"CASE WHEN {spread} > 0 THEN covar_pop({x}, {y}) / {spread} END"


_RULES_SQL = {
    "wind disperses": ("wind_speed_10m", "r < 0"), "rain washes out": ("flat", "r < 0.1"),
    "lag carries on": ("us_aqi_lag_1h", "r > 0.2")}


def _attribution_sql(c):
    known = "FILTER (WHERE aqi_day1 IS NOT NULL)"
    return (f"CASE WHEN var_pop({c}) {known} OVER w > 0 THEN regr_slope(aqi_day1, {c}) {known} OVER w ELSE 0 END "
            f"* ({c} - avg({c}) {known} OVER w)")


@query("domain_rules", shown(
    f"WITH {sql.FEATURES}, g AS (SELECT *, 0.0::DOUBLE AS flat, {sql.lead('us_aqi', 24, 'aqi_day1')} FROM features), e AS (SELECT *, "
    + ", ".join(f"{_attribution_sql(c)} AS {c}__effect" for c, _ in _RULES_SQL.values())
    + " FROM g WINDOW w AS (PARTITION BY station)), u AS ("
    + " UNION ALL ".join(
        f"SELECT station, '{rule}' AS rule, '{c}' AS feature, corr, CASE WHEN r IS NULL THEN 'NOT_EVALUABLE' "
        f"WHEN {good} THEN 'PASS' ELSE 'WARN' END AS status FROM (SELECT station, {_sql_corr(c, f'{c}__effect')} AS corr, "
        f"{_sql_corr(c, f'{c}__effect')} AS r FROM e GROUP BY station) AS x"
        for rule, (c, good) in _RULES_SQL.items()) + ") SELECT * FROM u", "station rule feature status", "corr"))
def domain_rules(spark, sf_dir):
    """Each rule's feature against its attribution: the share of a one-feature linear model of the next day's index."""
    columns = [c for c, _ in _RULES_SQL.values()]
    built = features.add(tables.observations(spark, sf_dir), [lag("us_aqi", 1)], {"aqi_day1": 24}).withColumn("flat", F.lit(0.0))
    rows = session.store(built.select("station", "ts", *columns, "aqi_day1"), "ruled")
    effects = explain.linear_shapley(rows.drop("aqi_day1"), explain.slopes(rows, columns, "aqi_day1")).groupBy("station", "ts").agg(*[
        F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"{c}__effect") for c in columns])
    return explain.domain_rules(rows.join(effects, ["station", "ts"]), {rule: (c, f"{c}__effect") for rule, (c, _) in _RULES_SQL.items()})


@query("explain_report", digits=4)
def explain_report(spark, sf_dir):
    return explain.report(_explained(spark, sf_dir), FEATURE_COLUMNS, "aqi_day1", _NONLINEAR["kernel"], samples=_WALKS)
