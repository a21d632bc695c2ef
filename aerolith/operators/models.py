"""Forecast models as ML pipelines: scaling, estimator and persistence in one object.

The kernel regressor is random Fourier features with a weighted Huber fit, and
the boosted trees are Spark's own: other estimators than a support-vector
machine or an ordered booster, in the same roles.
"""

import math
import warnings
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F

from aerolith import session
from aerolith.operators import gram, metrics, scaling, splits
from aerolith.operators.features import HORIZONS, missing_count
from aerolith.operators.series import KEY, TS

FLOOR = 30.0
RIDGE = {"elasticNetParam": 0.0, "regParam": 1e-2, "standardization": False}


class ScaledVector(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Columns to one vector, scaled with stored parameters; a missing value counts as the training median."""

    centre = Param(Params._dummy(), "centre", "value subtracted per column", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "divisor per column", TypeConverters.toListFloat)
    fill = Param(Params._dummy(), "fill", "value of a missing input per column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, centre=None, scale=None, fill=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        parts = zip(self.getInputCols(), self.getOrDefault(self.centre), self.getOrDefault(self.scale),
                    self.getOrDefault(self.fill))
        values = [(F.coalesce(F.col(c).cast("double"), F.lit(f)) - F.lit(m)) / F.lit(s) for c, m, s, f in parts]
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.array(*values)))


class Scaler(Estimator, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``ScaledVector`` on training rows: 'standard', 'robust' or 'none'.

    Three numbers per column reach the driver, as with any fitted stage. The value that stands
    for a missing input is the column's median, within a thousandth of the ranks.
    """

    kind = Param(Params._dummy(), "kind", "standard, robust or none", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, kind="standard"):
        super().__init__()
        self._setDefault(kind="standard")
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        columns, kind = self.getInputCols(), self.getOrDefault(self.kind)
        medians = dataset.select(*[F.col(c).cast("double").alias(c) for c in columns]).approxQuantile(columns, [0.5], 0.001)
        fill = [float(m[0]) if m else 0.0 for m in medians]
        if kind == "none":
            found = {}
        else:
            filled = dataset.select(*columns).na.fill(dict(zip(columns, fill)))
            found = {r.feature: (r.centre, r.scale) for r in scaling.fit(filled, columns, kind, []).collect()}
        pairs = [found.get(c, (0.0, 1.0)) for c in columns]
        return ScaledVector(inputCols=columns, outputCol=self.getOutputCol(),
                            centre=[p[0] for p in pairs], scale=[p[1] for p in pairs], fill=fill)


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of an RBF kernel (Rahimi and Recht, 2007).

    Frequencies follow from the seed, so every task draws the same map.
    """

    width = Param(Params._dummy(), "width", "number of inputs", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the map", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, width=None, size=256, seed=42):
        super().__init__()
        self._setDefault(size=256, seed=42)
        self._set(**self._input_kwargs)

    def frequencies(self):
        """Frequencies and phases of the map."""
        width, size, seed = (self.getOrDefault(p) for p in (self.width, self.size, self.seed))
        draw = np.random.default_rng(seed)
        # gamma = 1 / width on scaled inputs
        return draw.normal(0.0, math.sqrt(2.0 / width), (width, size)), draw.uniform(0.0, 2.0 * math.pi, size)

    def _transform(self, dataset):
        frequencies, phases = self.frequencies()
        size = len(phases)

        @F.pandas_udf("array<double>")
        def to_fourier(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(math.sqrt(2.0 / size) * np.cos(np.vstack(x.to_numpy()) @ frequencies + phases)))

        mapped = to_fourier(vector_to_array(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped))


class Config(NamedTuple):
    """One horizon's model: estimator, scaler and sample weight."""

    model: str
    scaler: str = "standard"
    weight: str | None = None
    options: dict = {}


# Estimator role, scaler and weighting of each horizon; the booster's size.
DEFAULT = {
    "aqi_day1": Config("kernel", "standard", "weight_recency"),
    "aqi_day2": Config("kernel", "robust", "weight_event"),
    "aqi_day3": Config("boosted", "none", None, {"maxIter": 500, "stepSize": 0.03, "maxDepth": 6, "seed": 42}),
}


def pipeline(columns, label, config):
    """An unfitted pipeline from raw feature columns to ``prediction``."""
    scale = Scaler(inputCols=list(columns), outputCol="_scaled", kind=config.scaler)
    common = {"labelCol": label, "predictionCol": "prediction", **({"weightCol": config.weight} if config.weight else {})}
    options = dict(config.options)
    if config.model == "kernel":
        size = options.pop("size", 256)
        fourier = FourierFeatures(inputCol="_scaled", outputCol="_fourier", width=len(columns), size=size)
        linear = LinearRegression(featuresCol="_fourier", **common, **{
            "loss": "huber", "regParam": 1e-3, "standardization": False, "maxIter": 100, **options})
        return Pipeline(stages=[scale, fourier, linear])
    estimators = {
        "ridge": (LinearRegression, RIDGE),
        "forest": (RandomForestRegressor, {"numTrees": 100, "seed": 42}),
        "boosted": (GBTRegressor, {"stepSize": 0.03, "maxDepth": 6, "maxIter": 500, "seed": 42,
                                   "checkpointInterval": 10}),
    }
    kind, defaults = estimators[config.model]
    return Pipeline(stages=[scale, kind(featuresCol="_scaled", **common, **{**defaults, **options})])


def fit(df, columns, label, config):
    """Train on rows whose label is known."""
    session.shared_dir(df.sparkSession)
    return pipeline(columns, label, config).fit(df.where(F.col(label).isNotNull()))


def predict(model, df, name="pred"):
    """Append predictions and drop the pipeline's helper columns."""
    scored = model.transform(df).withColumnRenamed("prediction", name)
    return scored.select(*df.columns, name)


def score(df, model, columns, max_missing=0, floor=FLOOR, name="prediction"):
    """Null-aware scoring: the raw prediction, the published one (floored, one
    decimal), the number of missing inputs and a status. A row with more than
    ``max_missing`` missing inputs gets no prediction."""
    raw = predict(model, df.withColumn("n_missing", missing_count(columns)), "_raw")
    usable = F.col("n_missing") <= max_missing
    return raw.withColumns({
        f"raw_{name}": F.when(usable, F.col("_raw")),
        name: F.when(usable, F.bround(F.greatest(F.col("_raw"), F.lit(floor)), 1)),
        "status": F.when(usable, "scored").otherwise("missing inputs"),
    }).drop("_raw")


def save(model, path):
    model.write().overwrite().save(path)


def load(path):
    return PipelineModel.load(path)


def with_weights(df):
    """Both sample weights, fitted on training rows."""
    return splits.event_weight(splits.recency_weight(df), splits.smog())


def train_all(df, columns, configs=None, horizons=None, path=None):
    """Fit one pipeline per horizon on the training part of a split table.

    Returns the fitted pipelines and one table of errors per horizon, part and
    model, persistence included. Selection reads the validation part; the test
    part is only reported.
    """
    configs, horizons = configs or DEFAULT, horizons or list(HORIZONS)
    train = with_weights(df.where("split = 'train'"))
    fitted, tables = {}, []
    for horizon in horizons:
        config = configs[horizon]
        fitted[horizon] = fit(train, columns, horizon, config)
        if path:
            save(fitted[horizon], f"{path}/{horizon}")
        held = predict(fitted[horizon], df.where("split IN ('validation', 'test')"))
        rows = F.array(
            F.struct(F.lit(config.model).alias("model"), F.col("pred").alias("p")),
            F.struct(F.lit("persistence").alias("model"), F.col("us_aqi").alias("p")))
        tables.append(held.select("split", F.lit(horizon).alias("horizon"), F.col(horizon).alias("truth"), F.inline(rows)))
    long = tables[0]
    for table in tables[1:]:
        long = long.unionByName(table)
    return fitted, metrics.regression(long, "truth", "p", ["horizon", "split", "model"])


def importances(model, columns, limit=6, least=1.0):
    """Largest gain importances of a tree pipeline in percent, at most ``limit``
    and only above ``least``; ``method`` says what they are."""
    from aerolith.functions.columns import title_name
    from pyspark.sql import SparkSession

    gains = model.stages[-1].featureImportances.toArray()
    rows = [(c, float(g) * 100.0) for c, g in zip(columns, gains)]
    table = SparkSession.getActiveSession().createDataFrame(rows, "feature string, gain double")
    top = table.where(F.col("gain") > least).orderBy(F.desc("gain"), "feature").limit(limit)
    return top.select("feature", title_name(F.col("feature")).alias("name"),
                      F.bround("gain", 1).alias("impact"), F.lit("tree gain").alias("method"))


def _penalty(config):
    if config.model != "ridge" or config.weight or set(config.options) - {"regParam"}:
        raise ValueError("an unweighted ridge is solved from sums of products; other models are fitted")
    return config.options.get("regParam", RIDGE["regParam"])


def feature_search(df, base, candidates, label, config=None, least=0.005):
    """Try candidate features one after another on the validation part.

    A candidate stays when the validation RMSE falls and its mean absolute
    attribution reaches ``least``. Every trial is returned. One pass over the training and validation rows
    gives the sums of products of all columns; every ridge trial is solved from them, whatever the number of candidates.
    Without a training or a validation row (the embargo can take a short validation part whole) errors and attributions
    are unknown: every candidate is listed with nulls and none stays.
    """
    config = config or Config("ridge")
    if config.scaler not in ("standard", "none"):
        raise ValueError("a search scales by deviation or not at all")
    reg, columns = _penalty(config), list(base) + list(candidates)
    rows = df.where("split IN ('train', 'validation')")
    train = rows.where("split = 'train'")
    medians = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).approxQuantile(columns, [0.5], 0.001)
    fill = {c: m[0] for c, m in zip(columns, medians) if m}
    sums = gram.gram(rows, columns, label, "split", fill)
    fit_on, held = sums.of("train"), sums.of("validation")
    schema = "feature string, rmse_before double, rmse double, delta double, attribution double, accepted boolean"
    empty = [name for name, matrix in (("training", fit_on), ("validation", held)) if not matrix[0, 0]]
    if empty:
        warnings.warn(f"no {' and no '.join(empty)} row is known and clear of the embargo: no candidate can be judged")
        return list(base), df.sparkSession.createDataFrame([(c, None, None, None, None, False) for c in candidates], schema)
    centre = gram.moments(fit_on)[1] + sums.shift
    distance = rows.where((F.col("split") == "validation") & F.col(label).isNotNull()).agg(*[
        F.avg(F.abs(F.coalesce(F.col(c).cast("double"), F.lit(float(fill.get(c, m)))) - F.lit(float(m)))).alias(c)
        for c, m in zip(columns, centre)]).first()
    scale = np.ones(len(columns)) if config.scaler == "none" else None

    def trial(chosen):
        slopes, intercept = gram.ridge(fit_on, chosen, reg, scale)
        return slopes, gram.rmse(held, chosen, slopes, intercept)

    kept, trials = list(range(len(base))), []
    best = trial(kept)[1]
    for number in range(len(base), len(columns)):
        slopes, error = trial(kept + [number])
        attribution = float(abs(slopes[-1]) * distance[number])
        accepted = bool(error < best and attribution >= least)
        trials.append((columns[number], best, error, error - best, attribution, accepted))
        if accepted:
            kept, best = kept + [number], error
    return [columns[i] for i in kept], df.sparkSession.createDataFrame(trials, schema)


def ridge_folds(df, columns, label, config, n_splits=5):
    """RMSE of a ridge per fold, without refitting: sums of products of the stretches between fold edges, added up.

    Rows that play the same parts in all folds form a stretch. Only the robust scaler, whose
    quartiles do not add up, reads the training rows of the folds once more.
    """
    reg = _penalty(config)
    parts = session.store(splits.fold_parts(df, n_splits), "parts")
    sums = gram.gram(parts, columns, label, "parts")
    scales = {}
    if config.scaler == "robust":
        each = parts.where(F.col(label).isNotNull()).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits)))).where(
            F.substring("parts", F.col("fold"), F.lit(1)) == "T")
        found = {(r.fold, r.feature): r.scale for r in scaling.fit(each, columns, "robust", ["fold"]).collect()}
        scales = {f: np.array([found.get((f, c), 1.0) for c in columns]) for f in range(1, n_splits + 1)}
    out, chosen = [], np.arange(len(columns))
    for fold in range(1, n_splits + 1):
        train, test = (sums.of(*[g for g in sums.matrices if g[fold - 1] == role]) for role in "Tt")
        if not train[0, 0] or not test[0, 0]:
            continue
        scale = np.ones(len(columns)) if config.scaler == "none" else scales.get(fold)
        out.append((fold, gram.rmse(test, chosen, *gram.ridge(train, chosen, reg, scale))))
    return df.sparkSession.createDataFrame(out, "fold int, rmse double")


def compare_by_fold(df, columns, label, configs, n_splits=5):
    """RMSE of each model on the same folds and the paired difference to the first. A ridge is solved from sums of products, others are refitted."""
    rows = session.store(splits.indexed(df), "numbered")
    names, solved, tables = list(configs), [], []
    for name in names:
        if configs[name].model == "ridge" and not configs[name].weight:
            solved.append(ridge_folds(rows, columns, label, configs[name], n_splits).select(
                "fold", F.lit(name).alias("model"), "rmse"))
    fitted = [n for n in names if configs[n].model != "ridge" or configs[n].weight]
    for fold in range(1, n_splits + 1) if fitted else ():
        train, test = splits.one_fold(rows, fold, n_splits)
        if any(configs[n].weight for n in fitted):
            train = with_weights(train)
        for name in fitted:
            held = predict(fit(train, columns, label, configs[name]), test)
            tables.append(held.select(F.lit(fold).alias("fold"), F.lit(name).alias("model"), F.col(label).alias("truth"), "pred"))
    if tables:
        long = reduce(lambda a, b: a.unionByName(b), tables)
        solved.append(metrics.regression(long, "truth", "pred", ["fold", "model"]).select("fold", "model", "rmse"))
    scores = reduce(lambda a, b: a.unionByName(b), solved)
    wide = scores.groupBy("fold").agg(*[
        F.max(F.when(F.col("model") == n, F.col("rmse"))).alias(f"rmse_{n}") for n in names])
    return wide.withColumns({f"diff_{n}": F.col(f"rmse_{n}") - F.col(f"rmse_{names[0]}") for n in names[1:]})
