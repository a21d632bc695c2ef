"""Shapley values, importances over folds, pruning and domain rules."""

import pandas as pd
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from aerolith import session
from aerolith.functions.columns import safe_corr
from aerolith.operators import correlation, models, splits, walks
from aerolith.operators.series import KEY, TS


def is_linear(model):
    """A scaler and a linear regression, with nothing between."""
    return len(model.stages) == 2 and isinstance(model.stages[-1], LinearRegressionModel)


def exact_shapley(model, df, columns, key=KEY, ts=TS):
    """Shapley values of a linear pipeline: each feature's share is its coefficient times its
    distance from the scaler's centre. Long result as of ``shapley``; the base is the
    prediction at the centre."""
    shares = linear_contributions(model, df, columns)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), share.alias("value")) for c, share in shares.items()])
    return df.select(key, ts, F.inline(rows)).withColumn("base", F.lit(float(model.stages[-1].intercept)))


def shapley(model, df, columns, train=None, samples=100, key=KEY, ts=TS):
    """Shapley values of a pipeline: exact ones if it is linear, else sampled ones against all rows of `train`."""
    if is_linear(model):
        return exact_shapley(model, df, columns, key, ts)
    return walks.sampled(model, df, columns, walks.Reference(train, columns), samples, key, ts)


def linear_shapley(df, params, key=KEY, ts=TS):
    """Exact values for a linear model: coefficient times distance from the mean.

    ``params`` is a table: key, feature, coefficient, mean.
    """
    features = [c for c in df.columns if c not in (key, ts)]
    long = df.unpivot([key, ts], features, "feature", "x")
    return long.join(params, [key, "feature"]).select(
        key, ts, "feature", (F.col("coefficient") * (F.col("x") - F.col("mean"))).alias("value"))


def slopes(df, features, target, by=(KEY,)):
    """One-feature least-squares slopes with the feature's mean, in long form; a
    feature that does not vary explains nothing."""
    wide = df.where(F.col(target).isNotNull()).groupBy(*by).agg(
        *[F.regr_slope(F.col(target), F.col(f)).alias(f"{f}__slope") for f in features],
        *[F.avg(f).alias(f"{f}__mean") for f in features])
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f"{f}__slope"), F.lit(0.0)).alias("coefficient"),
                 F.col(f"{f}__mean").alias("mean")) for f in features])
    return wide.select(*by, F.inline(rows))


def linear_contributions(model, df, columns):
    """Contribution columns of a fitted linear pipeline, against the scaler's centre."""
    scaler, linear = model.stages[0], model.stages[-1]
    parts = zip(columns, linear.coefficients.toArray(), scaler.getOrDefault(scaler.centre),
                scaler.getOrDefault(scaler.scale), scaler.getOrDefault(scaler.fill))
    return {c: (F.coalesce(F.col(c), F.lit(f)) - F.lit(m)) / F.lit(s) * F.lit(float(b)) for c, b, m, s, f in parts}


def fold_importance(df, columns, label, config, n_splits=3, samples=100):
    """Mean absolute Shapley value per fold and feature, on each fold's test part."""
    rows = session.store(splits.indexed(df), "numbered")
    tables = []
    for fold in range(1, n_splits + 1):
        train, test = splits.one_fold(rows, fold, n_splits)
        model = models.fit(train, columns, label, config)
        values = shapley(model, test, columns, train, samples)
        tables.append(values.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance")).withColumn(
            "fold", F.lit(fold)))
    long = tables[0]
    for table in tables[1:]:
        long = long.unionByName(table)
    return long


def prune_states(importances, least=0.01, by=("feature",)):
    """active, weak or prunable, from the mean and the largest fold importance."""
    found = importances.groupBy(*by).agg(
        F.avg("importance").alias("mean_importance"), F.max("importance").alias("max_importance"))
    state = (F.when(F.col("mean_importance") >= least, "active")
             .when(F.col("max_importance") < least, "prunable").otherwise("weak"))
    return found.withColumn("state", state)


def prune(candidates, partners):
    """Which prunable features may go: one whose correlated partner stays, or one
    without partners, in name order, so that the last of correlated features stays.
    The one group holds feature names, at most the square of the number of columns,
    and never data rows."""
    def keep_one(rows):
        edges, dropped, out = rows.groupby("feature")["partner"].apply(set), set(), []
        for feature, near in edges.sort_index().items():
            near = {p for p in near if p is not None}
            kept = sorted(near - dropped)
            if kept or not near:
                dropped.add(feature)
            out.append((feature, feature in dropped, ", ".join(kept)))
        return pd.DataFrame(out, columns=["feature", "dropped", "kept_partners"])

    pairs = candidates.join(partners.select("feature", "partner"), "feature", "left")
    return pairs.groupBy().applyInPandas(keep_one, "feature string, dropped boolean, kept_partners string")


# Rule, words found in the feature name, comparison, limit.
RULES = [
    ("wind disperses", ("wind_speed",), "below", 0.0),
    ("rain washes out", ("rain", "precipitation"), "below", 0.1),
    ("lag carries on", ("aqi_lag", "pm2_5_lag"), "above", 0.2),
]


def first_match(columns, words):
    return next((c for c in columns if any(w in c for w in words)), None)


def domain_rules(df, pairs, by=(KEY,)):
    """Direction of each rule's feature against its effect.

    ``pairs`` maps a rule to (feature column, effect column). A side without
    variation leaves the rule open instead of passing it.
    """
    limits = {name: (side, limit) for name, _, side, limit in RULES}
    wide = df.groupBy(*by).agg(*[
        safe_corr(F.col(x), F.col(y)).alias(f"_{i}") for i, (x, y) in enumerate(pairs.values())])
    rows = []
    for i, (name, (x, _)) in enumerate(pairs.items()):
        side, limit = limits[name]
        r = F.col(f"_{i}")
        good = r < limit if side == "below" else r > limit
        status = F.when(r.isNull(), "NOT_EVALUABLE").when(good, "PASS").otherwise("WARN")
        rows.append(F.struct(F.lit(name).alias("rule"), F.lit(x).alias("feature"), r.alias("corr"),
                             status.alias("status")))
    return wide.select(*by, F.inline(F.array(*rows)))


def report(df, columns, label, config, n_splits=3, samples=100, least=0.01, corr_threshold=0.85):
    """Rules, fold stability and pruning of one model as a single long table."""
    rows = session.store(splits.embargoed(df), "explained")
    train, test = rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")
    model = models.fit(train, columns, label, config)
    values = session.store(shapley(model, test, columns, train, samples), "shapley")
    named = {name: first_match(columns, words) for name, words, _, _ in RULES}
    effects = values.groupBy(KEY, TS).agg(*[
        F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"{c}__effect")
        for c in sorted({c for c in named.values() if c})])
    rules = domain_rules(test.join(effects, [KEY, TS]), {n: (c, f"{c}__effect") for n, c in named.items() if c})
    states = prune_states(fold_importance(train, columns, label, config, n_splits, samples), least)
    partners = correlation.partners(correlation.matrix(train, columns, ()), corr_threshold, ())
    pruned = prune(states.where("state = 'prunable'").select("feature"), partners)
    no_station = F.lit(None).cast("string").alias(KEY)
    return (
        rules.select(F.lit("rule").alias("section"), KEY, F.col("rule").alias("item"), F.col("corr").alias("value"),
                     "status")
        .unionByName(states.select(F.lit("stability").alias("section"), no_station,
                                   F.col("feature").alias("item"), F.col("mean_importance").alias("value"),
                                   F.col("state").alias("status")))
        .unionByName(pruned.select(F.lit("pruning").alias("section"), no_station, F.col("feature").alias("item"),
                                   F.lit(None).cast("double").alias("value"),
                                   F.when(F.col("dropped"), "drop").otherwise("keep").alias("status"))))
