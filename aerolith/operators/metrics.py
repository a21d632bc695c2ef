"""Forecast errors, comparison with a baseline, targets, winners."""

from pyspark.sql import functions as F

from aerolith.functions.columns import improvement_pct

# Horizon, title, largest MAE, largest RMSE, smallest R2, wanted R2 range.
TARGETS = [
    ("aqi_day1", "Day 1 (24h Ahead)", 15.0, 23.0, 0.75, "0.75 - 0.85"),
    ("aqi_day2", "Day 2 (48h Ahead)", 22.0, 30.0, 0.65, "0.65 - 0.75"),
    ("aqi_day3", "Day 3 (72h Ahead)", 28.0, 38.0, 0.50, "0.50 - 0.65"),
]


def _errors(truth, pred):
    """RMSE, MAE and R2 as aggregates; R2 is null where the truth does not vary."""
    error = F.col(truth) - F.col(pred)
    spread = F.var_pop(F.col(truth))
    return [
        F.count("*").alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(F.avg(error * error), F.when(spread > 0, spread))).alias("r2"),
    ]


def _pairs(df, truth, pred):
    return df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())


def regression(df, truth, pred, by):
    """Forecast errors per group over the rows with both a truth and a prediction."""
    return _pairs(df, truth, pred).groupBy(*by).agg(*_errors(truth, pred))


def by_horizon(df, prediction, horizons, keep=()):
    """Long form of wide targets: one row per source row and horizon, with truth
    and prediction. ``prediction`` maps a horizon to its prediction column."""
    rows = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(h).alias("truth"), F.col(prediction[h]).alias("pred"))
        for h in horizons])
    return df.select(*keep, F.inline(rows))


def persistence(df, horizons, now="us_aqi", by=("horizon",), keep=()):
    """Errors of the forecast that says tomorrow is like today."""
    long = by_horizon(df, {h: now for h in horizons}, horizons, keep)
    return regression(long, "truth", "pred", by)


def against(model, baseline, on):
    """Model metrics beside baseline metrics with improvement in percent."""
    base = baseline.select(*on, *[F.col(m).alias(f"base_{m}") for m in ("rmse", "mae", "r2")])
    joined = model.join(base, list(on))
    return joined.withColumns({
        "rmse_improvement_pct": improvement_pct(F.col("base_rmse"), F.col("rmse")),
        "mae_improvement_pct": improvement_pct(F.col("base_mae"), F.col("mae")),
    })


def gate(compared):
    """Beats the baseline only when both RMSE and MAE are lower."""
    rmse, mae = F.col("rmse") < F.col("base_rmse"), F.col("mae") < F.col("base_mae")
    return compared.withColumns({"beats_rmse": rmse, "beats_mae": mae, "beats_baseline": rmse & mae})


def _target(position):
    chain = F.when(F.col("horizon") == TARGETS[0][0], TARGETS[0][position])
    for row in TARGETS[1:]:
        chain = chain.when(F.col("horizon") == row[0], row[position])
    return chain


def compliance(gated):
    """Declared targets per horizon and the resulting status; a horizon without
    declared targets has none to miss."""
    meets = {
        "meets_mae": F.coalesce(F.col("mae") <= _target(2), F.lit(True)),
        "meets_rmse": F.coalesce(F.col("rmse") <= _target(3), F.lit(True)),
        "meets_r2": F.when(_target(4).isNull(), True).otherwise(F.coalesce(F.col("r2") >= _target(4), F.lit(False))),
    }
    full = gated.withColumns({"title": _target(1), **meets})
    all_met = F.col("beats_baseline") & F.col("meets_mae") & F.col("meets_rmse") & F.col("meets_r2")
    return full.withColumn("meets_all", all_met).withColumn(
        "status", F.when(F.col("meets_all"), "MET").when(F.col("beats_baseline"), "BEATS BASELINE")
        .otherwise("REJECTED"))


def regimes(df, regime, truth="truth", pred="pred", by=("horizon",), limit=150):
    """Errors apart for calm and heavy hours; ``regime`` names the deciding column."""
    heavy = F.when(F.col(regime) > limit, "heavy").when(F.col(regime).isNotNull(), "calm")
    return regression(df.withColumn("regime", heavy).where(F.col("regime").isNotNull()),
                      truth, pred, [*by, "regime"])


def select_winner(scores, on=("horizon",), override=None):
    """Lowest validation RMSE per horizon, name on ties; an override is recorded
    beside the winner, it does not replace the record of it."""
    best = scores.groupBy(*on).agg(
        F.min_by("model", F.struct("rmse", "model")).alias("winner"), F.min("rmse").alias("winner_rmse"))
    chosen = F.col("winner")
    for horizon, model in (override or {}).items():
        chosen = F.when(F.col("horizon") == horizon, model).otherwise(chosen)
    return best.withColumn("chosen", chosen).withColumn("overridden", F.col("chosen") != F.col("winner"))


def variance_identity(df, truth, pred, by):
    """R2 computed from means beside 1 - SSE / (variance * n); they must agree."""
    error = F.col(truth) - F.col(pred)
    found = _pairs(df, truth, pred).groupBy(*by).agg(
        *_errors(truth, pred), F.min(truth).alias("min_truth"), F.max(truth).alias("max_truth"),
        F.avg(truth).alias("mean_truth"), F.var_pop(truth).alias("var_truth"), F.sum(error * error).alias("_sse"))
    theory = 1 - F.try_divide(F.col("_sse"), F.col("var_truth") * F.col("n"))
    return found.withColumn("r2_from_variance", theory).withColumn(
        "agrees", F.abs(F.col("r2") - theory) < 1e-9).drop("_sse")
