"""Issued forecasts and what came true: a stored table with two clocks, matched as observations mature.

A forecast has the hour it was issued and the hour it is valid for. It is stored once by its key,
below the day it is valid for. Observations arrive in deliveries; a delivery is joined with the
forecasts of its own days only, and the matched rows are stored below the same days. A delivery
that is repeated, or that comes before older ones, gives the same table.
"""

from pyspark.sql import functions as F

from aerolith.operators import metrics
from aerolith.operators.series import KEY, TS
from aerolith.sources import store

ISSUED, VALID = "issued", "valid"
ON = (KEY, "model", "horizon", ISSUED, VALID)


def lead_forecasts(df, horizons, predictions, key=KEY, ts=TS):
    """Long forecasts of wide rows: one per row, horizon and model. ``predictions`` maps a model to its column;
    rows without a prediction give none."""
    rows = F.array(*[
        F.struct(F.lit(model).alias("model"), F.lit(horizon).alias("horizon"),
                 (F.col(ts) + F.expr(f"INTERVAL {int(hours)} HOURS")).alias(VALID), F.col(column).cast("double").alias("prediction"))
        for model, column in predictions.items() for horizon, hours in horizons.items()])
    return df.select(F.col(key).alias(KEY), F.col(ts).alias(ISSUED), F.inline(rows)).where("prediction IS NOT NULL").select(
        *ON, "prediction")


def publish(spark, forecasts, path):
    """Store issued forecasts; one that is published again, even with another value, stays as it was issued."""
    store.append(spark, forecasts, path, "ignore", ts=VALID, on=ON)


def mature(spark, observations, path, truth_path, value="us_aqi", revise=False, key=KEY, ts=TS):
    """Match a delivery of observations with the forecasts valid at its hours.

    Only the days of the delivery are read, of forecasts and of matches. ``revise`` lets a
    corrected observation replace the truth of matches already stored. A missing value is no truth.
    """
    known = store.by_day(observations.where(F.col(value).isNotNull()).select(
        F.col(key).alias(KEY), F.col(ts).alias(VALID), F.col(value).alias("truth")), VALID).dropDuplicates([KEY, VALID])
    days = [row.day for row in known.select("day").distinct().collect()]
    open_forecasts = store.read_days(spark, path, days)
    if open_forecasts is None:
        return
    matched = open_forecasts.join(known, [KEY, VALID, "day"]).select(*ON, "prediction", "truth")
    store.append(spark, matched, truth_path, "latest" if revise else "ignore", ts=VALID, on=ON)


def scores(spark, path, truth_path, by=(KEY, "model", "horizon")):
    """Errors of the matched forecasts and how many still wait for their hour."""
    issued = store.read(spark, path, ts=VALID).groupBy(*by).agg(F.count("*").alias("issued"))
    found = metrics.regression(store.read(spark, truth_path, ts=VALID), "truth", "prediction", list(by))
    return issued.join(found, list(by), "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn(
        "pending", F.col("issued") - F.col("n"))
