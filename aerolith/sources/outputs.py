"""What the engine publishes: forecasts, pollutant state, the metrics log."""

from functools import reduce

from pyspark.sql import functions as F

from aerolith.functions.columns import (
    POLLUTANT_LIMITS, aqi_advice, aqi_band, improvement_pct, limit_percent, limit_status,
)
from aerolith.operators.series import KEY, TS

HORIZON_DAYS = {"today": 0, "day1": 1, "day2": 2, "day3": 3}


def latest_rows(df, key=KEY, ts=TS):
    """The newest row of each station, without sorting any station."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.col(ts)).alias("_row")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def latest_pollutants(df, key=KEY, ts=TS, digits=1):
    """Newest known value of each pollutant, rounded half-even; a null in the
    newest row falls back to the row before it, never to a made-up number."""
    return df.groupBy(key).agg(*[
        F.bround(F.max_by(F.col(source), F.when(F.col(source).isNotNull(), F.col(ts))), digits).alias(source)
        for source, *_ in POLLUTANT_LIMITS
    ])


def against_limits(latest, key=KEY):
    """One row per station and pollutant: value, limit, percent of limit, status."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("pollutant"), F.col(source).alias("value"), F.lit(unit).alias("unit"),
                 F.lit(limit).alias("limit_value"), limit_percent(F.col(source), F.lit(limit)).alias("percent_of_limit"),
                 limit_status(F.col(source), F.lit(limit)).alias("status"))
        for source, name, limit, unit in POLLUTANT_LIMITS
    ])
    return latest.select(key, F.inline(rows))


def forecast_long(wide, key=KEY, ts=TS):
    """today, day1, day2, day3 side by side -> one row per day, with date and band."""
    long = wide.select(key, ts, *HORIZON_DAYS).unpivot([key, ts], list(HORIZON_DAYS), "horizon", "aqi")
    days = F.create_map(*[F.lit(x) for pair in HORIZON_DAYS.items() for x in pair])
    date = F.date_add(F.to_date(ts), F.try_element_at(days, F.col("horizon")))
    return long.select(
        key, "horizon",
        F.when(F.col("horizon") == "today", "Today").otherwise(F.date_format(date, "EEE")).alias("day_name"),
        F.date_format(date, "MMM d").alias("date_label"),
        F.bround("aqi", 0).cast("int").alias("aqi"),
        aqi_band(F.bround("aqi", 0)).alias("band"), aqi_advice(F.bround("aqi", 0)).alias("advice"),
    )


def write_csv(df, path):
    df.write.option("header", True).csv(path)


def _sorted_list(order, *columns):
    """A short list per station in a fixed order."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("_o"), F.struct(*columns).alias("_v"))))
    return F.transform(pairs, lambda pair: pair["_v"])


def payload(wide, pollutants, analogues, importances=None, models=None, key=KEY, ts=TS):
    """One nested row per station. Every list has a fixed small length.

    ``models`` maps a day to the name of the model that gave it. ``status`` says whether every day has a value; a missing
    one stays missing.
    """
    names = [name for _, name, *_ in POLLUTANT_LIMITS]
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("pollutant"))
    state = pollutants.groupBy(key).agg(
        _sorted_list(place, "pollutant", "value", "unit", "limit_value", "percent_of_limit", "status").alias("pollutants"))
    days = analogues.groupBy(key).agg(
        _sorted_list(F.col("place"), "date", "historical_aqi", "similarity", "humidity_high").alias("similar_days"))
    result = (
        wide.select(key, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("last_updated"),
                    F.struct(*HORIZON_DAYS).alias("predictions"),
                    F.struct(*[F.lit(name).alias(day) for day, name in (models or {}).items()] or [F.lit(None).alias("day1")]).alias("models"),
                    F.struct(F.when(reduce(lambda a, b: a & b, [F.col(d).isNotNull() for d in HORIZON_DAYS]), "ok").otherwise(
                        "incomplete").alias("forecast")).alias("status"))
        .join(state, key, "left").join(days, key, "left")
    )
    if importances is not None:
        top = importances.groupBy(key).agg(
            _sorted_list(F.col("place"), "feature", "name", "impact", "method").alias("importances"))
        result = result.join(top, key, "left")
    return result


def payload_json(nested, key=KEY):
    """The nested parts as JSON text, nulls kept."""
    keep = {"ignoreNullFields": "false"}
    return nested.select(
        key, "last_updated",
        *[F.to_json(c, keep).alias(c) for c in nested.columns if c not in (key, "last_updated")])


def log_entries(scores, baseline, configs, run_at, folder=None):
    """A run's log: per horizon the model, its scaler, weighting and place, its errors, and its edge over the baseline in percent.

    ``configs`` maps a horizon to (model, scaler, weight); ``scores`` and ``baseline`` have one row per horizon.
    """
    fields = ("model", "scaler", "weighting")
    rows = [F.struct(F.lit(h).alias("horizon"), *[F.lit(v).cast("string").alias(f) for f, v in zip(fields, c)]) for h, c in configs.items()]
    named = scores.drop("model").withColumn("_c", F.filter(F.array(*rows), lambda c: c["horizon"] == F.col("horizon"))[0])
    base = baseline.select("horizon", F.col("rmse").alias("persistence_rmse"))
    place = F.concat_ws("/", F.lit(folder), "horizon") if folder else F.lit(None).cast("string")
    return named.join(base, "horizon").select(
        F.lit(run_at).cast("timestamp").alias("run_at"), "horizon", *[F.col(f"_c.{f}").alias(f) for f in fields], place.alias("artifact"),
        "n", "rmse", "mae", "r2", "persistence_rmse", improvement_pct(F.col("persistence_rmse"), F.col("rmse")).alias("edge_pct"))


def log_metrics(df, path):
    """Append a run's metrics to the log."""
    df.write.mode("append").parquet(path)
