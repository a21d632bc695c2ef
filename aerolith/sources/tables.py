"""The given tables, seen as the station series the engine works on.

``events`` stand for readings: an event type is a station, the event value the
raw index, the number in ``props`` a second sensor. The air-quality network's
clock is half an hour ahead, so its hours are not the weather's hours. Unit factors
are prime-based: means of plain cents often end exactly between two rounded values,
where the order of a sum decides the last digit.
"""

from pyspark.sql import functions as F

from aerolith.session import prepare


def table(spark, sf_dir, name):
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark, sf_dir):
    """Raw readings with a UTC timestamp: station, ts, value, k, user_id, event_id."""
    return as_readings(table(spark, sf_dir, "events"))


def as_readings(events):
    return events.select(
        "event_id", F.col("event_type").alias("station"), F.col("ts").cast("timestamp").alias("ts"),
        F.nanvl("value", F.lit(None).cast("double")).alias("value"), "user_id",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def hourly(rows, ts="ts"):
    return F.date_trunc("hour", F.col(ts)).alias("ts")


def weather(spark, sf_dir):
    rows = readings(spark, sf_dir)
    floor_at = lambda edge: F.greatest(F.max("k") - edge, F.lit(0.0)) / 10
    return rows.groupBy("station", hourly(rows)).agg(
        F.avg("k").alias("temperature_2m"),
        F.max("k").alias("relative_humidity_2m"),
        F.min("k").alias("dew_point_2m"),
        F.avg(F.col("k") + F.col("value") / 991).alias("apparent_temperature"),
        floor_at(80).alias("precipitation"),
        floor_at(90).alias("rain"),
        (F.avg("user_id") / 991 + 1000).alias("surface_pressure"),
        F.count("*").cast("double").alias("cloud_cover"),
        F.stddev_samp("value").alias("wind_speed_10m"),
        F.max("user_id").cast("double").alias("wind_direction_10m"),
        ((F.max("value") - F.min("value")) / 0.997).alias("wind_gusts_10m"),
    )


def air_quality(spark, sf_dir):
    rows = readings(spark, sf_dir).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 MINUTES"))
    return rows.groupBy("station", hourly(rows)).agg(
        F.min("value").alias("pm2_5"),
        (F.avg("value") / 0.997).alias("pm10"),
        (F.avg(F.col("value") * F.col("value")) / 997).alias("ozone"),
        (F.avg(F.abs(F.col("value") - 50)) / 0.997).alias("nitrogen_dioxide"),
        (F.sum("value") / 10).alias("sulphur_dioxide"),
        F.sum("k").alias("carbon_monoxide"),
        F.min("user_id").cast("double").alias("dust"),
        ((F.max("k") - F.min("k")) / 100).alias("aerosol_optical_depth"),
        (F.max("value") / 0.997).alias("us_aqi"),
    )


def observations(spark, sf_dir):
    from aerolith.sources.landing import join_sources

    return join_sources(weather(spark, sf_dir), air_quality(spark, sf_dir))


def series(spark, sf_dir):
    """One hourly value per station: the smallest useful series."""
    rows = readings(spark, sf_dir)
    return rows.groupBy("station", hourly(rows)).agg(
        (F.max("value") / 0.997).alias("us_aqi"), F.sum("value").alias("rain"), F.count("*").alias("n"),
    )


def daily(spark, sf_dir):
    """Years of daily values, for the month, weekday and year audits."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("station"),
        F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("ts"),
    ).agg((F.avg("o_totalprice") / 2111).alias("us_aqi"))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
