"""Days of the past that resemble now."""

from functools import reduce
from operator import add

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolith.functions.columns import similarity_score
from aerolith.operators.features import complete
from aerolith.operators.series import KEY, TS


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda total, x: total + x)


def cosine(a, b):
    """Cosine of two array columns; a zero vector counts as length 1."""
    length = lambda v: F.when(dot(v, v) == 0, 1.0).otherwise(F.sqrt(dot(v, v)))
    return dot(a, b) / (length(a) * length(b))


def nearest(vectors, query, k, id_column="vec_id", vector="embedding"):
    """The k vectors most like one query row (a one-row DataFrame), ids break ties.

    The query enters as a scalar, so the scan is scored where it is read and only
    k rows per task leave it.
    """
    wanted = query.select(F.struct(F.col(id_column).alias("id"), F.col(vector).alias("v"))).scalar()
    others = vectors.withColumn("_q", wanted).where(F.col(id_column) != F.col("_q.id"))
    scored = others.withColumn("similarity", cosine(F.col(vector), F.col("_q.v"))).drop("_q")
    return scored.orderBy(F.desc("similarity"), id_column).limit(k)


def similarities(df, feature_cols, key=KEY, ts=TS):
    """Cosine between every row's scaled features and its station's newest row."""
    rows = complete(df, [*feature_cols, "us_aqi"])
    nonzero = lambda x: F.when(x == 0, 1.0).otherwise(x)
    # Scaling parameters and the newest row come from one pass over the rows.
    params = rows.groupBy(key).agg(
        F.max(ts).alias("_now"), F.max_by(F.struct(*feature_cols), F.col(ts)).alias("_newest"),
        F.struct(*[F.avg(c).alias(c) for c in feature_cols]).alias("_centre"),
        F.struct(*[nonzero(F.stddev_pop(c)).alias(c) for c in feature_cols]).alias("_scale"))
    joined = rows.join(params, key)

    def scaled(column, c):
        return (column - F.col(f"_centre.{c}")) / F.col(f"_scale.{c}")

    here = [scaled(F.col(c), c) for c in feature_cols]
    there = [scaled(F.col(f"_newest.{c}"), c) for c in feature_cols]
    length = lambda parts: F.sqrt(reduce(add, [x * x for x in parts]))
    product = reduce(add, [x * y for x, y in zip(here, there)])
    score = product / (nonzero(length(here)) * nonzero(length(there)))
    return joined.select(*df.columns, "_now", score.alias("similarity"))


def top_days(df, feature_cols, k=4, min_age_days=7, key=KEY, ts=TS):
    """The k most similar calendar days per station, at least a week old.

    A station too short to hold any such row falls back to all rows but its
    newest. Rows combine to days before anything is ranked, so the ranking sees
    one row per day.
    """
    scored = similarities(df, feature_cols, key, ts)
    old = F.col(ts) <= F.col("_now") - F.expr(f"INTERVAL {int(min_age_days)} DAYS")
    best = F.struct(F.col("similarity"), -F.unix_seconds(ts))
    row = F.struct(ts, "similarity", "us_aqi", "wind_speed_10m", "relative_humidity_2m")
    days = (
        scored.where(F.col(ts) < F.col("_now"))
        .groupBy(key, F.to_date(ts).alias("_day"), old.alias("_old"))
        .agg(F.max_by(row, best).alias("_row"), F.max("similarity").alias("_similarity"),
             F.max_by(-F.unix_seconds(ts), best).alias("_tie"))
    )
    station = Window.partitionBy(key)
    usable = days.withColumn("_any_old", F.max("_old").over(station)).where(
        F.col("_old") | ~F.col("_any_old"))
    order = station.orderBy(F.desc("_similarity"), F.desc("_tie"))
    ranked = usable.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    wind, humidity = F.bround("_row.wind_speed_10m", 1), F.bround("_row.relative_humidity_2m", 1)
    return ranked.select(
        key, "place", F.date_format("_day", "MMM dd, yyyy").alias("date"),
        F.bround("_row.us_aqi", 0).cast("int").alias("historical_aqi"),
        F.col("_row.similarity").alias("cosine"),
        similarity_score(F.col("_row.similarity")).alias("similarity"),
        wind.alias("wind"), humidity.alias("humidity"), (humidity > 70).alias("humidity_high"))
