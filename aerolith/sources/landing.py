"""From landed hourly responses to joined observations and training rows."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.operators import features
from aerolith.operators.series import KEY, TS


def explode_hourly(df, fields, key=KEY, ts=TS):
    """One row per step of a response: ``start`` and ``step`` in epoch seconds and
    one array per field. The end is not part of the response."""
    steps = F.posexplode(F.arrays_zip(*[F.col(f) for f in fields])).alias("_i", "_v")
    place = [c for c in ("city",) if c in df.columns]
    exploded = df.select(key, *place, "start", "step", steps)
    when = F.timestamp_seconds(F.col("start") + F.col("_i") * F.col("step")).alias(ts)
    return exploded.select(key, *place, when, *[F.col(f"_v.{f}").cast("double").alias(f) for f in fields])


def pack_hourly(df, fields, key=KEY, ts=TS):
    """The landed form of hourly rows: one response per station and day, 24 slots
    per field, empty where an hour is missing."""
    day = F.unix_seconds(F.date_trunc("day", F.col(ts)))
    slots = F.sequence(F.lit(0), F.lit(23))
    packed = df.groupBy(key, day.alias("start")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.hour(ts).alias("h"), F.struct(*fields).alias("v")))).alias("_m")
    )

    def slots_of(field):
        return F.transform(slots, lambda hour: F.try_element_at("_m", hour)[field]).alias(field)

    return packed.select(key, "start", F.lit(3600).cast("long").alias("step"), *map(slots_of, fields))


def response_schema(fields, key=KEY):
    """A landed response: place, first and end time in epoch seconds, step, and one array a field below ``hourly``."""
    arrays = T.StructType([T.StructField(f, T.ArrayType(T.DoubleType())) for f in fields])
    return T.StructType([
        T.StructField(key, T.StringType()), T.StructField("city", T.StringType()), T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()), T.StructField("step", T.LongType()), T.StructField("hourly", arrays)])


def write_responses(df, fields, path, city, key=KEY):
    """Packed responses as JSON lines."""
    count = F.size(F.col(fields[0]))
    df.select(key, F.lit(city).alias("city"), "start", (F.col("start") + F.col("step") * count).alias("end"), "step",
              F.struct(*fields).alias("hourly")).write.option("ignoreNullFields", "false").json(path, mode="append")
    return path


def read_responses(spark, path, fields, key=KEY):
    """(responses, broken) of landed JSON lines: a folder, read with a fixed schema.

    A line that is no JSON, lacks the key, the times or a field, or whose arrays do not have one value a step, is in ``broken`` with
    its text and the reason; the others are ready for ``explode_hourly``. Neither side fails the other.
    """
    schema = response_schema(fields, key)
    parsed = spark.read.text(path).select("value", F.from_json(
        "value", T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("value", "r.*")
    steps = F.when(F.col("step") > 0, F.floor((F.col("end") - F.col("start")) / F.col("step")))
    sizes = F.array(*[F.size(F.col("hourly")[f]) for f in fields])
    reason = (
        F.when(F.trim("value") == "", "empty").when(F.col("_corrupt").isNotNull(), "not readable")
        .when(F.col(key).isNull() | steps.isNull() | (steps < 0), "no key or times")
        .when(F.exists(sizes, lambda n: F.coalesce(n, F.lit(-1)) < 0), "field missing")
        .when(F.exists(sizes, lambda n: n != steps), "arrays of another length"))
    told = parsed.withColumn("reason", reason)
    good = told.where("reason IS NULL").select(key, "city", "start", "step", *[F.col("hourly")[f].alias(f) for f in fields])
    return good, told.where("reason IS NOT NULL").select("value", "reason")


def join_sources(weather, air, key=KEY, ts=TS):
    """Hours both networks reported."""
    return weather.join(air, [key, ts], "inner")


def between(df, start=None, end=None, ts=TS):
    """Rows of a closed time range; the bounds reach the scan."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast("timestamp"))
    return df


def years_back(end, years=3):
    """Default start of a backfill, as an expression on its end."""
    return F.add_months(end, -12 * years)


def backfill(weather, air, start=None, end=None, mode="row", block=None):
    """Training rows of a period: joined, featured, with targets, complete."""
    joined = join_sources(between(weather, start, end), between(air, start, end))
    clean = joined.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in features.MEASURES})
    return features.complete(features.build(clean, features.HORIZONS, mode, block=block))
