"""The stored feature table: parquet by day, typed, keyed by station and hour."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.operators.features import STORED_COLUMNS
from aerolith.operators.series import KEY, TS

#: Rows of a file at most.
FILE_ROWS = 5_000_000


def schema(columns=STORED_COLUMNS, key=KEY, ts=TS):
    kinds = {key: T.StringType(), ts: T.TimestampType(), "city": T.StringType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in columns])


def project(df, allowed=STORED_COLUMNS, key=KEY, ts=TS):
    """Columns the table knows, in its order and types; others are left out."""
    fields = [f for f in schema(allowed, key, ts) if f.name in df.columns]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def by_day(df, ts):
    return df.withColumn("day", F.date_format(ts, "yyyy-MM-dd"))


def _write(df, path, mode):
    """Rows of a day come together, in as many tasks as the day needs: adaptive execution
    joins small days and splits busy ones, whatever station they come from."""
    (df.hint("rebalance", "day").write.mode(mode).partitionBy("day").option("maxRecordsPerFile", FILE_ROWS)
       .option("partitionOverwriteMode", "dynamic").parquet(path))


def create(df, path, key=KEY, ts=TS):
    """Start a table; fails if there is one."""
    _write(by_day(df, ts), path, "errorifexists")


def read(spark, path, start=None, end=None, columns=None, ts=TS):
    """The table or a time range of it; whole days outside the range are not read."""
    df = spark.read.option("basePath", path).parquet(path)
    if start is not None:
        bound = F.lit(start).cast("timestamp")
        df = df.where((F.col(ts) >= bound) & (F.col("day") >= F.date_format(bound, "yyyy-MM-dd")))
    if end is not None:
        bound = F.lit(end).cast("timestamp")
        df = df.where((F.col(ts) <= bound) & (F.col("day") <= F.date_format(bound, "yyyy-MM-dd")))
    return df.select(*columns) if columns else df.drop("day")


def require_rows(df, name):
    if df.isEmpty():
        raise RuntimeError(f"{name} holds no rows")
    return df


def existing_keys(spark, path, days=None, key=KEY, ts=TS):
    """Distinct keys, from two columns of the touched days only."""
    df = spark.read.option("basePath", path).parquet(path)
    if days is not None:
        df = df.where(F.col("day").isin(days))
    return df.select(key, ts).distinct()


def new_rows(df, keys, key=KEY, ts=TS, on=None):
    """Rows whose key is not stored yet."""
    return df.join(keys, list(on or (key, ts)), "left_anti")


def read_days(spark, path, days):
    """The stored rows of some days with their ``day``, or None when there is no table yet."""
    try:
        return spark.read.option("basePath", path).parquet(path).where(F.col("day").cast("string").isin(days)).withColumn(
            "day", F.date_format("day", "yyyy-MM-dd"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest(df, on, order):
    """One row per key, the one that is last by ``order``; partial results combine
    before the shuffle, so many versions of one key do not meet in one task."""
    rest = [c for c in df.columns if c not in on and c not in order]
    best = F.max_by(F.struct(*rest, *order), F.struct(*order)).alias("_row")
    return df.groupBy(*on).agg(best).select(*on, *[F.col(f"_row.{c}").alias(c) for c in rest + list(order)])


def stored(spark, path, like):
    """The stored rows, or none when there is no table yet."""
    try:
        return spark.read.schema(like.schema).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def _days(df):
    """Touched days; as many as the calendar has, whatever the number of rows."""
    return [row.day for row in df.select("day").distinct().collect()]


def append(spark, df, path, mode="ignore", order=(), key=KEY, ts=TS, on=None):
    """Add rows to the table, starting it if need be. ``on`` names the key columns, station and hour if not given.

    ``ignore`` adds unseen keys and never touches stored rows. ``latest`` lets a
    new row replace a stored one, rewriting only the touched days. Either may be
    repeated with the same rows without changing the table again.
    """
    incoming = by_day(df, ts)
    keys = list(on or (key, ts))
    on = [*keys, "day"]
    # Without an order the largest row wins, so that a repeated task picks the same.
    by = list(order) or [c for c in df.columns if c not in on]
    days = _days(incoming)
    if not days:
        return
    incoming = latest(incoming, on, by) if by else incoming.distinct()
    known = stored(spark, path, incoming).where(F.col("day").isin(days))
    if mode == "ignore":
        _write(new_rows(incoming, known.select(*keys), on=keys), path, "append")
    elif mode == "latest":
        observed = (lambda d: F.when(d["is_forecast"], 0).otherwise(1)) if "is_forecast" in df.columns \
            else (lambda d: F.lit(1))
        both = (
            known.withColumns({"_observed": observed(known), "_new": F.lit(0)})
            .unionByName(incoming.withColumns({"_observed": observed(incoming), "_new": F.lit(1)}))
        )
        merged = latest(both, on, ["_observed", "_new"]).drop("_observed", "_new")
        _write(merged.select(*known.columns), path, "overwrite")
    else:
        raise ValueError(f"mode is 'ignore' or 'latest', not {mode!r}")


def append_jdbc(df, url, table, batch_rows=1000, **options):
    """The same rows into a database, one connection per partition, in batches."""
    (df.write.format("jdbc").mode("append")
       .options(url=url, dbtable=table, batchsize=batch_rows, **options).save())
