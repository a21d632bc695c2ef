"""Data audits and profiles, each a few aggregations over the whole table."""

from pyspark.sql import functions as F

from aerolith.functions.columns import BANDS, band_number
from aerolith.functions.quantiles import quantiles_wide
from aerolith.operators.series import HOUR, KEY, TS, with_frames

WINTER = (11, 12, 1, 2)
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def missing(df, columns):
    """Columns with missing values: count and percent, from one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[
        F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c) for c in columns])
    long = counts.unpivot("_n", list(columns), "column_name", "missing_count")
    return long.where("missing_count > 0").select(
        "column_name", "missing_count", (F.col("missing_count") * 100.0 / F.col("_n")).alias("missing_pct"))


def gaps(df, step_hours=1, key=KEY, ts=TS):
    """Rows whose predecessor is more than a step away."""
    steps = with_frames(df.select(key, ts), lambda f: {"previous_ts": f.shift(ts, 1)}, before=1, key=key, ts=ts)
    hours = (F.unix_seconds(ts) - F.unix_seconds("previous_ts")) / F.lit(HOUR)
    return steps.withColumn("gap_hours", hours).where(F.col("gap_hours") > step_hours)


def missing_hours(df, key=KEY, ts=TS):
    """Hours between a station's first and last row that it did not report."""
    span = df.groupBy(key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    days = span.select(key, "_a", "_b", F.explode(F.sequence(
        F.date_trunc("day", "_a"), F.date_trunc("day", "_b"), F.expr("INTERVAL 1 DAY"))).alias("_d"))
    spine = days.select(key, "_a", "_b", F.explode(F.sequence(
        F.col("_d"), F.col("_d") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))).alias(ts))
    spine = spine.where(F.col(ts).between(F.col("_a"), F.col("_b"))).select(key, ts)
    return spine.join(df.select(key, ts), [key, ts], "left_anti")


def summary(df, key=KEY, ts=TS):
    return df.groupBy(key).agg(
        F.count("*").alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.lit(len(df.columns)).alias("columns"))


STATS = {
    "count": F.count, "mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min,
}


def profile(df, by, value, stats=("mean", "std", "median")):
    """Statistics of a value by group; the median is exact."""
    plain = [STATS[s](value).alias(f"{s}_{value}") for s in stats if s != "median"]
    result = df.groupBy(*by).agg(*plain)
    if "median" in stats:
        middle = quantiles_wide(df, by, value, {f"median_{value}": 0.5})
        result = result.join(middle, list(by), "left")
    return result


def with_spine(grouped, key, column, values):
    """Every station with every value of a small fixed list, empty groups included.

    A station's groups become one small map and are read back in list order, so
    the profile is computed once and not joined with itself.
    """
    stats = [c for c in grouped.columns if c not in (key, column)]
    packed = grouped.groupBy(key).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col(column), F.struct(*stats)))).alias("_groups"))
    places = F.explode(F.array(*[F.lit(v) for v in values])).alias(column)
    found = F.try_element_at("_groups", F.col(column))
    return packed.select(key, "_groups", places).withColumn("_g", found).select(
        key, column, *[F.col(f"_g.{c}").alias(c) for c in stats])


def diurnal(df, value="us_aqi", key=KEY, ts=TS):
    return profile(df.withColumn("hour", F.hour(ts)), [key, "hour"], value)


def peak_hours(df, value="us_aqi", key=KEY, ts=TS):
    """Hour of day with the highest and the lowest mean, earlier hour on a tie."""
    hourly = df.groupBy(key, F.hour(ts).alias("hour")).agg(F.avg(value).alias("_m"))
    return hourly.groupBy(key).agg(
        F.max_by("hour", F.struct("_m", -F.col("hour"))).alias("peak_hour"), F.max("_m").alias("peak_mean"),
        F.min_by("hour", F.struct("_m", "hour")).alias("lowest_hour"), F.min("_m").alias("lowest_mean"))


def weekdays(df, value="us_aqi", key=KEY, ts=TS):
    by_day = profile(df.withColumn("weekday", F.weekday(ts)), [key, "weekday"], value,
                     ("mean", "median", "std"))
    full = with_spine(by_day, key, "weekday", list(range(7)))
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return full.withColumn("day_name", F.get(names, F.col("weekday")))


def months(df, value="us_aqi", key=KEY, ts=TS):
    by_month = profile(df.withColumn("month", F.month(ts)), [key, "month"], value, ("mean", "std"))
    named = F.date_format(F.make_date(F.lit(2000), "month", F.lit(1)), "MMM")
    return with_spine(by_month, key, "month", list(range(1, 13))).withColumn("month_name", named)


def season_contrast(df, value="us_aqi", key=KEY, ts=TS, winter=WINTER):
    cold = F.month(ts).isin(*winter)
    return df.groupBy(key).agg(
        F.avg(F.when(cold, F.col(value))).alias("winter_mean"),
        F.avg(F.when(~cold, F.col(value))).alias("rest_mean"))


def years(df, value="us_aqi", key=KEY, ts=TS):
    return profile(df.withColumn("year", F.year(ts)), [key, "year"], value,
                   ("count", "mean", "median", "std", "max"))


def rain_contrast(df, value="us_aqi", rain="precipitation", key=KEY, threshold=0.1):
    """Dry against wet hours; an unknown rainfall counts as dry, as a comparison
    with a missing number is false."""
    wet = F.coalesce(F.col(rain) > threshold, F.lit(False))
    return profile(df.withColumn("has_rain", wet), [key, "has_rain"], value,
                   ("count", "mean", "median", "std"))


def bands(df, value, by=(KEY,)):
    """Counts and percent per band, zero bands included, unknown values apart."""
    numbered = df.withColumn("_band", band_number(F.col(value)))
    known = [F.count(F.when(F.col("_band") == i + 1, 1)).alias(label) for i, (_, label, _) in enumerate(BANDS)]
    counted = numbered.groupBy(*by).agg(
        F.count("*").alias("_n"), *known, F.count(F.when(F.col(value).isNull(), 1)).alias("Unknown"))
    labels = [label for _, label, _ in BANDS] + ["Unknown"]
    long = counted.unpivot([*by, "_n"], labels, "category", "hours")
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("category"))
    return long.select(*by, place.alias("place"), "category", "hours",
                       (F.col("hours") * 100.0 / F.col("_n")).alias("pct"))


def histogram(df, value, bins=50, key=KEY):
    """Equal-width counts between a station's extremes, empty bins included; the
    last bin is closed on the right."""
    bounds = df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    place = F.floor(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)
    counted = (
        df.where(F.col(value).isNotNull()).join(bounds, key)
        .groupBy(key, F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("hours"))
    )
    spine = bounds.where("_lo IS NOT NULL").select(
        key, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_lo", width.alias("_w"))
    return spine.join(counted, [key, "bin"], "left").select(
        key, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left_edge"),
        F.coalesce("hours", F.lit(0)).alias("hours"))


def box_stats(df, by, value):
    """Quartiles and whiskers: the extremes within 1.5 box lengths of the box."""
    quartiles = quantiles_wide(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        df.join(quartiles, list(by)).where(inside)
        .groupBy(*by, "q1", "median", "q3")
        .agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    )


def quantile_trend(df, x, y, bins=20, key=KEY):
    """Mean of both columns in equally filled bins of x: interpolated edges, equal
    edges merged, bins closed on the right, the smallest value in the first bin."""
    names = {f"_e{i}": i / bins for i in range(bins + 1)}
    edges = quantiles_wide(df, [key], x, names).select(
        key, F.array_distinct(F.array(*names)).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(x)))
    return (
        df.where(F.col(x).isNotNull()).join(edges, key)
        .groupBy(key, F.greatest(below, F.lit(1)).alias("bin"))
        .agg(F.avg(x).alias(f"mean_{x}"), F.avg(y).alias(f"mean_{y}"), F.count("*").alias("hours"))
    )


def peak_ramp(df, value="us_aqi", around=5, key=KEY, ts=TS):
    """Hour-to-hour change in the rows next to a station's maximum."""
    steps = with_frames(
        df.select(key, ts, value),
        lambda f: {"delta": F.col(value) - f.shift(value, 1)}, before=1, key=key, ts=ts, keep=("_idx",))
    top = steps.groupBy(key).agg(
        F.max_by("_idx", F.struct(F.col(value), -F.col("_idx"))).alias("_peak"))
    near = F.abs(F.col("_idx") - F.col("_peak")) <= around
    return steps.join(top, key).where(near).select(
        key, ts, value, "delta", (F.col("_idx") - F.col("_peak")).alias("offset"))
