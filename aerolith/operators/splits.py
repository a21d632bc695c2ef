"""Chronological splits with an embargo, expanding folds, and sample weights."""

from pyspark.sql import functions as F

from aerolith.operators.series import HOUR, KEY, TS, row_index

EMBARGO_HOURS = 72
# A fixed origin keeps the exponent small; it cancels when weights are averaged to 1.
ORIGIN = "2000-01-01"
YEAR_SECONDS = 365.25 * 24 * 3600


def indexed(df, key=KEY, ts=TS):
    return df if "_idx" in df.columns else row_index(df, key, ts)


def _tidy(df):
    return df.drop("_idx", "_n", "_cut", "_cut2")


def first_row(share):
    """Number of the first row of the part that holds the last ``share`` of a series."""
    return F.floor(F.col("_n") * F.lit(1 - share))


def chrono(df, test_ratio=0.2, key=KEY, ts=TS):
    """The first part of each series trains, the rest tests; no gap."""
    label = F.when(F.col("_idx") < first_row(test_ratio), "train").otherwise("test")
    return _tidy(indexed(df, key, ts).withColumn("split", label))


def embargoed(df, test_ratio=0.2, val_ratio=0.0, embargo_hours=EMBARGO_HOURS, train_since=None, key=KEY, ts=TS):
    """train / [validation] / test with an embargo before every later part.

    A row is embargoed when a part after it starts within ``embargo_hours``, so
    that no target of an earlier row lies inside a later part. ``train_since``
    drops older training rows and leaves the other parts as they are.
    """
    rows = indexed(df, key, ts)
    first_test, first_val = first_row(test_ratio), first_row(test_ratio + val_ratio)
    starts = rows.groupBy(key).agg(
        F.min(F.when(F.col("_idx") >= first_test, F.col(ts))).alias("_cut2"),
        F.min(F.when(F.col("_idx") >= first_val, F.col(ts))).alias("_cut"))
    seconds = F.unix_seconds(ts)

    def clear_of(start):
        return seconds + embargo_hours * HOUR < F.unix_seconds(start)

    label = F.when(F.col("_idx") >= first_test, "test")
    if val_ratio:
        label = label.when(F.col("_idx") >= first_val,
                           F.when(clear_of("_cut2"), "validation").otherwise("embargo"))
    label = label.when(clear_of("_cut"), "train").otherwise("embargo")
    if train_since is not None:
        old = (label == "train") & (F.col(ts) < F.lit(train_since).cast("timestamp"))
        label = F.when(old, "unused").otherwise(label)
    return _tidy(rows.join(starts, key).withColumn("split", label))


def fold_role(fold, n_splits):
    """train, test or null: the part a numbered row plays in an expanding fold."""
    size = F.floor(F.col("_n") / F.lit(n_splits + 1))
    start = F.col("_n") - (F.lit(n_splits + 1) - fold) * size
    return F.when(F.col("_idx") < start, "train").when(F.col("_idx") < start + size, "test")


def _clear(embargo_hours, ts):
    """A training row whose targets end before the test part starts."""
    return F.unix_seconds(ts) + embargo_hours * HOUR < F.unix_seconds("_start")


def folds(df, n_splits=3, embargo_hours=EMBARGO_HOURS, key=KEY, ts=TS):
    """Expanding folds: every row once per fold it plays a part in. Training rows within
    ``embargo_hours`` of the fold's first test row play none."""
    each = indexed(df, key, ts).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    each = each.withColumn("role", fold_role(F.col("fold"), n_splits)).where(F.col("role").isNotNull())
    starts = each.where("role = 'test'").groupBy(key, "fold").agg(F.min(ts).alias("_start"))
    kept = each.join(starts, [key, "fold"]).where((F.col("role") == "test") | _clear(embargo_hours, ts))
    return _tidy(kept.drop("_start"))


def fold_parts(df, n_splits, embargo_hours=EMBARGO_HOURS, key=KEY, ts=TS):
    """Each row once, with ``parts``: its part in fold 1, 2 ... as letters, T trains, t tests, - neither. The embargo is that of ``folds``."""
    rows = indexed(df, key, ts)
    roles = {fold: fold_role(F.lit(fold), n_splits) for fold in range(1, n_splits + 1)}
    starts = rows.groupBy(key).agg(*[
        F.min(F.when(role == "test", F.col(ts))).alias(f"_start{fold}") for fold, role in roles.items()])
    letters = [F.when(role == "test", "t").when(
        (role == "train") & (F.unix_seconds(ts) + embargo_hours * HOUR < F.unix_seconds(f"_start{fold}")), "T").otherwise("-")
        for fold, role in roles.items()]
    dropped = [f"_start{fold}" for fold in roles]
    return _tidy(rows.join(starts, key).withColumn("parts", F.concat(*letters)).drop(*dropped))


def one_fold(rows, fold, n_splits, embargo_hours=EMBARGO_HOURS, key=KEY, ts=TS):
    """Training and test rows of one fold of a numbered table, with the same embargo."""
    role = fold_role(F.lit(fold), n_splits)
    test = rows.where(role == "test")
    starts = test.groupBy(key).agg(F.min(ts).alias("_start"))
    train = rows.where(role == "train").join(starts, key).where(_clear(embargo_hours, ts)).drop("_start")
    return _tidy(train), _tidy(test)


def window_consistency(df, horizons, key=KEY, ts=TS):
    """Count, first and last test hour per horizon; equal rows mean a shared window."""
    return df.groupBy(key).agg(*[
        F.struct(F.count(h).alias("rows"),
                 F.min(F.when(F.col(h).isNotNull(), F.col(ts))).alias("first_ts"),
                 F.max(F.when(F.col(h).isNotNull(), F.col(ts))).alias("last_ts")).alias(h)
        for h in horizons
    ]).select(key, F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"{h}.rows"), F.col(f"{h}.first_ts"), F.col(f"{h}.last_ts"))
        for h in horizons])))


def mean_one(df, weight, by=(KEY,)):
    """Scale a weight so that it averages 1 in each group."""
    means = df.groupBy(*by).agg(F.avg(weight).alias("_mean_weight"))
    return df.join(means, list(by)).withColumn(weight, F.col(weight) / F.col("_mean_weight")).drop("_mean_weight")


def recency_weight(df, decay=0.5, name="weight_recency", by=(KEY,), ts=TS):
    """exp(-decay * age in years), averaged to 1. The newest time cancels out, so
    no pass is needed to find it."""
    years = (F.unix_seconds(ts) - F.unix_seconds(F.lit(ORIGIN).cast("timestamp"))) / F.lit(YEAR_SECONDS)
    return mean_one(df.withColumn(name, F.exp(years * decay)), name, by)


def event_weight(df, condition, factor=2.5, name="weight_event", by=(KEY,)):
    """``factor`` where the condition holds, else 1, averaged to 1."""
    return mean_one(df.withColumn(name, F.when(condition, factor).otherwise(1.0)), name, by)


def smog(now="us_aqi", ahead="aqi_day2", limit=150):
    return (F.col(now) > limit) | (F.col(ahead) > limit)
