"""Scaling with parameters fitted once and applied as they are."""

from pyspark.sql import functions as F

from aerolith.functions.quantiles import quantiles_of
from aerolith.operators.series import KEY


def fit(df, columns, kind="standard", by=(KEY,)):
    """One row per group and column: centre and scale.

    ``standard`` is mean and population deviation, ``robust`` exact median and
    interquartile range. A scale of 0 becomes 1.
    """
    if kind == "standard":
        # Side by side in one pass; the one row a group gives is then laid out by column.
        sums = df.groupBy(*by).agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns
                                     for n, f in (("centre", F.avg), ("scale", F.stddev_pop))])
        found = sums.select(*by, F.inline(F.array(*[F.struct(
            F.lit(c).alias("feature"), F.col(f"{c}__centre").alias("centre"), F.col(f"{c}__scale").alias("scale")) for c in columns])))
    elif kind == "robust":
        at = lambda p: F.max(F.when(F.col("prob") == F.lit(p), F.col("value")))
        found = quantiles_of(df, by, columns, [0.25, 0.5, 0.75]).groupBy(*by, "feature").agg(
            at(0.5).alias("centre"), (at(0.75) - at(0.25)).alias("scale"))
    else:
        raise ValueError(f"kind is 'standard' or 'robust', not {kind!r}")
    return found.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def wide(params, columns, by=(KEY,)):
    """The parameters of a group in one row."""
    pick = lambda c, part: F.max(F.when(F.col("feature") == c, F.col(part)))
    return params.groupBy(*by).agg(
        *[pick(c, "centre").alias(f"{c}__centre") for c in columns],
        *[pick(c, "scale").alias(f"{c}__scale") for c in columns])


def apply(df, params, columns, by=(KEY,)):
    """Scale columns in place with given parameters; nothing is refitted."""
    joined = df.join(wide(params, columns, by), list(by))
    scaled = joined.withColumns({
        c: (F.col(c) - F.col(f"{c}__centre")) / F.col(f"{c}__scale") for c in columns})
    return scaled.select(*df.columns)
