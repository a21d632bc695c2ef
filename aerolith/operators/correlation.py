"""Correlation between columns and of a series with its own past."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolith.functions.columns import safe_corr
from aerolith.operators.series import KEY, TS, row_blocks

Z95 = 1.959963984540054


def pair(df, x, y, by=(KEY,)):
    return df.groupBy(*by).agg(safe_corr(F.col(x), F.col(y)).alias("corr"))


def matrix(df, columns, by=(KEY,)):
    """Lower triangle in long form, each pair over its own complete rows.

    One scan: a row is laid out as its pairs, and the pairs' sums combine before
    the shuffle. Hundreds of aggregates side by side would not compile.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    laid_out = F.posexplode(F.array(*[
        F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]))
    long = df.select(*by, laid_out.alias("_i", "_p")).select(*by, "_i", F.col("_p.x").alias("_x"), F.col("_p.y").alias("_y"))
    found = long.groupBy(*by, "_i").agg(safe_corr(F.col("_x"), F.col("_y")).alias("corr"))
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    name = F.get(names, F.col("_i"))
    return found.select(*by, name["a"].alias("column_a"), name["b"].alias("column_b"), "corr")


def partners(correlations, threshold=0.85, by=(KEY,)):
    """Both directions of every strongly correlated pair."""
    def side(feature, partner):
        return F.struct(F.col(feature).alias("feature"), F.col(partner).alias("partner"), F.col("corr"))

    both = F.array(side("column_a", "column_b"), side("column_b", "column_a"))
    return correlations.where(F.abs("corr") > threshold).select(*by, F.inline(both))


def lagged_sums(df, value, lags, key=KEY, ts=TS, block=None):
    """Per series and lag 0 to ``lags``: the sum of products of a value with its past, and how many there are.

    A block of rows and the ``lags`` rows before it meet in one task, which sums all lags at once; a block gives one row
    with its sums, whatever its length.
    """
    dealt = row_blocks(df.select(key, ts, value), before=lags, key=key, ts=ts, block=block)

    def products(rows):
        rows = rows.sort_values("_idx")
        x, own = rows[value].to_numpy(), (rows["_own"] == rows["_block"]).to_numpy()
        # A block behind the end of the series holds a halo alone.
        first = int(own.argmax()) if own.any() else len(x)
        mine = x[first:]
        sums, counts = [], []
        for lag in range(lags + 1):
            past = x[max(0, first - lag):max(0, len(x) - lag)] if len(mine) else mine
            sums.append(float(mine[len(mine) - len(past):] @ past))
            counts.append(len(past))
        return pd.DataFrame({key: [rows[key].iloc[0]], "sums": [sums], "counts": [counts]})

    parts = dealt.groupBy(key, "_block").applyInPandas(products, f"{key} string, sums array<double>, counts array<long>")
    each = parts.select(key, F.posexplode(F.arrays_zip("sums", "counts")).alias("lag", "p"))
    return each.groupBy(key, "lag").agg(F.sum("p.sums").alias("_sum"), F.sum("p.counts").alias("_c"))


def acf(df, value="us_aqi", lags=120, key=KEY, ts=TS, block=None):
    """Autocorrelation at lags 1 to ``lags`` rows with its 95 % band.

    Null values are dropped first; sums are divided by the full length. The band follows
    from the few resulting rows.
    """
    known = df.where(F.col(value).isNotNull()).select(key, ts, F.col(value).alias("_v"))
    means = known.groupBy(key).agg(F.avg("_v").alias("_m"))
    centred = known.join(means, key).select(key, ts, (F.col("_v") - F.col("_m")).alias("x"))
    sums = lagged_sums(centred, "x", lags, key, ts, block).where("_c > 0")
    station = Window.partitionBy(key).orderBy("lag")
    whole = station.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    long = sums.select(
        key, "lag", F.first("_c").over(whole).alias("n"),
        F.try_divide(F.col("_sum"), F.first("_sum").over(whole)).alias("acf")).where("lag > 0")
    earlier = station.rowsBetween(Window.unboundedPreceding, -1)
    variance = (1 + 2 * F.coalesce(F.sum(F.col("acf") * F.col("acf")).over(earlier), F.lit(0.0))) / F.col("n")
    return long.select(key, "n", "lag", "acf", (F.sqrt(variance) * Z95).alias("band"))


def pacf(df, value="us_aqi", lags=48, key=KEY, ts=TS):
    """Yule-Walker partial autocorrelation with the biased autocovariance, by the
    Durbin-Levinson recursion.

    The recursion sees ``lags`` rows per station, however long the series is. It is
    an inner function so that it travels to the workers whole.
    """
    def recursion(rows):
        rho = rows.sort_values("lag")["acf"].to_numpy()
        partial, phi, error = [], np.zeros(0), 1.0
        for k, r in enumerate(rho):
            reflection = (r - phi @ rho[:k][::-1]) / error
            phi = np.append(phi - reflection * phi[::-1], reflection)
            error *= 1.0 - reflection**2
            partial.append(reflection)
        return pd.DataFrame({
            key: rows[key].iloc[0], "lag": np.arange(1, len(rho) + 1), "pacf": partial,
            "band": Z95 / np.sqrt(rows["n"].iloc[0])})

    few = acf(df, value, lags, key, ts).select(key, "n", "lag", "acf")
    return few.groupBy(key).applyInPandas(recursion, f"{key} string, lag int, pacf double, band double")
