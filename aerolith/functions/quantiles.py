"""Exact interpolated quantiles of groups too large for one task.

The built-in exact percentile keeps every distinct value of a group in the
memory of one task. Here a wanted rank descends through ranges of values: a double is read as a
64-bit number of the same order, its first 16 bits are counted, the range that holds the
rank is kept, and the next 16 bits are counted among the values of that range alone. After
four counts the rank's value is known to the last bit. Counts combine before their shuffle and
have at most 65,536 ranges per wanted rank, so neither many rows nor many distinct values meet in a task.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolith import session

#: Bits of a step, and steps of the descent.
BITS, STEPS = 16, 4
_TOP = -(1 << 63)
_MANTISSA = float(1 << 52)
_LEAST, _NORMAL = 5e-324, 2.2250738585072014e-308


def ordered_bits(value):
    """A double as a long of the same order: its exponent and mantissa, with the sign. Both zeros are 0, NaN is the largest."""
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    over = size / F.pow(F.lit(2.0), guess)
    power = guess + F.when(over >= 2, 1).when(over < 1, -1).otherwise(0)
    mantissa = ((size / F.pow(F.lit(2.0), power) - 1) * F.lit(_MANTISSA)).cast("long")
    bits = (F.when(F.isnan(value), F.lit(2048 * (1 << 52) - 1)).when(size == float("inf"), F.lit(2047 << 52))
            .when(size == 0, F.lit(0)).when(size < _NORMAL, (size / F.lit(_LEAST)).cast("long"))
            .otherwise((power + 1023).cast("long") * F.lit(1 << 52) + mantissa))
    return F.when(value < 0, -bits).otherwise(bits)


def from_bits(bits):
    """The double of ordered_bits."""
    size = F.abs(bits)
    power, mantissa = F.shiftright(size, 52), size.bitwiseAND((1 << 52) - 1)
    value = (F.when(power == 2047, F.when(mantissa == 0, float("inf")).otherwise(float("nan")))
             .when(power == 0, mantissa * F.lit(_LEAST))
             .otherwise((1 + mantissa / F.lit(_MANTISSA)) * F.pow(F.lit(2.0), power - 1023)))
    return F.when(bits < 0, -value).otherwise(value)


def _digit(step):
    """The unsigned digit of a step, the highest first."""
    return F.shiftrightunsigned("_b", BITS * (STEPS - 1 - step)).bitwiseAND((1 << BITS) - 1)


def _prefix(step):
    """The digits before a step, as one number."""
    return F.shiftrightunsigned("_b", BITS * (STEPS - step))


def _descend(rows, by, probs):
    """Values at the ranks around each probability: (*by, _n, _k, _v)."""
    whole = Window.partitionBy(*by)
    counts = rows.groupBy(*by, _digit(0).alias("_d")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(whole.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(r), F.ceil(r)) for r in (_rank(p) for p in probs)])))
    ranged = counts.select("*", upto.alias("_to"), F.sum("_c").over(whole).alias("_n"))
    inside = F.filter(ranks, lambda k: (F.col("_to") - F.col("_c") <= k) & (k < F.col("_to")))
    found = ranged.select(*by, "_n", F.explode(inside).alias("_k"), F.col("_d").alias("_p"), (F.col("_to") - F.col("_c")).alias("_from"))
    found = session.store(found.select(*by, "_n", "_k", "_p", (F.col("_k") - F.col("_from")).alias("_left")), "ranks")
    for step in range(1, STEPS):
        ranges = found.select(*by, "_p").distinct()
        near = rows.withColumn("_p", _prefix(step)).join(ranges, [*by, "_p"], "left_semi")
        counts = near.groupBy(*by, "_p", _digit(step).alias("_d")).agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*by, "_p").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
        ranged = counts.select(*by, "_p", "_d", "_c", upto.alias("_to"))
        hit = found.join(ranged, [*by, "_p"]).where((F.col("_to") - F.col("_c") <= F.col("_left")) & (F.col("_left") < F.col("_to")))
        found = session.store(hit.select(
            *by, "_n", "_k", F.shiftleft("_p", BITS).bitwiseOR(F.col("_d")).alias("_p"),
            (F.col("_left") - F.col("_to") + F.col("_c")).alias("_left")), "ranks")
    return found.select(*by, "_n", "_k", from_bits(F.col("_p").bitwiseXOR(F.lit(_TOP))).alias("_v"))


def _rank(p):
    # Rounded, so that a rank meant to be whole (0.15 of 100) does not miss by an ulp.
    return F.round(F.lit(p) * (F.col("_n") - 1), 9)


def quantiles_of(df, by, columns, probs):
    """Long result for several columns: the grouping columns, ``feature``, ``prob`` and ``value`` (linear interpolation).

    A row is stored once with its columns as one array; a group without any value of a column does not appear.
    """
    by, columns, probs = list(by), list(columns), sorted(float(p) for p in probs)
    kept = session.store(df.select(
        F.struct(F.lit(0).alias("_"), *by).alias("_g"),
        F.array(*[ordered_bits(F.col(c).cast("double")).bitwiseXOR(F.lit(_TOP)) for c in columns]).alias("_bs")), "values")
    rows = kept.select("_g", F.posexplode("_bs").alias("_f", "_b")).where("_b IS NOT NULL")
    found = _descend(rows, ["_g", "_f"], probs).groupBy("_g", "_f", "_n").agg(
        F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_at"))
    names = F.array(*[F.lit(c) for c in columns])

    def between(p):
        rank = _rank(p)
        low, high = F.element_at("_at", F.floor(rank)), F.element_at("_at", F.ceil(rank))
        return F.struct(F.lit(p).alias("prob"), F.when(low == high, low).otherwise(low + (high - low) * (rank - F.floor(rank))).alias("value"))

    return found.select(*[F.col(f"_g.{b}").alias(b) for b in by], F.get(names, F.col("_f")).alias("feature"),
                        F.inline(F.array(*[between(p) for p in probs])))


def quantiles(df, by, value, probs):
    """Long result: the grouping columns, ``prob`` and ``value`` (linear interpolation).

    Groups without any value do not appear.
    """
    return quantiles_of(df, by, [value], probs).drop("feature")


def quantiles_wide(df, by, value, names):
    """``names`` maps a result column to its probability; one row per group."""
    long = quantiles(df, by, value, list(names.values()))
    return long.groupBy(*by).agg(*[
        F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(name)
        for name, p in names.items()
    ])
