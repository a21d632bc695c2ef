"""Column expressions: everything here stays inside generated JVM code."""

import math

from pyspark.sql import functions as F

# Upper edges (inclusive), labels and advice of the index bands.
BANDS = [
    (50, "Good (0-50)", "Air quality is satisfactory. Ideal for outdoor activities."),
    (100, "Moderate (51-100)", "Air quality is acceptable for most individuals."),
    (150, "Unhealthy Sensitive (101-150)", "Limit prolonged outdoor exertion."),
    (200, "Unhealthy (151-200)", "Everyone may begin to experience health effects."),
    (300, "Very Unhealthy (201-300)", "Emergency warning: Avoid all outdoor activities."),
    (None, "Hazardous (301+)", "Emergency warning: Avoid all outdoor activities."),
]

# Source column, display name, limit, unit.
POLLUTANT_LIMITS = [
    ("pm2_5", "PM2.5", 35, "µg/m³"),
    ("pm10", "PM10", 150, "µg/m³"),
    ("nitrogen_dioxide", "NO2", 53, "ppb"),
    ("ozone", "O3", 70, "ppb"),
]


def blank_nan(column):
    """NaN means missing at the edge of the engine; inside there are only nulls."""
    return F.nanvl(column, F.lit(None).cast("double"))


def clean(df, columns):
    return df.withColumns({c: blank_nan(F.col(c).cast("double")) for c in columns})


def cycle(column, period, name):
    """Sine and cosine of a position in a cycle."""
    angle = column * F.lit(2 * math.pi) / F.lit(float(period))
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def calendar_cycles(ts):
    """Hour of day, day of week (Monday 0) and month of year on the circle."""
    return {
        **cycle(F.hour(ts), 24, "hour"),
        **cycle(F.weekday(ts), 7, "day"),
        **cycle(F.month(ts), 12, "month"),
    }


def _by_band(column, position):
    bounded = [band for band in BANDS if band[0] is not None]
    first, *rest = bounded
    chain = F.when(column <= first[0], first[position])
    for band in rest:
        chain = chain.when(column <= band[0], band[position])
    return chain.when(column.isNotNull(), BANDS[-1][position])


def aqi_band(column):
    """Band label; an unknown value has no band."""
    return _by_band(column, 1)


def aqi_advice(column):
    return _by_band(column, 2)


def band_number(column):
    """1-based position of the band, for ordering."""
    return sum(
        (F.when(column > upper, 1).otherwise(0) for upper, *_ in BANDS[:-1]),
        F.when(column.isNotNull(), F.lit(1)),
    )


def limit_percent(value, limit):
    """Whole percent of a limit, cut toward zero."""
    return (value / limit * 100).cast("int")


def limit_status(value, limit):
    """Status that follows from the ratio to the limit."""
    ratio = value / limit
    return (
        F.when(ratio <= 0.5, "Good")
        .when(ratio <= 1.0, "Moderate")
        .when(ratio <= 2.0, "Unhealthy")
        .when(ratio.isNotNull(), "Hazardous")
    )


def improvement_pct(baseline, model):
    """Positive when the model's error is the smaller one; null for a zero baseline."""
    return F.try_divide(baseline - model, baseline) * 100


def similarity_score(cosine):
    """Cosine on a 0 to 100 scale, half-even to one decimal, not clamped."""
    return F.bround((cosine + 1) / 2 * 100, 1)


def clock_label(ts):
    """'12 AM', '1 AM', ... '11 PM'."""
    return F.date_format(ts, "h a")


def is_daylight(ts):
    return F.hour(ts).between(6, 18)


def title_name(column):
    """Feature name as a title: 'us_aqi_lag_2h' becomes 'Us Aqi Lag 2H'."""
    words = F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))
    return F.regexp_replace(words, "([0-9])h$", "$1H")


def safe_corr(x, y):
    """Pearson correlation over complete pairs; null when a side is constant.

    The built-in corr raises on a constant side under ANSI, so the quotient is
    formed from its parts.
    """
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), F.when(spread > 0, spread))
