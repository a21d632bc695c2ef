"""Lag, rolling, change and calendar features, and the targets ahead."""

from typing import NamedTuple

from pyspark.sql import functions as F

from aerolith.functions.columns import calendar_cycles
from aerolith.operators.series import INDEX, KEY, TS, rolling, with_frames

# Measured columns, in the order of the feature vector.
WEATHER = [
    "temperature_2m", "relative_humidity_2m", "dew_point_2m", "apparent_temperature",
    "precipitation", "rain", "surface_pressure", "cloud_cover", "wind_speed_10m",
    "wind_direction_10m", "wind_gusts_10m",
]
AIR = [
    "pm2_5", "pm10", "ozone", "nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide",
    "dust", "aerosol_optical_depth", "us_aqi",
]
MEASURES = WEATHER + AIR
CYCLES = ["hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos"]

# Which lags, window lengths and changes belong to the feature table.
LAG_HOURS = {
    "us_aqi": [1, 2, 3, 6, 24, 48, 72, 96],
    "pm2_5": [1, 24, 48, 72],
    "pm10": [1, 24],
    "temperature_2m": [1, 24],
    "wind_speed_10m": [1, 6],
    "relative_humidity_2m": [1],
    "surface_pressure": [1],
}
MEAN_HOURS = {"us_aqi": [12, 24, 72], "pm2_5": [24], "surface_pressure": [24]}
SUM_HOURS = {"precipitation": [6, 24], "rain": [6, 24]}
CHANGES = {"aqi_change_rate_1h": "us_aqi", "pm2_5_change_rate_1h": "pm2_5"}
HORIZONS = {"aqi_day1": 24, "aqi_day2": 48, "aqi_day3": 72}
REBUILT = [
    "us_aqi_lag_2h", "us_aqi_lag_3h", "us_aqi_lag_96h", "us_aqi_rolling_mean_12h",
    "pm2_5_change_rate_1h", "surface_pressure_rolling_mean_24h",
]


class Feature(NamedTuple):
    name: str
    kind: str
    source: str
    hours: int

    def column(self, frames):
        source = F.col(self.source)
        if self.kind == "lag":
            return frames.shift(self.source, self.hours)
        if self.kind == "change":
            return source - frames.shift(self.source, self.hours)
        return rolling(frames, {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp}[self.kind],
                       self.source, self.hours)

    @property
    def reach(self):
        return self.hours if self.kind in ("lag", "change") else self.hours - 1


def lag(source, hours):
    return Feature(f"{source}_lag_{hours}h", "lag", source, hours)


def mean(source, hours):
    return Feature(f"{source}_rolling_mean_{hours}h", "mean", source, hours)


def total(source, hours):
    return Feature(f"{source}_rolling_sum_{hours}h", "sum", source, hours)


def spread(source, hours):
    return Feature(f"{source}_rolling_std_{hours}h", "std", source, hours)


def change(name, source, hours=1):
    return Feature(name, "change", source, hours)


def _each(make, table):
    return [make(source, hours) for source, lengths in table.items() for hours in lengths]


STANDARD = (
    _each(lag, LAG_HOURS) + _each(mean, MEAN_HOURS) + _each(total, SUM_HOURS)
    + [change(name, source) for name, source in CHANGES.items()]
)
CANDIDATES = [
    mean("us_aqi", 6), mean("us_aqi", 48), mean("us_aqi", 168),
    spread("us_aqi", 6), spread("us_aqi", 24), lag("us_aqi", 120),
    lag("wind_gusts_10m", 1), change("day_over_day_delta", "us_aqi", 24),
    mean("pm2_5", 48), total("precipitation", 72),
]
FEATURE_COLUMNS = MEASURES + CYCLES + [f.name for f in STANDARD]
STORED_COLUMNS = (
    [KEY, TS] + [c for c in FEATURE_COLUMNS if c not in REBUILT] + list(HORIZONS)
)


def calendar(df, ts=TS):
    """The six cyclical columns; no ordering, no shuffle."""
    return df.withColumns(calendar_cycles(F.col(ts)))


def add(df, features, horizons=None, target="us_aqi", mode="row", key=KEY, ts=TS, block=None, keep=()):
    """Add features and, if asked, targets with one ordered pass over the series."""
    horizons = horizons or {}

    def build(frames):
        columns = {f.name: f.column(frames) for f in features}
        columns.update({name: frames.shift(target, -hours) for name, hours in horizons.items()})
        return columns

    return with_frames(
        df, build,
        before=max([f.reach for f in features], default=0),
        after=max(horizons.values(), default=0),
        mode=mode, key=key, ts=ts, block=block, keep=keep,
    )


def build(df, horizons=None, mode="row", key=KEY, ts=TS, block=None, keep=()):
    """The whole feature table of observations, in the standard column order."""
    added = add(df, STANDARD, horizons, mode=mode, key=key, ts=ts, block=block, keep=keep)
    return calendar(added, ts).select(key, ts, *FEATURE_COLUMNS, *(horizons or {}), *keep)


def targets(df, column="us_aqi", horizons=None, mode="row", key=KEY, ts=TS, block=None, keep=()):
    """The same column 24, 48 and 72 hours ahead."""
    return add(df, [], horizons or HORIZONS, column, mode, key, ts, block, keep)


def ensure(df, names, mode="row", key=KEY, ts=TS, block=None):
    """Add those of ``names`` that are absent and whose source column is there."""
    known = {f.name: f for f in STANDARD + CANDIDATES}
    missing = [known[n] for n in names if n not in df.columns and known[n].source in df.columns]
    return add(df, missing, mode=mode, key=key, ts=ts, block=block) if missing else df


def feature_names(df, key=KEY, ts=TS):
    """Every column but the key, the time, the place and the targets."""
    return [c for c in df.columns if c not in (key, ts, "city", *HORIZONS, *INDEX)]


def missing_count(columns):
    """How many of the columns are null in a row."""
    return sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in columns), F.lit(0))


def complete(df, columns=None):
    """Rows with every feature and target present (after NaN became null).

    One count instead of a null test per column: dozens of separate tests become
    constraints that the optimizer carries through every later join. Row numbers
    kept from before no longer hold and are dropped.
    """
    columns = columns or feature_names(df) + [h for h in HORIZONS if h in df.columns]
    return df.where(missing_count(columns) == 0).drop(*INDEX)


def align(df, expected, key=KEY, ts=TS):
    """Project to exactly the expected features, count what was missing, fill with 0."""
    found = {c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
             for c in expected}
    missing = sum((F.when(c.isNull(), 1).otherwise(0) for c in found.values()), F.lit(0))
    return df.select(key, ts, *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in found.items()],
                     missing.alias("n_missing"))
