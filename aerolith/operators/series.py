"""Ordered work over long station series without one task per station.

Row mode numbers the rows of a series exactly, cuts the numbering into blocks
and hands each block the rows next to it that its frames can reach (a halo).
Time mode cuts the time axis the same way. A window is then partitioned by
(series, block), so the longest series spreads over as many tasks as it has
blocks and a task never sees more than one block and its halo.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

KEY = "station"
TS = "ts"
HOUR = 3600
CELL_HOURS = 24 * 90
BLOCK_ROWS = 8192
BLOCK_HOURS = 24 * 180
INDEX = ("_idx", "_n")


def row_index(df, key=KEY, ts=TS, cell_hours=CELL_HOURS):
    """Add ``_idx``, the 0-based row number in time order, and ``_n``, the length.

    Rows are numbered inside time cells; the cells' small counts give the offsets.
    The timestamp must be unique within the series.
    """
    cell = F.floor(F.unix_seconds(F.col(ts)) / F.lit(cell_hours * HOUR))
    rows = df.withColumn("_cell", cell)
    counts = rows.groupBy(key, "_cell").agg(F.count("*").alias("_c"))
    series = Window.partitionBy(key)
    before = series.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        key, "_cell",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"),
        F.sum("_c").over(series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"),
    )
    inside = Window.partitionBy(key, "_cell").orderBy(ts)
    return (
        rows.withColumn("_r", F.row_number().over(inside))
        .join(offsets, [key, "_cell"])
        .withColumn("_idx", F.col("_offset") + F.col("_r") - 1)
        .drop("_cell", "_r", "_offset")
    )


def _spread(df, position, size, before, after):
    """Copy each row to its own block and to the neighbours whose halo it is in."""
    if max(before, after) > size:
        raise ValueError(f"a halo of {max(before, after)} does not fit blocks of {size}")
    own = F.floor(position / F.lit(size))
    offset = F.pmod(position, F.lit(size))
    blocks = [own]
    if before:
        blocks.append(F.when(offset >= size - before, own + 1))
    if after:
        blocks.append(F.when(offset < after, own - 1))
    if len(blocks) == 1:
        return df.withColumn("_own", own).withColumn("_block", F.col("_own"))
    return df.withColumn("_own", own).withColumn(
        "_block", F.explode(F.array_compact(F.array(*blocks)))
    )


class RowFrames:
    """Frames that count rows, as positional shifts and rolling windows do."""

    def __init__(self, key=KEY, ts=TS):
        self.window = Window.partitionBy(key, "_block").orderBy("_idx")

    def shift(self, column, n):
        return F.lag(column, n).over(self.window) if n >= 0 else F.lead(column, -n).over(self.window)

    def last(self, n):
        return self.window.rowsBetween(-(n - 1), 0)


class TimeFrames:
    """Frames that count hours; a missing hour is a missing value."""

    def __init__(self, key=KEY, ts=TS):
        self.window = Window.partitionBy(key, "_block").orderBy("_seconds")

    def shift(self, column, n):
        return F.max(column).over(self.window.rangeBetween(-n * HOUR, -n * HOUR))

    def last(self, n):
        return self.window.rangeBetween(-(n - 1) * HOUR, 0)


def rolling(frames, aggregate, column, n):
    """An aggregate over n values, null until all n are present."""
    over = frames.last(n)
    return F.when(F.count(column).over(over) == n, aggregate(column).over(over))


def row_blocks(df, before=0, after=0, key=KEY, ts=TS, block=None):
    """Numbered rows dealt to blocks with their halo: ``_idx``, ``_block``, and ``_own``, the block a row belongs to."""
    indexed = df if "_idx" in df.columns else row_index(df, key, ts)
    return _spread(indexed, F.col("_idx"), max(block or BLOCK_ROWS, before, after), before, after)


def with_frames(df, build, before=0, after=0, mode="row", key=KEY, ts=TS, block=None, keep=()):
    """Add the columns ``build(frames)`` returns, computed block by block.

    ``before`` and ``after`` say how many rows (or hours) the frames reach back
    and ahead. ``keep`` names helper columns (``_idx``, ``_n``) to leave in place.
    """
    if mode == "row":
        spread = row_blocks(df, before, after, key, ts, block)
        frames = RowFrames(key, ts)
    elif mode == "time":
        size = max(block or BLOCK_HOURS, before, after)
        timed = df.withColumn("_seconds", F.unix_seconds(F.col(ts)))
        spread = _spread(timed, F.col("_seconds"), size * HOUR, before * HOUR, after * HOUR)
        frames = TimeFrames(key, ts)
    else:
        raise ValueError(f"mode is 'row' or 'time', not {mode!r}")
    kept = [c for c in df.columns if c not in INDEX or c in keep]
    kept += [c for c in keep if c not in kept]
    added = build(frames)
    computed = spread.select("*", *[column.alias(name) for name, column in added.items()])
    return computed.where("_block = _own").select(*kept, *[n for n in added if n not in kept])
