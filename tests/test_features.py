import datetime as dt

import pytest
from pyspark.sql import functions as F

from aerolith.operators import features, series
from aerolith.operators.features import HORIZONS, change, lag, mean, spread, total
from aerolith.sources import tables
from tests.conftest import SMALL, column


def test_a_rolling_mean_needs_all_its_values(hourly):
    got = column(features.add(hourly(range(30)), [mean("us_aqi", 24)]), "us_aqi_rolling_mean_24h")
    assert got[:23] == [None] * 23
    assert got[23:] == [sum(range(i - 23, i + 1)) / 24 for i in range(23, 30)]


def test_a_null_empties_every_window_over_it(hourly):
    values = [1.0] * 40
    values[10] = None
    got = column(features.add(hourly(values), [mean("us_aqi", 24)]), "us_aqi_rolling_mean_24h")
    assert all(v is None for v in got[10:34]) and got[34] == 1.0


def test_a_missing_hour_is_skipped_by_rows_and_null_by_time(hourly):
    gap = hourly(range(5), skip=(2,))
    assert column(features.add(gap, [lag("us_aqi", 1)]), "us_aqi_lag_1h") == [None, 0.0, 1.0, 3.0]
    assert column(features.add(gap, [lag("us_aqi", 1)], mode="time"), "us_aqi_lag_1h") == [None, 0.0, None, 3.0]


def test_the_last_hours_have_no_target(hourly):
    got = column(features.targets(hourly(range(100))), "aqi_day3")
    assert got[:28] == [float(i + 72) for i in range(28)] and got[28:] == [None] * 72


@pytest.mark.parametrize("mode", ["row", "time"])
def test_blocks_do_not_change_results(hourly, mode):
    wanted = [lag("us_aqi", 7), mean("us_aqi", 5), total("us_aqi", 6), spread("us_aqi", 4), change("d", "us_aqi")]
    data = hourly([(i * 37) % 101 for i in range(300)], skip=(40, 41, 200))
    whole = features.add(data, wanted, HORIZONS, mode=mode, block=100_000)
    split = features.add(data, wanted, HORIZONS, mode=mode, block=72)
    assert whole.orderBy("ts").collect() == split.orderBy("ts").collect()


def test_row_numbers_are_exact_over_cells(hourly):
    data = hourly(range(200), skip=(3, 90))
    got = series.row_index(data, cell_hours=10).orderBy("ts").collect()
    assert [r._idx for r in got] == list(range(198)) and {r._n for r in got} == {198}


def test_features_do_not_look_ahead(hourly):
    base = [float((i * 13) % 50) for i in range(150)]
    changed = base[:120] + [v + 1000 for v in base[120:]]
    wanted = [lag("us_aqi", k) for k in (1, 24, 96)] + [mean("us_aqi", 72), change("d", "us_aqi")]
    first, second = (features.add(hourly(v), wanted).orderBy("ts").collect()[:120] for v in (base, changed))
    assert first == second


def test_stations_do_not_mix(hourly):
    one = hourly(range(120))
    both = one.unionByName(hourly([v * 7 for v in range(90)], station="b"))
    wanted = [lag("us_aqi", 24), mean("us_aqi", 12)]
    alone = features.add(one, wanted, HORIZONS).orderBy("ts").collect()
    assert features.add(both, wanted, HORIZONS).where("station = 'a'").orderBy("ts").collect() == alone


def test_calendar_starts_the_week_on_monday(hourly):
    row = features.calendar(hourly([1])).first()  # 2024-01-01 is a Monday
    assert row.day_sin == 0.0 and row.day_cos == 1.0 and row.hour_cos == 1.0


def test_feature_list_is_complete(spark):
    built = features.build(tables.observations(spark, SMALL), HORIZONS)
    assert len(features.FEATURE_COLUMNS) == 57
    assert built.columns == ["station", "ts", *features.FEATURE_COLUMNS, *HORIZONS]
    assert features.feature_names(built) == features.FEATURE_COLUMNS


def test_ensure_leaves_present_columns(hourly):
    data = hourly(range(5)).withColumn("us_aqi_lag_1h", F.lit(-1.0))
    got = features.ensure(data, ["us_aqi_lag_1h", "us_aqi_lag_2h", "pm2_5_change_rate_1h"])
    assert got.columns == ["station", "ts", "us_aqi", "us_aqi_lag_1h", "us_aqi_lag_2h"]
    assert column(got, "us_aqi_lag_1h") == [-1.0] * 5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_runs_in_one_task(spark):
    text = plan(features.build(tables.observations(spark, SMALL), HORIZONS))
    assert "SinglePartition" not in text


def test_all_frames_share_one_exchange(spark):
    """After the numbering, lags, rolling windows and targets need one shuffle by block."""
    text = plan(features.build(tables.observations(spark, SMALL), HORIZONS))
    assert sum("hashpartitioning" in line and "_block" in line for line in text.splitlines()) == 1


def test_time_mode_shuffles_once(hourly):
    text = plan(features.add(hourly(range(10)), [lag("us_aqi", 1), mean("us_aqi", 24)], HORIZONS, mode="time"))
    assert sum("Exchange hashpartitioning" in line for line in text.splitlines()) == 1


def test_only_needed_columns_are_read(spark):
    text = plan(tables.series(spark, SMALL).select("station", "ts", "us_aqi"))
    schema = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "props" not in schema and "user_id" not in schema


def test_halo_larger_than_block_is_widened(hourly):
    got = column(features.add(hourly(range(60)), [lag("us_aqi", 24)], block=4), "us_aqi_lag_24h")
    assert got == [None] * 24 + [float(i) for i in range(36)]


def test_timestamps_are_utc(hourly):
    assert hourly([1]).first().ts.replace(tzinfo=None) == dt.datetime(2024, 1, 1)
