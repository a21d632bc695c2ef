import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolith import session
from aerolith.operators import series
from aerolith.streaming import streams
from tests.conftest import SMALL


@pytest.fixture()
def feed(spark, hourly):
    """A folder that receives deliveries, read as a stream."""
    path = session.scratch(spark, "feed")

    def deliver(df):
        df.coalesce(1).write.mode("append").parquet(path)
        return streams.read(spark, path, df.schema)

    return deliver


def test_dedup_across_deliveries(spark, feed, hourly):
    where, checkpoint = session.scratch(spark, "out"), session.scratch(spark, "checkpoint")
    for batch in (hourly(range(10)), hourly(range(12), skip=range(5))):
        streams.run(streams.dedup(feed(batch), lateness=48), "dedup", path=where, checkpoint=checkpoint)
    got = spark.read.parquet(where)
    assert got.count() == 12 == got.select("ts").distinct().count()


def test_late_rows_are_counted(spark, feed, hourly):
    where, checkpoint = session.scratch(spark, "out"), session.scratch(spark, "checkpoint")
    _, first = streams.run(streams.tumbling(feed(hourly(range(24 * 3))), "us_aqi"), "w", path=where, checkpoint=checkpoint)
    late = feed(hourly([1.0, 2.0]))
    _, second = streams.run(streams.tumbling(late, "us_aqi"), "w", path=where, checkpoint=checkpoint)
    assert streams.late_rows(first) == 0 and streams.late_rows(second) == 2


def test_lags_across_deliveries_equal_the_batch(spark, feed, hourly):
    """Deliveries that split the series give the lags of the whole series."""
    where, checkpoint = session.scratch(spark, "out"), session.scratch(spark, "checkpoint")
    offsets = {"l1": 1, "l24": 24}
    for batch in (hourly(range(30)), hourly(range(30, 60), start="2024-01-02 06:00:00"), hourly([0] * 10, start="2024-01-20")):
        streams.run(streams.shifted(feed(batch), "us_aqi", offsets), "lags", path=where, checkpoint=checkpoint)
    rows = {r.ts: r for r in spark.read.parquet(where).where("ts < timestamp'2024-01-04'").collect()}
    assert len(rows) == 60
    values = [rows[t] for t in sorted(rows)]
    assert [r.l1 for r in values] == [None] + [float(i) for i in range(59)]
    assert [r.l24 for r in values] == [None] * 24 + [float(i) for i in range(36)]


def test_targets_wait_for_their_hour(spark, feed, hourly):
    got = streams.result(streams.shifted(feed(hourly(range(100))), "us_aqi", {"ahead": -24}), "targets")
    rows = got.orderBy("ts").collect()
    assert rows and all(r.ahead == r.us_aqi + 24 for r in rows)


def test_ingest_twice_is_ingest_once(spark, feed, hourly):
    path = session.scratch(spark, "table")
    source = feed(hourly(range(40)))
    for _ in range(2):
        streams.ingest(source, path)
    assert spark.read.parquet(path).count() == 40


def scrambled(spark, sf_dir, parts=4):
    """The events of a scale as a folder of part files in scrambled order."""
    folder = session.scratch(spark, "scrambled")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in range(parts):
        events.where(f"pmod(xxhash64(event_id), {parts}) = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["stream_ingest", "stream_dedup", "stream_tumbling", "stream_sliding"])
def test_streams_read_a_folder_of_files(spark, name):
    from aerolith.plans import QUERIES

    one = QUERIES[name](spark, SMALL)
    many = QUERIES[name](spark, scrambled(spark, SMALL))
    assert one.count() > 0
    assert many.select(*one.columns).exceptAll(one).count() == 0 == one.exceptAll(many.select(*one.columns)).count()


def test_a_stream_without_files_fails(spark):
    empty = session.scratch(spark, "empty")
    spark.range(0).write.parquet(empty)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|no file"):
        streams.read(spark, empty + "-missing", spark.range(0).schema)


def test_late_first_rows_are_stored_and_listed(spark, feed, hourly):
    path, late, checkpoint = (session.scratch(spark, n) for n in ("table", "late", "checkpoint"))
    for batch in (hourly(range(10, 20), start="2024-01-02"), hourly(range(10)), hourly(range(10))):
        streams.dedup_into(feed(batch), path, late, checkpoint=checkpoint)
    assert spark.read.parquet(path).count() == 20
    assert spark.read.option("basePath", late).parquet(late).count() == 10


def test_open_windows_are_published_over_several_batches(spark, feed, hourly):
    checkpoint = session.scratch(spark, "checkpoint")
    for batch in (hourly(range(5)), hourly(range(5), station="b")):
        source = feed(batch)
    got = streams.published(streams.tumbling(source, "us_aqi"), "w", ["station", "window_start", "window_end"], checkpoint)
    assert got.count() == 10


def test_rolling_means_over_scrambled_deliveries_equal_the_batch(spark, feed, hourly):
    """Twenty days with gaps come in five deliveries, hours in no order, some twice; blocks and their halos meet."""
    whole = hourly([float((i * 37) % 101) for i in range(480)], skip={5, 100, 101, 300, 330}).unionByName(
        hourly([float(i) for i in range(60)], station="b"))
    checkpoint, path = session.scratch(spark, "checkpoint"), session.scratch(spark, "rolling")
    windows = {"m3": 3, "m72": 72}
    versions = []
    for k in (3, 0, 4, 1, 2, 1):
        source = feed(whole.where(f"pmod(xxhash64(station, ts), 5) = {k}"))
        versions.append(streams.published(streams.rolling(source, "us_aqi", windows, lateness=24 * 60), "rolling", ["station", "ts"], checkpoint).collect())
    got = {}
    for rows in versions:
        got.update({(r.station, r.ts): (r.us_aqi, r.m3, r.m72) for r in rows})
    batch = series.with_frames(
        whole, lambda f: {n: series.rolling(f, F.avg, "us_aqi", k) for n, k in windows.items()}, before=71, mode="time").collect()
    assert len(got) == len(batch) == 535
    for r in batch:
        value, m3, m72 = got[r.station, r.ts]
        assert value == r.us_aqi
        assert (m3 is None or m3 != m3) if r.m3 is None else m3 == pytest.approx(r.m3)
        assert (m72 is None or m72 != m72) if r.m72 is None else m72 == pytest.approx(r.m72)


def test_rolling_state_ends_with_its_block(spark, feed, hourly):
    checkpoint = session.scratch(spark, "checkpoint")
    for start, n in (("2024-01-01", 400), ("2024-03-01", 5), ("2024-03-02", 5)):
        source = feed(hourly([1.0] * n, start=start))
        _, query = streams.run(streams.rolling(source, "us_aqi", {"m24": 24}), "rolling", "update", checkpoint=checkpoint)
    assert 0 < streams.state_rows(query)[-1] < 40


def test_labels_come_when_their_hour_is_observed(spark, feed, hourly):
    """Rows and observations in deliveries of their own; the state holds three days and not the whole past."""
    out, checkpoint = session.scratch(spark, "labels"), session.scratch(spark, "checkpoint")
    sizes, days = [], 40
    for first in range(0, days, 10):
        part = hourly([float(i) for i in range(24 * first, 24 * (first + 10))], start=str(pd.Timestamp("2024-01-01") + pd.Timedelta(days=first)))
        joined = streams.labels(feed(part), feed(part), {"day1": 24, "day3": 72})
        _, query = streams.run(joined, "labels", path=out, checkpoint=checkpoint)
        sizes.append(streams.state_rows(query)[-1])
    got = {(r.ts, r.horizon): r.label for r in spark.read.parquet(out).collect()}
    hours = 24 * days
    assert len(got) == (hours - 24) + (hours - 72)
    start = pd.Timestamp("2024-01-01")
    assert all(label == (pd.Timestamp(ts) - start).total_seconds() / 3600 + {"day1": 24, "day3": 72}[horizon] for (ts, horizon), label in got.items())
    assert max(sizes[1:]) <= 1.2 * sizes[1] and sizes[-1] < 24 * 25
