import pytest
from pyspark.sql import functions as F

from aerolith import session
from aerolith.sources import forecasts, landing, outputs, store


def test_replaying_a_batch_changes_nothing(spark, hourly):
    path = session.scratch(spark, "replay")
    for _ in range(2):
        store.append(spark, hourly(range(30)), path)
        store.append(spark, hourly(range(50), skip=range(10)), path)
    got = spark.read.parquet(path)
    assert got.count() == 50 and got.select("station", "ts").distinct().count() == 50


def test_ignore_keeps_and_latest_replaces(spark, hourly):
    keep, replace = session.scratch(spark, "keep"), session.scratch(spark, "replace")
    for path, mode in ((keep, "ignore"), (replace, "latest")):
        store.create(hourly([1] * 48), path)
        store.append(spark, hourly([2] * 24, start="2024-01-02"), path, mode)
    assert spark.read.parquet(keep).agg(F.sum("us_aqi")).first()[0] == 48
    assert spark.read.parquet(replace).agg(F.sum("us_aqi")).first()[0] == 24 + 48


def test_an_observation_supersedes_a_forecast_but_not_the_reverse(spark, hourly):
    path = session.scratch(spark, "forecast")
    seen = hourly([5.0]).withColumn("is_forecast", F.lit(False))
    guess = hourly([9.0]).withColumn("is_forecast", F.lit(True))
    for batch in (guess, seen, guess):
        store.append(spark, batch, path, "latest")
    row = spark.read.parquet(path).first()
    assert row.us_aqi == 5.0 and not row.is_forecast


def test_late_labels_fill_a_stored_target(spark, hourly):
    path = session.scratch(spark, "labels")
    rows = hourly([1.0, 2.0])
    store.append(spark, rows.withColumn("aqi_day1", F.lit(None).cast("double")), path)
    store.append(spark, rows.withColumn("aqi_day1", F.lit(7.0)), path, "latest")
    assert {r.aqi_day1 for r in spark.read.parquet(path).collect()} == {7.0}


def test_duplicate_keys_in_one_batch_follow_the_order(spark, hourly):
    path = session.scratch(spark, "duplicates")
    both = hourly([1.0]).withColumn("version", F.lit(1)).unionByName(hourly([2.0]).withColumn("version", F.lit(2)))
    store.append(spark, both, path, "latest", order=["version"])
    assert [r.us_aqi for r in spark.read.parquet(path).collect()] == [2.0]


def test_reading_a_range_prunes_days(spark, hourly):
    path = session.scratch(spark, "range")
    store.create(hourly(range(24 * 5)), path)
    rows = store.read(spark, path, "2024-01-02 06:00:00", "2024-01-03 05:00:00")
    assert rows.count() == 24
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in text and "PushedFilters: [IsNotNull(ts)" in text


def test_empty_table_is_an_error(spark, hourly):
    with pytest.raises(RuntimeError):
        store.require_rows(hourly([1]).where("us_aqi > 5"), "features")


def test_projection_has_the_table_types(hourly):
    got = store.project(hourly([1]).withColumn("comment", F.lit("x")).withColumn("rain", F.lit(1)))
    assert got.columns == ["station", "ts", "rain", "us_aqi"] and dict(got.dtypes)["rain"] == "double"


def test_response_round_trip(hourly):
    data = hourly(range(30), skip=(5,))
    back = landing.explode_hourly(landing.pack_hourly(data, ["us_aqi"]), ["us_aqi"])
    assert back.count() == 48 and back.where("us_aqi is not null").count() == 29


def test_latest_pollutant_falls_back_to_the_newest_known(hourly, spark):
    data = hourly([1.04, 2.25, None]).withColumns({
        "pm2_5": F.col("us_aqi"), "pm10": F.col("us_aqi"), "nitrogen_dioxide": F.lit(None).cast("double"),
        "ozone": F.lit(4.0)})
    row = outputs.latest_pollutants(data).first()
    assert row.pm2_5 == 2.2 and row.nitrogen_dioxide is None and row.ozone == 4.0
    state = {r.pollutant: r for r in outputs.against_limits(outputs.latest_pollutants(data)).collect()}
    assert state["NO2"].status is None and state["O3"].percent_of_limit == 5


def _issued(spark, hourly, values, **more):
    return forecasts.lead_forecasts(hourly(values, **more), {"day1": 24, "day3": 72}, {"same": "us_aqi"})


def test_forecasts_wait_for_their_truth(spark, hourly):
    """Observations in any order, twice, and before a forecast is published: one match a forecast, replays change nothing."""
    path, truth = session.scratch(spark, "forecasts"), session.scratch(spark, "truth")
    seen = hourly(range(200), skip={150})
    forecasts.mature(spark, seen, path, truth)  # nothing is published yet
    forecasts.publish(spark, _issued(spark, hourly, range(60)), path)
    forecasts.publish(spark, _issued(spark, hourly, [9.0] * 100), path)  # hours 0 to 59 stay as they were issued
    late, early = seen.where("hour(ts) >= 12"), seen.where("hour(ts) < 12")
    counts = []
    for delivery in (late, early, late, early):
        forecasts.mature(spark, delivery, path, truth)
        counts.append(spark.read.parquet(truth).count())
    assert counts[1] == counts[3] == 200 - 1 and counts[2] == counts[1] > counts[0]  # hour 150 is ahead of one forecast
    rows = spark.read.parquet(truth).collect()
    start = min(r.issued for r in rows)
    for r in rows:
        hour = (r.issued - start).total_seconds() / 3600
        assert r.prediction == (hour if hour < 60 else 9.0) and r.truth == hour + {"day1": 24, "day3": 72}[r.horizon]
        assert (r.valid - r.issued).total_seconds() == {"day1": 24, "day3": 72}[r.horizon] * 3600
    found = {r.horizon: r for r in forecasts.scores(spark, path, truth).collect()}
    assert found["day1"].issued == 100 and found["day1"].n + found["day1"].pending == 100


def test_a_corrected_observation_revises_its_matches(spark, hourly):
    path, truth = session.scratch(spark, "forecasts"), session.scratch(spark, "truth")
    forecasts.publish(spark, _issued(spark, hourly, range(10)), path)
    forecasts.mature(spark, hourly(range(100)), path, truth)
    corrected = hourly([500.0], start="2024-01-02 03:00:00")
    forecasts.mature(spark, corrected, path, truth)
    assert spark.read.parquet(truth).where("truth = 500").count() == 0
    forecasts.mature(spark, corrected, path, truth, revise=True)
    got = spark.read.parquet(truth)
    assert got.where("truth = 500").count() == 1 and got.count() == 20


def test_landed_lines_are_read_and_broken_ones_put_aside(spark):
    good = '{"station": "a", "city": "X", "start": 0, "end": 7200, "step": 3600, "hourly": {"rain": [1, null], "dust": [2.5, 3]}}'
    lines = [good, good[:40], "", "[]", '{"station": "a"}', good.replace("7200", "3600"), good.replace("2.5, 3", "2.5"), good.replace('"dust"', '"other"'),
             good.replace('"a"', "null")]
    path = session.scratch(spark, "responses")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    responses, broken = landing.read_responses(spark, path, ["rain", "dust"])
    rows = landing.explode_hourly(responses, ["rain", "dust"]).orderBy("ts").collect()
    assert [(r.station, r.city, r.rain, r.dust) for r in rows] == [("a", "X", 1.0, 2.5), ("a", "X", None, 3.0)]
    told = sorted((r.reason, r.value) for r in broken.collect())
    assert len(told) == len(lines) - 1 and {r for r, _ in told} == {
        "empty", "not readable", "no key or times", "field missing", "arrays of another length"}
