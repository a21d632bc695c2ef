import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.functions import columns as C
from aerolith.functions import quantiles as Q
from aerolith.operators import analogues, audits, correlation, metrics, scaling, splits
from tests.conftest import column


def test_band_edges_belong_to_the_lower_band(spark):
    values = [0.0, 50.0, 50.1, 100.0, 150.0, 200.0, 300.0, 300.1, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    labels = [r[0] for r in df.select(C.aqi_band(F.col("v"))).collect()]
    numbers = [r[0] for r in df.select(C.band_number(F.col("v"))).collect()]
    assert numbers == [1, 1, 2, 2, 3, 4, 5, 6, None]
    assert labels[1] == "Good (0-50)" and labels[7] == "Hazardous (301+)" and labels[8] is None


def test_percent_of_limit_is_cut(spark):
    row = spark.range(1).select(C.limit_percent(F.lit(232.8), F.lit(35)).alias("p"),
                                C.limit_status(F.lit(76.5), F.lit(53)).alias("s")).first()
    assert row.p == 665 and row.s == "Unhealthy"


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,)], "v double")
    assert C.clean(df, ["v"]).agg(F.avg("v")).first()[0] == 2.0


def test_half_even_rounding(spark):
    row = spark.range(1).select(F.bround(F.lit(2.5), 0), F.bround(F.lit(3.5), 0)).first()
    assert tuple(row) == (2.0, 4.0)


def test_clock_and_title(spark):
    row = spark.sql("select timestamp'2024-01-01 00:10:00' a, timestamp'2024-01-01 13:00:00' b").select(
        C.clock_label("a"), C.clock_label("b"), C.title_name(F.lit("us_aqi_lag_96h"))).first()
    assert tuple(row) == ("12 AM", "1 PM", "Us Aqi Lag 96H")


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, float(i)) for i in range(5)], "station string, x double, y double")
    assert correlation.pair(df, "x", "y").first().corr is None


def test_correlation_uses_complete_pairs(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 3.0, 5.0), ("a", 100.0, None), ("a", None, -50.0)]
    df = spark.createDataFrame(rows, "station string, x double, y double")
    expected = np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1]
    assert correlation.pair(df, "x", "y").first().corr == pytest.approx(expected)


def test_small_group_quantiles_match_numpy(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 10.0)], "g string, v double")
    got = {r.prob: r.value for r in Q.quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.25: 1.75, 0.5: 2.5, 1.0: 10.0}


def test_quantiles_of_large_groups_are_exact(spark):
    """One group holds most rows and many ties."""
    draw = np.random.default_rng(1)
    hot = np.round(draw.exponential(50.0, 60_000), 1)
    cold = draw.normal(0.0, 1.0, 25_000)
    import pandas as pd
    frame = pd.DataFrame({"g": ["hot"] * len(hot) + ["cold"] * len(cold), "v": np.concatenate([hot, cold])})
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r.g, r.prob): r.value for r in Q.quantiles(spark.createDataFrame(frame), ["g"], "v", probs).collect()}
    for name, values in (("hot", hot), ("cold", cold)):
        assert [got[name, p] for p in probs] == pytest.approx(list(np.quantile(values, probs)))


def test_ordered_bits_keep_order_and_values(spark):
    """Subnormal, tiny, huge and infinite values of both signs."""
    values = [float("-inf"), -1.7976931348623157e308, -3.5, -1.0, -2.2250738585072014e-308, -5e-324, 0.0, 5e-324, 1e-310, 2.2250738585072014e-308,
              0.1, 0.30000000000000004, 1.0, 1.0000000000000002, 2.0, 4503599627370497.0, 1.7976931348623157e308, float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("b", Q.ordered_bits(F.col("v")))
    rows = df.withColumn("back", Q.from_bits(F.col("b"))).orderBy("i").collect()
    assert [r.b for r in rows] == sorted({r.b for r in rows}) and [r.back for r in rows] == values
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "v double").select(Q.ordered_bits(F.col("v")).alias("b")).collect()
    assert zeros[0].b == zeros[1].b


def test_quantiles_of_several_columns_with_nulls_and_no_group(spark):
    rows = [(float(i), None if i % 3 else -float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, y double").withColumn("none", F.lit(None).cast("double"))
    got = {(r.feature, r.prob): r.value for r in Q.quantiles_of(df, [], ["x", "y", "none"], [0.5, 0.9]).collect()}
    y = [v for _, v in rows if v is not None]
    assert got == {("x", 0.5): 49.5, ("x", 0.9): pytest.approx(89.1), ("y", 0.5): np.quantile(y, 0.5), ("y", 0.9): pytest.approx(np.quantile(y, 0.9))}
    assert Q.quantiles(df.limit(0), [], "x", [0.5]).count() == 0


def test_scalers(spark):
    df = spark.createDataFrame([("a", v, 7.0) for v in (1.0, 2.0, 3.0, 10.0)], "station string, x double, flat double")
    standard = {r.feature: r for r in scaling.fit(df, ["x", "flat"]).collect()}
    robust = {r.feature: r for r in scaling.fit(df, ["x", "flat"], "robust").collect()}
    assert standard["x"].scale == pytest.approx(np.std([1, 2, 3, 10])) and standard["flat"].scale == 1.0
    assert robust["x"].centre == 2.5 and robust["x"].scale == pytest.approx(4.75 - 1.75)
    assert robust["flat"].scale == 1.0


def test_scaler_ignores_test_rows(hourly):
    rows = splits.chrono(hourly(range(100)))
    before = scaling.fit(rows.where("split = 'train'"), ["us_aqi"]).first()
    moved = rows.withColumn("us_aqi", F.when(F.col("split") == "test", 1e6).otherwise(F.col("us_aqi")))
    assert scaling.fit(moved.where("split = 'train'"), ["us_aqi"]).first() == before


def test_weights_average_one(hourly):
    data = hourly([100, 200, 50, 160] * 10).withColumn("aqi_day2", F.lit(10.0))
    weighted = splits.event_weight(splits.recency_weight(data), splits.smog())
    row = weighted.agg(F.avg("weight_recency"), F.avg("weight_event"), F.min("weight_event"), F.max("weight_event")).first()
    assert row[0] == pytest.approx(1.0) and row[1] == pytest.approx(1.0) and row[3] / row[2] == pytest.approx(2.5)


def test_embargo_keeps_targets_out_of_later_parts(hourly):
    rows = splits.embargoed(hourly(range(1000), skip=range(500, 520)), val_ratio=0.2)
    span = {r.split: r for r in rows.groupBy("split").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect()}
    hours = lambda later, earlier: (span[later].a - span[earlier].b).total_seconds() / 3600
    assert hours("validation", "train") > 72 and hours("test", "validation") > 72


def test_folds_follow_the_expanding_rule(hourly):
    rows = splits.folds(hourly(range(10)), 3, embargo_hours=0)
    count = {(r.fold, r.role): r["count"] for r in rows.groupBy("fold", "role").count().collect()}
    assert count == {(1, "train"): 4, (1, "test"): 2, (2, "train"): 6, (2, "test"): 2, (3, "train"): 8, (3, "test"): 2}


def test_folds_keep_targets_out_of_their_test_part(spark, hourly):
    """In every fold the last training row and the first test row are more than 72 hours apart."""
    data = hourly(range(1500), skip=range(700, 760)).unionByName(hourly(range(900), station="b", start="2024-02-01"))
    rows = splits.folds(data, 5)
    edges = rows.groupBy("station", "fold").agg(
        F.max(F.when(F.col("role") == "train", F.unix_seconds("ts"))).alias("a"),
        F.min(F.when(F.col("role") == "test", F.unix_seconds("ts"))).alias("b")).collect()
    assert len(edges) == 10 and all(e.b - e.a > 72 * 3600 for e in edges)
    numbered = splits.indexed(data)
    for fold in (1, 5):
        train, test = splits.one_fold(numbered, fold, 5)
        last, first = (part.groupBy("station").agg(f(F.unix_seconds("ts")).alias("t")) for part, f in ((train, F.max), (test, F.min)))
        gaps = [r.a - r.b for r in first.withColumnRenamed("t", "a").join(last.withColumnRenamed("t", "b"), "station").collect()]
        assert len(gaps) == 2 and min(gaps) > 72 * 3600


def test_all_splits_cut_at_the_same_row(hourly):
    data = hourly(range(1237))
    first = [part.where("split = 'test'").agg(F.min("ts")).first()[0]
             for part in (splits.chrono(data), splits.embargoed(data), splits.embargoed(data, val_ratio=0.15))]
    assert len(set(first)) == 1


def test_constant_truth_has_no_r2(spark):
    df = spark.createDataFrame([("h", 5.0, 4.0), ("h", 5.0, 6.0)], "horizon string, t double, p double")
    row = metrics.regression(df, "t", "p", ["horizon"]).first()
    assert row.r2 is None and row.rmse == 1.0 and row.mae == 1.0


def test_gate_needs_both_errors(spark):
    schema = "horizon string, rmse double, mae double, r2 double"
    base = spark.createDataFrame([("aqi_day1", 20.0, 10.0, 0.5)], schema)
    model = spark.createDataFrame([("aqi_day1", 19.0, 11.0, 0.9)], schema)
    row = metrics.compliance(metrics.gate(metrics.against(model, base, ["horizon"]))).first()
    assert row.beats_rmse and not row.beats_mae and row.status == "REJECTED"
    assert row.rmse_improvement_pct == pytest.approx(5.0)


def test_zero_baseline_has_no_improvement(spark):
    assert spark.range(1).select(C.improvement_pct(F.lit(0.0), F.lit(1.0))).first()[0] is None


def test_acf_and_pacf_match_a_direct_computation(hourly):
    draw = np.random.default_rng(3)
    x = [0.0]
    for e in draw.normal(size=399):
        x.append(0.8 * x[-1] + e)
    x = np.array(x)
    c = x - x.mean()
    rho = np.array([c[k:] @ c[:len(c) - k] / (c @ c) for k in range(0, 13)])
    data = hourly(list(x))
    got = {r.lag: r for r in correlation.acf(data, lags=12).collect()}
    assert [got[k].acf for k in range(1, 13)] == pytest.approx(list(rho[1:]))
    assert got[1].band == pytest.approx(1.959963984540054 / np.sqrt(400))
    partial = []
    for k in range(1, 13):
        toeplitz = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        partial.append(np.linalg.solve(toeplitz, rho[1:k + 1])[-1])
    found = {r.lag: r.pacf for r in correlation.pacf(data, lags=12).collect()}
    assert [found[k] for k in range(1, 13)] == pytest.approx(partial)


def test_gaps_and_missing_hours(hourly):
    data = hourly(range(10), skip=(3, 4, 7))
    assert sorted(r.gap_hours for r in audits.gaps(data).collect()) == [2.0, 3.0]
    assert sorted(r.ts.hour for r in audits.missing_hours(data).collect()) == [3, 4, 7]


def test_unknown_values_are_counted_apart(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 400.0), ("a", None)], "station string, v double")
    got = {r.category: r.hours for r in audits.bands(df, "v").collect()}
    assert got["Good (0-50)"] == 1 and got["Hazardous (301+)"] == 1 and got["Unknown"] == 1 and got["Moderate (51-100)"] == 0


def _weather(df):
    return df.withColumns({"wind_speed_10m": F.lit(4.0), "relative_humidity_2m": F.lit(70.1), "x": (F.col("us_aqi") - 4) * (F.col("us_aqi") - 4)})


def test_analogues_are_a_week_old_and_one_per_day(hourly):
    """Rows exactly 7 days old count, an hour younger does not."""
    values = [((i * 7) % 24) + (i % 5) for i in range(24 * 10)]
    data = _weather(hourly(values))
    found = analogues.top_days(data, ["us_aqi", "x"], k=20).collect()
    last = 24 * 10 - 1
    assert {r.date for r in found} == {"Jan 01, 2024", "Jan 02, 2024", "Jan 03, 2024"}
    assert (last - 7 * 24) // 24 == 2 and len(found) == 3 and found[0].humidity_high


def test_short_history_falls_back_to_all_but_the_newest(hourly):
    found = analogues.top_days(_weather(hourly([5, 1, 7, 5])), ["us_aqi", "x"]).collect()
    assert len(found) == 1 and found[0].historical_aqi == 5 and found[0].similarity == 100.0


def test_winner_and_override(spark):
    scores = spark.createDataFrame([("d1", "a", 3.0), ("d1", "b", 2.0)], "horizon string, model string, rmse double")
    row = metrics.select_winner(scores, override={"d1": "a"}).first()
    assert row.winner == "b" and row.chosen == "a" and row.overridden


def test_quantile_trend_merges_equal_edges(hourly):
    data = hourly([0] * 50 + list(range(1, 51))).withColumn("y", F.col("us_aqi") * 2)
    got = audits.quantile_trend(data, "us_aqi", "y", bins=4).orderBy("bin").collect()
    assert sum(r.hours for r in got) == 100 and got[0].mean_us_aqi == 0.0 and [r.bin for r in got] == [1, 2, 3][:len(got)]


def test_peak_ramp_offsets(hourly):
    got = column(audits.peak_ramp(hourly([1, 2, 3, 9, 4, 2, 1]), around=2), "offset")
    assert got == [-2, -1, 0, 1, 2]


def test_lagged_sums_do_not_depend_on_blocks(spark, hourly):
    """Blocks shorter and longer than the series; halos at every edge."""
    values = np.random.default_rng(3).normal(size=700)
    df = hourly(values).unionByName(hourly(values[:50] * 2, station="b"))
    whole = {}
    for block in (40, 130, 10_000):
        got = {(r.station, r.lag): r for r in correlation.acf(df, lags=30, block=block).collect()}
        whole[block] = got
        for station, x in (("a", values), ("b", values[:50] * 2)):
            x = x - x.mean()
            for lag in (1, 7, 30):
                assert got[station, lag].acf == pytest.approx((x[lag:] @ x[:-lag]) / (x @ x)) and got[station, lag].n == len(x)
    assert whole[40].keys() == whole[10_000].keys()


def test_acf_lays_out_no_row_per_lag(spark, hourly):
    plan = correlation.acf(hourly(range(500)))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(past" not in plan and "FlatMapGroupsInPandas" in plan
