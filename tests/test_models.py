import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolith import session
from aerolith.operators import correlation, explain, features, models, splits, walks
from aerolith.operators.features import lag, mean
from aerolith.operators.models import Config
from aerolith.plans import audits
from aerolith.plans import models as plans
from aerolith.sources import tables
from tests.conftest import SMALL

COLUMNS = ["us_aqi", "us_aqi_lag_12h", "us_aqi_rolling_mean_24h"]


def _table(spark, values, name):
    frame = pd.DataFrame({"h": np.arange(len(values)), "us_aqi": values})
    rows = spark.createDataFrame(frame).selectExpr(
        "'a' AS station", "timestamp'2024-01-01' + make_dt_interval(0, cast(h as int)) AS ts", "us_aqi")
    built = features.add(rows, [lag("us_aqi", 12), mean("us_aqi", 24)], features.HORIZONS)
    return session.store(splits.embargoed(features.complete(built), val_ratio=0.15), name)


@pytest.fixture(scope="module")
def signal(spark):
    """A 40-hour wave: a day ahead it is not where it was, but it is predictable."""
    t = np.arange(1500)
    noise = np.random.default_rng(0).normal(size=1500)
    return _table(spark, 100 + 30 * np.sin(2 * np.pi * t / 40) + noise, "signal")


@pytest.fixture(scope="module")
def noise(spark):
    return _table(spark, np.random.default_rng(5).normal(100, 10, 1500), "noise")


def _scores(df, config):
    got = models.train_all(df, COLUMNS, {"aqi_day1": config}, ["aqi_day1"])[1]
    return {r.model: r for r in got.where("split = 'test'").collect()}


@pytest.mark.parametrize("config", [
    Config("ridge", "standard"), Config("kernel", "robust", "weight_event", {"size": 64}),
    Config("boosted", "none", None, {"maxIter": 10, "stepSize": 0.3}), Config("forest", "none", None, {"numTrees": 10}),
])
def test_models_beat_persistence_on_a_signal(signal, config):
    scores = _scores(signal, config)
    assert scores[config.model].rmse < 0.5 * scores["persistence"].rmse


def test_noise_is_not_predictable(noise):
    """Nothing beats the mean on white noise; if it did, the future leaked."""
    assert _scores(noise, Config("ridge", "standard"))["ridge"].r2 < 0.05


def test_saved_pipeline_scores_alike(spark, signal):
    fitted = models.fit(signal.where("split = 'train'"), COLUMNS, "aqi_day2", Config("kernel", "robust", None, {"size": 32}))
    path = session.scratch(spark, "model")
    models.save(fitted, path)
    before = models.predict(fitted, signal).orderBy("ts").select("pred").collect()
    assert models.predict(models.load(path), signal).orderBy("ts").select("pred").collect() == before


def test_missing_inputs_withhold_the_score(signal):
    fitted = models.fit(signal.where("split = 'train'"), COLUMNS, "aqi_day1", Config("ridge"))
    holes = signal.limit(1).withColumn("us_aqi_lag_12h", F.lit(None).cast("double"))
    strict, lenient = models.score(holes, fitted, COLUMNS).first(), models.score(holes, fitted, COLUMNS, 1).first()
    assert strict.prediction is None and strict.status == "missing inputs" and strict.n_missing == 1
    assert lenient.prediction is not None


def test_prediction_floor_keeps_the_raw_value(signal):
    fitted = models.fit(signal.where("split = 'train'"), COLUMNS, "aqi_day1", Config("ridge"))
    row = models.score(signal.limit(1), fitted, COLUMNS, floor=1e6).first()
    assert row.prediction == 1e6 and row.raw_prediction < 1e6


@pytest.mark.parametrize("config", [
    Config("forest", "none", None, {"numTrees": 7}), Config("kernel", "robust", None, {"size": 16}),
    Config("boosted", "standard", None, {"maxIter": 3, "stepSize": 0.3}), Config("ridge", "standard")])
def test_compiled_pipelines_predict_alike(signal, config):
    fitted = models.fit(signal.where("split = 'train'"), COLUMNS, "aqi_day1", config)
    rows = models.predict(fitted, signal.where("split = 'test'")).collect()
    raw = np.array([[r[c] for c in COLUMNS] for r in rows], float)
    raw[0, 1] = np.nan  # a missing input is filled as in the pipeline
    got = walks.Compiled(fitted)(raw)
    assert np.allclose(got[1:], [r.pred for r in rows[1:]], rtol=1e-9)
    hole = models.predict(fitted, signal.where(F.col("ts") == F.lit(rows[0].ts)).withColumn(COLUMNS[1], F.lit(None).cast("double")))
    assert got[0] == pytest.approx(hole.first().pred)


@pytest.mark.parametrize("config", [Config("forest", "none", None, {"numTrees": 5}), Config("kernel", "standard", None, {"size": 16})])
def test_sampled_values_add_up_and_tend_to_the_exact_ones(signal, config):
    """Against all orders of three features and every one of 40 training rows."""
    train = signal.where("split = 'train'").orderBy("ts").limit(40)
    fitted = models.fit(signal.where("split = 'train'"), COLUMNS, "aqi_day1", config)
    few = signal.where("split = 'test'").orderBy("ts").limit(3)
    values = session.store(explain.shapley(fitted, few, COLUMNS, train, samples=2000), "shapley")
    sums = values.groupBy("ts").agg((F.sum("value") + F.max("base")).alias("total"))
    joined = models.predict(fitted, few).join(sums, "ts").collect()
    assert len(joined) == 3 and all(r.total == pytest.approx(r.pred) for r in joined)
    predict, size = walks.Compiled(fitted), len(COLUMNS)
    starts = np.array([[r[c] for c in COLUMNS] for r in train.collect()])
    for row in few.collect():
        x, exact = np.array([row[c] for c in COLUMNS]), np.zeros(size)
        for order in itertools.permutations(range(size)):
            state = starts.copy()
            before = predict(state)
            for j in order:
                state[:, j] = x[j]
                after = predict(state)
                exact[j] += (after - before).mean() / 6
                before = after
        got = {r.feature: r.value for r in values.where(F.col("ts") == F.lit(row.ts)).collect()}
        spread = predict(starts).std()
        assert all(abs(got[c] - e) < 0.15 * spread + 0.05 * abs(e) for c, e in zip(COLUMNS, exact))


def test_a_walk_starts_at_any_training_row(signal):
    rows = walks.Reference(signal.repartition(7), COLUMNS)
    numbers = sorted(r.number for r in rows.rows.collect())
    assert numbers == list(range(signal.count())) and rows.count == len(numbers)


def test_exact_values_of_a_linear_pipeline_add_up(signal):
    fitted = models.fit(signal.where("split = 'train'"), COLUMNS, "aqi_day1", Config("ridge", "robust"))
    few = signal.where("split = 'test'").limit(5)
    values = explain.shapley(fitted, few, COLUMNS)
    sums = values.groupBy("ts").agg((F.sum("value") + F.max("base")).alias("total"), F.count("*").alias("n"))
    joined = models.predict(fitted, few).join(sums, "ts").collect()
    assert len(joined) == 5 and all(r.total == pytest.approx(r.pred) and r.n == len(COLUMNS) for r in joined)


@pytest.mark.parametrize("kind", ["standard", "robust", "none"])
def test_a_missing_input_counts_as_the_training_median(signal, kind):
    train = signal.where("split = 'train'")
    fitted = models.fit(train, COLUMNS, "aqi_day1", Config("ridge", kind))
    median = train.approxQuantile("us_aqi_lag_12h", [0.5], 0.001)[0]
    holes = signal.limit(1).withColumn("us_aqi_lag_12h", F.lit(None).cast("double"))
    filled = signal.limit(1).withColumn("us_aqi_lag_12h", F.lit(median))
    assert models.predict(fitted, holes).first().pred == models.predict(fitted, filled).first().pred


def test_search_accepts_only_validated_gains(signal):
    table = signal.withColumn("random", F.rand(3))
    kept, trials = models.feature_search(table, ["us_aqi"], ["us_aqi_lag_12h", "random"], "aqi_day1")
    got = {r.feature: r for r in trials.collect()}
    assert got["us_aqi_lag_12h"].accepted and "us_aqi_lag_12h" in kept and len(got) == 2


@pytest.mark.parametrize("missing", ["validation", "training", "training and no validation"])
def test_a_search_without_rows_to_judge_by_lists_all_and_keeps_none(spark, missing):
    """Of 305 complete rows 45 validate, and the embargo of 72 hours before the test part takes them all."""
    table = _table(spark, np.random.default_rng(1).normal(100, 10, 1500 if missing == "training" else 400), "short")
    if missing != "validation":
        table = table.where("split <> 'train'")
    parts = {r.split for r in table.select("split").distinct().collect()}
    assert ("train" in parts, "validation" in parts) == ("training" not in missing, "validation" not in missing)
    with pytest.warns(UserWarning, match=f"no {missing} row"):
        kept, trials = models.feature_search(table, ["us_aqi"], ["us_aqi_lag_12h", "us_aqi_rolling_mean_24h"], "aqi_day1")
    assert kept == ["us_aqi"]
    assert [tuple(r) for r in trials.collect()] == [(c, None, None, None, None, False) for c in COLUMNS[1:]]


@pytest.mark.parametrize("scaler", ["standard", "none"])
def test_solved_trials_equal_separate_fits(signal, scaler):
    """Every trial of a search against a fitted pipeline; a constant column explains nothing in both."""
    table = session.store(signal.withColumn("flat", F.lit(3.0)).withColumn("square", F.col("us_aqi") * F.col("us_aqi")), "searched")
    config = Config("ridge", scaler)
    kept, trials = models.feature_search(table, ["us_aqi"], ["us_aqi_lag_12h", "flat", "square"], "aqi_day1", config)
    columns = ["us_aqi"]
    for r in trials.collect():
        fitted = models.fit(table.where("split = 'train'"), columns + [r.feature], "aqi_day1", config)
        held = models.predict(fitted, table.where("split = 'validation'")).selectExpr("avg(pow(aqi_day1 - pred, 2)) AS e").first().e
        assert r.rmse == pytest.approx(held ** 0.5, rel=1e-6)
        columns += [r.feature] * r.accepted
    assert kept == columns


@pytest.mark.parametrize("scaler", ["standard", "robust"])
def test_solved_folds_equal_refits(signal, scaler):
    rows = session.store(splits.indexed(signal.drop("split")), "numbered")
    config = Config("ridge", scaler)
    got = {r.fold: r.rmse for r in models.ridge_folds(rows, COLUMNS, "aqi_day2", config, 4).collect()}
    assert set(got) == {1, 2, 3, 4}
    for fold, rmse in got.items():
        train, test = splits.one_fold(rows, fold, 4)
        held = models.predict(models.fit(train, COLUMNS, "aqi_day2", config), test).selectExpr("avg(pow(aqi_day2 - pred, 2)) AS e").first().e
        assert rmse == pytest.approx(held ** 0.5, rel=1e-6)


def test_fold_parts_say_what_folds_says(hourly):
    rows = hourly(range(900)).unionByName(hourly(range(500), station="b"))
    wide = splits.fold_parts(rows, 3).collect()
    long = {(r.station, r.ts, r.fold): r.role for r in splits.folds(rows, 3).collect()}
    letters = {"train": "T", "test": "t", None: "-"}
    assert len(wide) == 1400
    assert all(r.parts == "".join(letters[long.get((r.station, r.ts, f))] for f in (1, 2, 3)) for r in wide)


def test_one_of_two_twins_stays(spark):
    candidates = spark.createDataFrame([("a",), ("b",), ("c",)], "feature string")
    partners = spark.createDataFrame([("a", "b"), ("b", "a")], "feature string, partner string")
    got = {r.feature: r.dropped for r in explain.prune(candidates, partners).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_all_correlated_pairs_are_listed_and_those_of_the_guard_marked(spark):
    seen = correlation.matrix(tables.observations(spark, SMALL), audits.MATRIX).collect()
    strong = [r for r in seen if abs(r["corr"] or 0) > 0.5]
    want = {(r.station, *pair, abs(r["corr"]) > 0.85) for r in strong for pair in ((r.column_a, r.column_b), (r.column_b, r.column_a))}
    got = plans.corr_partners(spark, SMALL).collect()
    assert len(got) == len(want) and {(r.station, r.feature, r.partner, r.alike) for r in got} == want
    assert 0 < sum(r.alike for r in got) < len(got)


def test_a_rule_without_variation_stays_open(spark):
    df = spark.createDataFrame([("s", 0.0, float(i), -2.0 * i) for i in range(4)],
                               "station string, rain double, wind double, effect double")
    got = {r.rule: r.status for r in explain.domain_rules(
        df, {"rain washes out": ("rain", "effect"), "wind disperses": ("wind", "effect")}).collect()}
    assert got == {"rain washes out": "NOT_EVALUABLE", "wind disperses": "PASS"}
