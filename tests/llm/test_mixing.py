import itertools

import pytest
from pyspark.sql import functions as F

from aerolith.llm import mixing

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, tokens int, ratio string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0, 1, "r") for i, t, lang, source in rows], SHAPE).repartition(4)


def corpus():
    rows = []
    for i, (lang, source, n) in enumerate(itertools.product(["en", "fr", None], ["a", "b", "c", ""], [5, 150, 1200])):
        rows += [(i * 100 + k, "w " * n, lang, source) for k in range(3 + 9 * (source == "a"))]
    return rows


def test_marginals_reach_their_targets(spark):
    measured = mixing.measure(docs(spark, corpus()))
    targets = {"mix_source": {"a": 0.1, "b": 0.4, "c": 0.4, "": 0.1}, "mix_lang": 0.5, "mix_topic": 0.7}
    cells = mixing.rake(measured, targets, rounds=20).toPandas()
    mass = cells.tokens * cells.ratio
    for dim, wanted in targets.items():
        if not isinstance(wanted, dict):
            before = cells.groupby(dim).tokens.sum() ** wanted
            wanted = (before / before.sum()).to_dict()
        got = mass.groupby(cells[dim]).sum() / mass.sum()
        assert {k: pytest.approx(v, rel=1e-6) for k, v in wanted.items()} == got.to_dict()
    assert cells.probability.max() == 1.0 and (cells.probability >= 0).all()


def test_fit_equals_plain_loops(spark):
    measured = mixing.measure(docs(spark, corpus()))
    got = {tuple(r[d] for d in mixing.DIMS): r["ratio"] for r in mixing.rake(measured, dict.fromkeys(mixing.DIMS, 0.7)).collect()}
    cells = {tuple(r[d] for d in mixing.DIMS): r["t"]
             for r in measured.groupBy(*mixing.DIMS).agg(F.sum("mix_tokens").alias("t")).collect()}
    ratio, total = dict.fromkeys(cells, 1.0), sum(cells.values())
    goals = []
    for k in range(3):
        shares = {}
        for cell, t in cells.items():
            shares[cell[k]] = shares.get(cell[k], 0) + t
        shares = {v: s ** 0.7 for v, s in shares.items()}
        goals.append({v: s / sum(shares.values()) for v, s in shares.items()})
    for _ in range(mixing.ROUNDS):
        for k in range(3):
            now = {}
            for cell, t in cells.items():
                now[cell[k]] = now.get(cell[k], 0) + t * ratio[cell]
            ratio = {c: r * goals[k][c[k]] * total / now[c[k]] for c, r in ratio.items()}
    assert got == {c: pytest.approx(r, rel=1e-9) for c, r in ratio.items()}


def test_sample_keeps_columns_and_odd_rows(spark):
    odd = [(None, None, None, None), (1, "", "", ""), (1, "", "", ""), (2, "x " * 50_000, "de", None)]
    given = docs(spark, odd + corpus())
    drawn = mixing.sample(given, (0.7, 0.7, 0.7))
    assert drawn.columns == given.columns
    measured = mixing.measure(given)
    cells = mixing.rake(measured, dict.fromkeys(mixing.DIMS, 0.7))
    everything = mixing.draw(measured, cells, mixing.DIMS)
    assert everything.count() == given.count()
    assert everything.where("mix_probability IS NULL OR mix_weight IS NULL").count() == 0
    assert drawn.count() == everything.where("mix_kept").count() > 0


def test_values_without_target_get_no_weight(spark):
    measured = mixing.measure(docs(spark, corpus()))
    cells = mixing.rake(measured, {"mix_source": {"b": 1.0}, "mix_lang": 1.0, "mix_topic": 1.0}, rounds=2)
    assert cells.where("mix_source <> 'b' AND probability > 0").count() == 0


def test_empty_table(spark):
    assert mixing.sample(docs(spark, []), (0.7, 0.7, 0.7)).count() == 0


def test_no_python_on_the_way(spark):
    measured = mixing.measure(docs(spark, corpus()))
    cells = mixing.rake(measured, dict.fromkeys(mixing.DIMS, 0.7))
    plan = mixing.draw(measured, cells, mixing.DIMS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_tiny_cell_does_not_shrink_the_sample(spark):
    """One short document of its own source beside many; the rest is still drawn, the tiny cell repeated."""
    many = [(i, "w " * 200, "en" if i % 3 else "fr", "ab"[i % 2]) for i in range(3000)]
    given = docs(spark, [*many, (9999, "w", "en", "odd")])
    drawn = [r["doc_id"] for r in mixing.sample(given, (0.7, 0.7, 0.7)).select("doc_id").collect()]
    assert 9999 in drawn and abs(len(drawn) / len(many) - mixing.SHARE) < 0.05
    cells = mixing.rake(mixing.measure(given), dict.fromkeys(mixing.DIMS, 0.7)).toPandas()
    assert (cells.tokens * cells.probability).sum() == pytest.approx(mixing.SHARE * cells.tokens.sum(), rel=1e-6)
    tiny = cells[cells.mix_source == "odd"]
    assert tiny.probability.item() == 1.0 and tiny.repeats.item() > 1
    mass, drawn = cells.tokens * cells.ratio, cells.tokens * cells.probability * cells.repeats
    assert (drawn / drawn.sum()).tolist() == pytest.approx((mass / mass.sum()).tolist())


def test_production_rounds_reach_the_targets(spark):
    """Nearly nested cells settle slowly; the fit goes on until every marginal has its share."""
    rows = [(i, "w " * (5 if i % 2 else 150), lang, source) for i, (source, lang) in enumerate(
        [("a", "en")] * 60 + [("b", "fr")] * 30 + [("c", "de")] * 20 + [("a", "fr")] * 10 + [("b", "de")] * 10 + [("c", "en")] * 10)]
    wanted = {"mix_source": {"a": 0.3, "b": 0.4, "c": 0.3}, "mix_lang": {"en": 0.35, "fr": 0.3, "de": 0.35}, "mix_topic": 0.7}
    cells = mixing.rake(mixing.measure(docs(spark, rows)), wanted).toPandas()
    mass = cells.tokens * cells.ratio
    for dim in ("mix_source", "mix_lang"):
        got = (mass.groupby(cells[dim]).sum() / mass.sum()).to_dict()
        assert got == {k: pytest.approx(v, rel=1e-5) for k, v in wanted[dim].items()}
