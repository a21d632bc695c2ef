"""The pipeline against plain versions of its stages on the smallest tables, and on odd rows."""

import hashlib

import pytest

import corpus_pipeline
from aerolith.llm import mixing, toxicity
from aerolith.session import scratch, store
from tests.conftest import SMALL
from tests.llm.test_simhash import jaccard, plain_classes


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "packing"]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}

    clean = store(stages["toxicity"](spark, docs, SMALL), "stage")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    ids = {i for i in text if lexicon.score(text[i]) < 0.5}
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(ids)

    single = store(stages["exact_dedup"](spark, clean, SMALL), "stage")
    ids = set({text[i]: i for i in sorted(ids)}.values())
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.collect()) == sorted(ids)

    apart = store(stages["simhash_dedup"](spark, single, SMALL), "stage")
    classes = plain_classes(ids, lambda a, b: jaccard(text[a], text[b]) >= 0.8)
    ids = set(classes.values())
    assert apart.columns == docs.columns and sorted(r["doc_id"] for r in apart.collect()) == sorted(ids)

    mixed = store(stages["mixing"](spark, apart, SMALL), "stage")
    cells = mixing.rake(mixing.measure(apart), dict(zip(mixing.DIMS, corpus_pipeline.TEMPER)))
    drawn = mixing.draw(mixing.measure(apart), cells, mixing.DIMS).collect()
    ids = {r["doc_id"] for r in drawn
           if int(hashlib.sha256(str(r["doc_id"]).encode()).hexdigest()[:13], 16) / 2 ** 52 < r["mix_probability"]}
    assert mixed.columns == docs.columns and sorted(r["doc_id"] for r in mixed.collect()) == sorted(ids)

    packed = stages["packing"](spark, mixed, SMALL).collect()
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {r["doc_id"]: r["doc_tokens"] for r in packed} and set(got) == ids
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in packed)


SHAPE = ("doc_id long, text string, lang string, source string, n_chars long, whole string, mix_tokens string, "
         "tox_score string, own string, key string")


@pytest.mark.parametrize("rows", [
    [], [(None, None, None, None, None)], [(1, "", "", "", 0)] * 3,
    [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, "a b c", None, "s", 5), (None, "word " * 20_000, "en", None, None)]])
def test_odd_documents_go_through_every_stage(spark, rows):
    docs = spark.createDataFrame([(*r, "w", "m", "t", "o", "k") for r in rows], SHAPE)
    labels = scratch(spark, "tables")
    spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic long").write.parquet(f"{labels}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = store(stage(spark, docs, labels), "odd")
        if name != "packing":
            assert after.columns == docs.columns
            assert after.exceptAll(docs).count() == 0
        docs = after
    assert (docs.count() > 0) == bool(rows)
