import random
import zlib

import pytest

from aerolith.llm import toxicity

BAD, STEM, GOOD = ["grumbol", "snarfle"], "vlequ", "abe con der eli fam gor hul ino jar kel lum".split()


def rows(n=400):
    draw = random.Random(3)
    out = []
    for i in range(n):
        words = draw.choices(GOOD, k=draw.randint(3, 80))
        toxic = i % 4 == 0
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice([*BAD, STEM + "".join(draw.choices("xyzaei", k=2))]))
        elif i % 5 == 0:
            words += ["grumbol", "wine"]
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def learnt(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, None, y) for i, _, y in data], "doc_id long, text string, toxic long")
    return docs, toxicity.learn(docs, labels), data


def test_folding():
    assert toxicity.fold("Th1s  iDi0T, 4 ÉTÉ\tсlоwn!!") == " this idiot etе clown ".replace("е", "e").replace("idiot ", "idiot ")
    assert toxicity.fold("") == "  " and toxicity.fold("!!! 77") == "  "
    assert toxicity.fold("m0r0n 1d10t covid19 $tupid") == " moron idiot covid stupid "


def test_lexicon_and_exceptions(learnt):
    _, lexicon, _ = learnt
    assert {" grumbol ", " snarfle "} <= set(lexicon.weights) and f" {STEM}" in lexicon.weights
    assert " grumbol wine " in lexicon.exceptions
    assert lexicon.hits(toxicity.fold("abe grumbol wine")) == {}
    assert lexicon.hits(toxicity.fold("abe grumb0l kel"))


def test_held_out_rows_are_told_apart(learnt):
    _, lexicon, data = learnt
    held = [(lexicon.score(t), y) for i, t, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.95


def test_matches_equal_brute_force(learnt):
    _, lexicon, data = learnt
    for _, text, _ in data:
        folded = toxicity.fold(text)
        want = {}
        for entry, weight in lexicon.weights.items():
            at = folded.find(entry)
            while at >= 0:
                want[at] = max(weight, want.get(at, 0))
                at = folded.find(entry, at + 1)
        for phrase in lexicon.exceptions:
            at = folded.find(phrase)
            while at >= 0:
                want = {s: w for s, w in want.items() if not at <= s < at + len(phrase) - 1}
                at = folded.find(phrase, at + 1)
        assert lexicon.hits(folded) == want


def test_odd_texts(spark, learnt):
    docs, lexicon, _ = learnt
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "abe " * 50_000), (3, "snarfle " * 50_000)],
                                "doc_id long, text string")
    got = [r["tox_score"] for r in toxicity.score(odd, lexicon).collect()]
    assert got[0] == got[1] == got[2] < 0.5 and got[3] < 0.5 < got[4]
    assert toxicity.score(odd.limit(0), lexicon).count() == 0


def test_without_labels(spark, learnt):
    docs, _, _ = learnt
    none = spark.createDataFrame([], "doc_id long, toxic long")
    lexicon = toxicity.learn(docs, none)
    assert lexicon.score("grumbol") < 0.5
    one = spark.createDataFrame([(i, 0) for i in range(50)] + [(None, 1), (7, None)], "doc_id long, toxic long")
    assert toxicity.learn(docs, one).score("grumbol") < 0.5
