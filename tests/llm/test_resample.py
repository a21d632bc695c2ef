import math
import random
import re
import zlib
from hashlib import sha256

import pytest

from aerolith.llm import ordering, resample
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, weight string, id int, buckets int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "", 1, 1) for i, t in rows], DOCS).repartition(parts)


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(rows, target, share=(25, 100), least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    held = [(i, *features(text)) for i, text in rows]
    for counts, texts in ((s, [f for _, _, f in held]), (t, [features(x)[1] for _, x in target])):
        for fs in texts:
            for f in fs:
                counts[bucket(f)] += 1
    total_s, total_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (total_s + 10_000) / ((a + 1) * (total_t + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, n, fs in held:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    ranked = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(ranked) * share[0] // share[1]
    ranks = {}
    for place, r in enumerate(ranked[:drawn]):
        ranks.setdefault(r, []).append(place + 1)
    return sorted(((r[0], r[2], r[3], r[4], ranks[r].pop(0) if ranks.get(r) else None) for r in out), key=str)


def found(spark, rows, target, **more):
    got = resample.resample(docs(spark, rows), docs(spark, target), **more).collect()
    return sorted(((r["id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got), key=str)


def corpus(n=200):
    draw = random.Random(8)
    vocabulary = ["".join(draw.choices("abcdéß7", k=draw.randint(1, 5))) for _ in range(300)]
    return [(i, draw.choice([" ", ", ", "\n"]).join(w.upper() if draw.random() < 0.1 else w for w in draw.choices(vocabulary, k=draw.randint(0, 90))))
            for i in range(n)]


@pytest.mark.parametrize("words,pairs,counted", [(20_000, 80_000, 400_000), (5, 3, 40), (0, 0, 40)])
def test_equals_brute_force_with_any_head(spark, monkeypatch, words, pairs, counted):
    """A large head, a tiny one whose counts are cut short, and none: the rows are the same."""
    for name, value in (("HEAD_WORDS", words), ("HEAD_PAIRS", pairs), ("COUNTED", counted)):
        monkeypatch.setattr(resample, name, value)
    rows = corpus()
    target = [(i, t) for i, t in corpus(30)[10:]]
    assert found(spark, rows, target) == plain(rows, target)


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "!?"), (3, "word"), (4, "x " * 40_000), (5, "Ünï \x00 cÖde"), (6, "a b c " * 10), (6, "a b c " * 10), (None, "q " * 30)]
    assert found(spark, rows, corpus(5)) == plain(rows, corpus(5))
    assert found(spark, rows, []) == plain(rows, [])
    assert found(spark, [], rows) == []


def test_draws_lean_to_the_target(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choices(["sea", "sun", "sand"] if i % 2 else ["tax", "law", "fee"], k=40))) for i in range(400)]
    ranked = [r for r in found(spark, rows, [(0, "sea sun sand sea sand sun " * 20)]) if r[4]]
    assert len(ranked) == 100 and sum(r[0] % 2 for r in ranked) > 95


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_positions_are_gapless_with_ties(spark, parts):
    rows = spark.createDataFrame([(i % 3 or None, i // 50 if i % 2 else 7) for i in range(1000)], "g long, v long").repartition(parts)
    got = ordering.positions(rows, ["g"], [F.desc("v")]).collect()
    assert len(got) == 1000
    for g in (None, 1, 2):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(mine)))
        assert [r["v"] for r in mine] == sorted((r["v"] for r in mine), reverse=True)
