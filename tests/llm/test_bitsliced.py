import math
import random
import re

import numpy as np
import pytest

from aerolith.llm import bitsliced

DOCS = "doc_id long, text string, row string, item int, terms int"
ITEMS = "item_id long, text string, grp string, least int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "", 1, 1) for i, t in rows], DOCS).repartition(parts)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "", 1) for i, t in rows], ITEMS)


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, wanted, k):
    held = [(i, split(t)) for i, t in rows]
    held = [(i, t) for i, t in held if t]
    n, length = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    out = []
    for item, text in wanted:
        scored = []
        for i, t in held:
            m = 100 - 50 + (50 * len(t) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
                        for term in set(split(text)) if (tf := t.count(term)))
            if score > 0:
                scored.append((-score, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored, key=lambda e: (e[0], e[1] is None, e[1] or 0))[:k])]
    return sorted(out, key=str)


def found(spark, rows, wanted, k=50, parts=3):
    got = bitsliced.search(bitsliced.Index(docs(spark, rows, parts)), items(spark, wanted), k).collect()
    return sorted(((r["item_id"], r["rank"], r["id"], r["score"]) for r in got), key=str)


def corpus(n=300, seed=4):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdéß", k=draw.randint(1, 5))) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [(i, draw.choice([" ", ", ", "\n", "--"]).join(draw.choices(vocabulary, weights, k=draw.randint(0, 120)))) for i in range(n)], vocabulary


@pytest.mark.parametrize("k,seeds,queries", [(50, 4, 256), (3, 1, 2)])
def test_equals_brute_force(spark, monkeypatch, k, seeds, queries):
    """With loose floors and small groups of queries the answer is the same."""
    monkeypatch.setattr(bitsliced, "SEEDS", seeds)
    monkeypatch.setattr(bitsliced, "QUERIES", queries)
    rows, vocabulary = corpus()
    rows += [(1000 + i, rows[7][1].upper()) for i in range(30)]  # ties: the same text in other letters
    rows += [(2000, "rare " * 4000), (2001, " ".join(f"w{i}" for i in range(30_000)))]
    draw = random.Random(1)
    wanted = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 12)))) for i in range(12)] + [(90, "rare W7 w8 nowhere"), (91, rows[7][1])]
    assert found(spark, rows, wanted, k) == plain(rows, wanted, k)


def test_bounds_are_never_below_scores(spark):
    """For every query and document, and tight enough to leave most documents out."""
    import pyarrow as pa

    rows, vocabulary = corpus(200, 9)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t.encode() for _, t in rows], pa.binary())], names=["row", "text"])
    blocks = [b for b in bitsliced._sliced([batch]) if b.column(3)[0].as_py() is not None]
    held = {i: split(t) for i, t in rows}
    n, length = sum(bool(t) for t in held.values()), sum(map(len, held.values()))
    terms = sorted({t for words in held.values() for t in words})[:60]
    queries = [{"item": q, "least": 0.0, "hashes": [int(np.uint64(bitsliced._KNOWN[t.encode()]).view(np.int64)) for t in terms[q::5]],
                "weights": [1 + i for i in range(len(terms[q::5]))]} for q in range(5)]
    numbers, _, slabs = bitsliced._group(queries)
    loose = 0
    for block in blocks:
        at, sizes, width, slices = (block.column(i)[0].as_py() for i in range(4))
        bounds = bitsliced._bounds(numbers, slabs, at, sizes, width, slices, n, length)
        for q in range(5):
            for d, row in enumerate(at):
                exact = sum((1 + i) * bitsliced.worth(tf, len(held[row]), n, length)
                            for i, t in enumerate(terms[q::5]) if (tf := held[row].count(t)))
                assert bounds[q, d] >= exact
                loose += bounds[q, d] > 1.3 * exact + 1e6
    assert loose < 0.1 * 5 * len(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "!!! ..."), (None, "Abc def"), (4, "abc DEF"), (4, "abc DEF"), (5, "abc\x00def"), (6, "xyz")]
    wanted = [(None, "abc"), (1, None), (2, "?!"), (3, "def def abc"), (3, "def def abc"), (4, "unknown")]
    assert found(spark, rows, wanted) == plain(rows, wanted, 50)
    assert found(spark, [], wanted) == [] and found(spark, rows, []) == [] and found(spark, [(1, "")], wanted) == []


def test_one_text_a_third_of_all(spark):
    rows = [(i, "hot words here" if i % 3 == 0 else f"cold {i} words") for i in range(600)]
    wanted = [(0, "hot here"), (1, "words")]
    assert found(spark, rows, wanted, parts=8) == plain(rows, wanted, 50)
