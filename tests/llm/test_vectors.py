import math

import numpy as np
import pytest

from aerolith.llm import vectors

SHAPE = "vec_id long, embedding array<float>, label string, vertex int, links string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "") for i, v, label in rows], SHAPE).repartition(4)


def plain(rows, threshold):
    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or not a:
            return -2.0
        if any(x is None or not math.isfinite(x) for x in [*a, *b]) or not any(a) or not any(b):
            return -2.0
        x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))

    n = len(rows)
    links = [[j for j in range(n) if j != i and rows[i][2] is not None and rows[i][2] == rows[j][2]
              and cosine(rows[i][1], rows[j][1]) >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], len(links[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def clustered(n, size, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n // 8, size))
    rows = []
    for i in range(n):
        v = centres[draw.integers(len(centres))] + draw.normal(size=size) * draw.choice([0.0, 0.1, 0.25, 0.4, 2.0])
        rows.append((i, [float(x) for x in v * draw.choice([1, 3])], "ab"[int(draw.integers(2))]))
    return rows


@pytest.mark.parametrize("tile,size", [(1024, 24), (16, 24), (16, 5), (16, 64)])
def test_equals_brute_force(spark, tile, size, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", tile)
    rows = clustered(300, size)
    got = vectors.near_duplicates(table(spark, rows)).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == plain(rows, 0.93)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


def test_a_hot_group_of_copies_and_near_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 32)
    draw = np.random.default_rng(3)
    base = draw.normal(size=12)
    rows = [(i, [float(x) for x in base], "hot") for i in range(100)]
    rows += [(100 + i, [float(x) for x in base + draw.normal(size=12) * 0.02], "hot") for i in range(100)]
    rows += [(200 + i, [float(x) for x in draw.normal(size=12)], "hot") for i in range(60)]
    got = vectors.near_duplicates(table(spark, rows)).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == plain(rows, 0.93)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (1, [2.0, 0.0], "a"), (2, [1.0, 0.0], None), (3, None, "a"), (4, [], "a"),
            (5, [0.0, 0.0], "a"), (6, [1.0, nan], "a"), (7, [1.0, inf], "a"), (8, [1.0, None], "a"),
            (9, [1.0, 0.0, 0.0], "a"), (10, [1.0, 0.0], "b"), (11, [-0.0, 1.0], "b"), (12, [0.0, 1.0], "b"), (13, [1e-30, 0.0], "a")]
    got = vectors.near_duplicates(table(spark, rows)).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == plain(rows, 0.93)
    repeated = vectors.near_duplicates(table(spark, [(1, [1.0], "a"), (1, [1.0], "a"), (None, [1.0], "a"), (None, None, None)])).collect()
    assert sorted((r["n_links"], r["component_id"] or -1) for r in repeated) == [(0, -1), (2, 1), (2, 1), (2, 1)]
    assert vectors.near_duplicates(table(spark, [])).count() == 0


def test_bounds_never_cut_a_link():
    draw = np.random.default_rng(5)
    v = draw.normal(size=(60, 40)) + 3 * draw.normal(size=(1, 40))
    turn = np.linalg.qr(draw.normal(size=(40, 40)))[0]
    t = vectors._unit(v) @ turn
    i, j = vectors.linked(t, v, t, v, 0.9, True)
    cosine = vectors._unit(v) @ vectors._unit(v).T
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(60) for b in range(a + 1, 60) if cosine[a, b] >= 0.9}
