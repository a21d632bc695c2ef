import random

import duckdb
import numpy as np
import pytest
import xxhash

from aerolith.llm import queries, simhash
from aerolith.llm.components import components
from tests.conftest import SMALL


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_classes(ids, linked):
    """Smallest reachable id by repeated search."""
    group = {}
    for i in sorted(ids):
        if i not in group:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in group:
                    group[j] = i
                    todo += [k for k in ids if k not in group and linked(j, k)]
    return group


def test_the_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)
    near = simhash.nearest(words)
    assert (np.bincount(near) == 2048).all()
    errors = words[:: 97] ^ ((simhash.nearest(words[:: 97]) << 11) | simhash._syndromes(simhash.nearest(words[:: 97]) << 11))
    assert np.bitwise_count(errors).max() == 3


def test_two_errors_leave_a_common_codeword():
    draw = np.random.default_rng(1)
    words = draw.integers(0, 1 << 23, 3000)
    at, index = simhash.codewords(words)
    assert set(np.bincount(at)) == {1, 6}
    keys = [set(index[at == i]) for i in range(300)]
    for i in range(300):
        for _ in range(20):
            a, b = draw.integers(0, 23, 2)
            _, other = simhash.codewords(np.array([words[i] ^ (1 << int(a)) ^ (1 << int(b) if a != b else 0)]))
            assert keys[i] & set(other)


def test_fingerprints_equal_plain_ones():
    draw = random.Random(5)
    for n in [0, 1, 2, 3, 4, 254, 255, 256, 600, 40_000]:
        text = " ".join("".join(draw.choices("abÉßcDE", k=3)) for _ in range(n)) + "\t\n"
        got = int(np.array(simhash._shingled(3)(text.encode())[0], np.int64).view(np.uint64))
        if n <= 600:
            assert got == plain_fingerprint(text)
        assert len(simhash.shingle_hashes(text.encode(), 3)) == (max(1, n - 2) if n else 0)


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = plain_classes(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op7_simhash"](spark, SMALL).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def vertices(spark, prints):
    rows = [(int(i), *(int(x) for x in p)) for i, p in enumerate(prints)]
    return spark.createDataFrame(rows, "vertex long, w0 long, w1 long, w2 long").repartition(4)


@pytest.mark.parametrize("block", [4096, 40])
def test_no_link_within_two_bits_is_lost(spark, block, monkeypatch):
    """Random prints, chains of changed bits, and one crowd that shares keys, cut into blocks or not."""
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 64, 60, dtype=np.uint64)
    prints = list(base)
    for _ in range(150):
        p = prints[draw.integers(0, len(prints))]
        for _ in range(int(draw.integers(1, 4))):
            p ^= np.uint64(1) << np.uint64(draw.integers(0, 64))
        prints.append(p)
    crowd = [base[0] ^ np.uint64(1 << 50) ^ (np.uint64(i) << np.uint64(52)) for i in range(200)]
    prints = sorted({int(p) for p in prints + crowd})
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = [(np.array(p, np.uint64).view(np.int64), 0, 0) for p in prints]
    found = {r["id"]: r["component_id"] for r in components(simhash.near(vertices(spark, rows), simhash.exact, 2)).collect()}
    want = plain_classes(range(len(prints)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: found.get(i, i) for i in want} == want


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1300)] + [(5, 5), (1100, 3)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 3 for i in [3, 7, *range(1000, 1300)]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


SHAPE = "doc_id long, text string, hash int, root string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "") for i, t in rows], SHAPE).repartition(5)


def jaccard(a, b, size=5):
    def sets(text):
        words = (text or "").encode().lower().split()
        return {b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(draw, words, rate):
    return [w if draw.random() > rate else "".join(draw.choices("qxzjk", k=6)) for w in words]


def test_near_copies_are_found_and_others_left(spark):
    draw = random.Random(4)
    vocabulary = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 7))) for _ in range(3000)]
    rows, families = [], {}
    for f in range(60):
        words = draw.choices(vocabulary, k=draw.randint(60, 900))
        for k in range(draw.randint(1, 5)):
            rows.append((len(rows), " ".join(words if not k else edited(draw, words, 0.01))))
            families.setdefault(f, []).append(len(rows) - 1)
    text = dict(rows)
    got = {r["id"]: r["root"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    want = plain_classes(list(text), lambda a, b: jaccard(text[a], text[b]) >= 0.8)
    links = [(a, b) for ids in families.values() for a in ids for b in ids if a < b and jaccard(text[a], text[b]) >= 0.8]
    assert sum(got[a] == got[b] for a, b in links) / len(links) >= 0.99
    for a in text:
        for b in text:
            if got[a] == got[b]:
                assert want[a] == want[b]
    kept = simhash.deduplicate(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "hash", "root"]
    assert kept.count() == len(set(got.values()))


def test_a_crowd_of_near_copies_is_one_class(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 50)
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(300)]
    rows = [(i, " ".join(edited(draw, words, 0.004))) for i in range(160)] + [(1000, " ".join(reversed(words)))]
    kept = [r["doc_id"] for r in simhash.deduplicate(docs(spark, rows)).collect()]
    assert sorted(kept) == [0, 1000]


def test_odd_rows(spark):
    long = "word " * 20_000
    rows = [(None, None), (None, "a b c d e f g"), (4, ""), (3, " \t\n"), (5, "one"), (6, "one"), (6, "one"), (7, "ONE"),
            (8, "two words"), (9, long), (10, long)]
    got = [r["doc_id"] for r in simhash.deduplicate(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([None, 3, 5, 8, 9], key=str)
    assert simhash.deduplicate(docs(spark, [])).count() == 0
    classes = simhash.classes(docs(spark, rows)).collect()
    assert len(classes) == len(rows)
    assert {r["component_id"] for r in classes if r["id"] in (3, 4)} == {3}
    assert simhash.classes(docs(spark, [])).count() == 0


def test_a_link_in_a_crowd_of_equal_words_is_found(spark):
    """Texts of the same words in other orders win every tree by bits; the one link must still be found."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(200)]
    rows = [(i, " ".join(draw.sample(words, 200))) for i in range(40)]
    rows += [(100, " ".join(words)), (101, " ".join(words[:100] + ["zz"] + words[101:]))]
    assert jaccard(rows[-1][1], rows[-2][1]) > 0.8
    got = {r["id"]: r["root"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert got[100] == got[101] and len(set(got.values())) == 41


@pytest.mark.parametrize("block", [1024, 16])
def test_classes_in_a_template_equal_brute_force(spark, block, monkeypatch):
    """Texts that share most of a template, most of them under the similarity: groups of many classes."""
    monkeypatch.setattr(simhash, "TEXT_BLOCK", block)
    draw = random.Random(6)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(200)]
    rows = []
    for i in range(120):
        fill = ["".join(draw.choices("qxzjk", k=6)) for _ in range(draw.choice([18, 22, 26, 30, 40]))]
        rows.append((i, " ".join(words + fill)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join([*words[2:], *fill])))
    text = dict(rows)
    want = plain_classes(list(text), lambda a, b: jaccard(text[a], text[b]) >= 0.8)
    got = {r["id"]: r["root"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in text for b in text)
    assert 1 < len(set(want.values())) < len(text)


def cut_and_extended(draw, pairs):
    """Pairs of texts by kind of edit, each of similarity 0.8 to 0.93."""
    def fresh(n):
        return ["".join(draw.choices("abcdefghij", k=7)) for _ in range(n)]

    kinds = {"404 words, 100 appended": (404, 0, 100), "404 words, 60 appended": (404, 0, 60), "24 words, 5 appended": (24, 0, 5),
             "404 words, 44 dropped in front and 44 added": (404, 44, 44), "14 words, the first dropped": (14, 1, 0)}
    for kind, (n, dropped, added) in kinds.items():
        for _ in range(pairs):
            words = fresh(n)
            yield kind, " ".join(words), " ".join(words[dropped:] + fresh(added))


def shares_found(spark, pairs):
    rows, of = [], {}
    for kind, a, b in cut_and_extended(random.Random(7), pairs):
        assert jaccard(a, b) >= 0.8
        of.setdefault(kind, []).append(len(rows))
        rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {r["id"]: r["root"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    return {kind: sum(got[i] == got[i + 1] for i in ids) / len(ids) for kind, ids in of.items()}


def test_cut_and_extended_texts_are_found(spark):
    found = shares_found(spark, 200)
    assert min(found.values()) >= 0.99, found
