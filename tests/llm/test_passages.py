import random

import numpy as np
import pyarrow as pa
import pytest

from aerolith.llm import passages

SHAPE = "doc_id long, text string, tid string, chars int, spans int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "", 1, 1) for i, t in rows], SHAPE).repartition(4)


def plain(rows, window=35):
    split = [(t or "").encode().split() for _, t in rows]
    seen = {}
    for words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc, _), words in zip(rows, split):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((doc, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=str)


def check(spark, rows):
    got = passages.cut(docs(spark, rows)).collect()
    assert sorted(((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == plain(rows)


@pytest.mark.parametrize("phrases,words", [(50_000, 4_000_000), (20, 200)])
def test_equals_brute_force(spark, phrases, words, monkeypatch):
    """Shared passages, edited copies, exact copies and periodic texts, in one shard and in many."""
    monkeypatch.setattr(passages, "PHRASES", phrases)
    monkeypatch.setattr(passages, "WORDS", words)
    draw = random.Random(2)
    vocabulary = ["".join(draw.choices("abcdéß", k=draw.randint(1, 6))) for _ in range(500)]
    fresh = lambda n: draw.choices(vocabulary, k=n)
    shared = [fresh(n) for n in (34, 35, 36, 52, 90, 300)]
    rows = []
    for i in range(120):
        words_i = fresh(draw.randint(0, 150))
        for _ in range(draw.randint(0, 2)):
            at = draw.randint(0, len(words_i))
            words_i[at:at] = draw.choice(shared)
        rows.append((i, draw.choice([" ", "\t", "\n "]).join(words_i)))
    for i in range(30):
        source = rows[draw.randrange(120)][1].split()
        for _ in range(draw.randint(0, 3)):
            if source:
                source[draw.randrange(len(source))] = "edited"
        rows.append((200 + i, " ".join(source)))
    rows += [(300, "x " * 200), (301, "x y " * 60), (302, "a b c " * 30 + " ".join(fresh(40))), (303, "x " * 35), (304, "z " * 36)]
    check(spark, rows)


def test_odd_rows(spark):
    long = " ".join(str(i * 7919 % 100_003) for i in range(30_000))
    rows = [(None, None), (None, "a b"), (1, ""), (2, " \t\n"), (3, "w " * 34), (4, "v " * 35), (5, long), (6, long), (6, long),
            (7, " ".join(map(str, range(35)))), (8, " ".join(map(str, range(1, 36)))), (9, " ".join(map(str, range(200))))]
    check(spark, rows)
    assert passages.cut(docs(spark, [])).count() == 0


def test_a_passage_in_most_texts(spark, monkeypatch):
    monkeypatch.setattr(passages, "WORDS", 500)
    draw = random.Random(9)
    shared = [f"s{i}" for i in range(80)]
    rows = [(i, " ".join([f"u{draw.random()}" for _ in range(30)] + shared + [f"u{draw.random()}" for _ in range(30)])) for i in range(150)]
    check(spark, rows)


def test_ranges_are_hashed_by_content():
    words = [str(i % 40).encode() for i in range(500)]
    text = passages.Text(b" ".join(words))
    hashes = text.ranges(np.arange(466), 35, "window")
    same = {}
    for i, h in enumerate(hashes.tolist()):
        same.setdefault(h, set()).add(tuple(words[i:i + 35]))
    assert all(len(v) == 1 for v in same.values()) and len(same) == len({w for v in same.values() for w in v})


def test_equal_windows_name_equal_phrases():
    draw = random.Random(1)
    passage = [f"p{i}".encode() for i in range(35)]
    named = []
    for _ in range(20):
        before, after = ([f"x{draw.random()}".encode() for _ in range(draw.randint(0, 50))] for _ in range(2))
        phrase, _, first, windows = passages.Text(b" ".join(before + passage + after)).blocks()
        k = int(np.searchsorted(first, len(before), side="right")) - 1
        assert first[k] <= len(before) < first[k] + windows[k]
        named.append(int(phrase[k]))
    assert len(set(named)) == 1


def test_texts_laid_end_to_end_name_what_each_names_alone():
    draw = random.Random(5)
    texts = [b" \t".join(draw.choice([b"a", b"bb", b"%d" % draw.randrange(9), b"%d" % draw.randrange(10**9)])
                         for _ in range(draw.choice([0, 1, 34, 35, 36, 90, 200]))) for _ in range(60)]
    texts[7:7] = [b"", b" \n", b"q " * 100]
    laid = passages.Text(*texts)
    want = []
    for start, text in zip(laid.edges.tolist(), texts):
        alone = passages.Text(text)
        if alone.n < 35:
            continue
        hashes = alone.ranges(np.arange(alone.n - 9), 10, "phrase")
        named = [i + int(hashes[i:i + 26].argmin()) for i in range(alone.n - 34)]
        for place in sorted(set(named)):
            want.append((int(hashes[place]), start + place, start + named.index(place), named.count(place)))
    assert [tuple(map(int, run)) for run in zip(*laid.blocks())] == want


def test_words_are_hashed_by_all_their_bytes():
    words = [b"x" * n + end for n in range(1, 140) for end in (b"", b"\0", b"y", b"\0\0", "é".encode())]
    hashes = passages.Text(b"\r".join([*words, *words])).words.tolist()
    n = len(words)
    assert hashes[:n] == hashes[n:] and len(set(hashes)) == len(set(words))
    assert [passages.Text(b"a", b"\x0b" + w, b"b").words.tolist()[1] for w in words] == hashes[:n]


def test_what_a_shard_is_sent():
    """No lists, which cost more than the automata to send, and one row for all phrases a text brings."""
    words = [b"w%d" % i for i in range(400)]
    text = b" ".join(words)
    phrases = np.unique(passages.Text(text).blocks()[0]).view(np.int64).tolist()
    held = [{"phrase": p, "shard": 3 if i % 2 else 4, "own": bool(i % 2)} for i, p in enumerate(phrases)]
    batch = pa.RecordBatch.from_pydict({"text": [text], "copy": [5], "tid": [6], "chars": [len(text)], "copies": [1], "held": [held]})
    rows = [row for sent in passages._prepared(iter([batch])) for row in sent.to_pylist()]
    assert sorted((row["kind"], row["shard"]) for row in rows) == [(0, 3), (1, 3), (1, 4)]
    assert not any(isinstance(value, list) for row in rows for value in row.values())
    own = [row["letters"] for row in rows if row["kind"] == 0][0]
    assert len(own) == passages.LETTERS * passages.PHRASE * (len(phrases) // 2)
    assert own[:passages.LETTERS * passages.PHRASE] in passages.Text(text).letters()


def colliding(n=60):
    """Pairs of different words with the same letter in the automata."""
    words = [f"n{i}".encode() for i in range(60_000)]
    letters = passages.Text(b" ".join(words)).letters()
    seen, pairs = {}, []
    n_of = passages.LETTERS
    for i, word in enumerate(words):
        letter = letters[n_of * i:n_of * (i + 1)]
        if letter in seen:
            pairs.append((seen[letter].decode(), word.decode()))
        seen[letter] = word
    assert len(pairs) >= n
    return pairs[:n]


@pytest.mark.parametrize("phrases", [5, 50_000])
def test_phrases_of_equal_letters_in_several_shards(spark, monkeypatch, phrases):
    """Templates that differ in words of equal letters: nothing more is cut than what repeats."""
    monkeypatch.setattr(passages, "PHRASES", phrases)
    draw = random.Random(11)
    base, pairs, rows = [f"t{i}" for i in range(60)], colliding(), []
    for i in range(60):
        words = list(base)
        for at in range(3, 60, 7):
            pair = draw.choice(pairs)
            words[at] = pair[draw.randrange(2)]
        rows.append((i, " ".join(words)))
        twin = [next((p[1 - p.index(w)] for p in pairs if w in p), w) for w in words]
        rows.append((100 + i, " ".join(twin)))
    rows += [(300 + i, " ".join([*rows[i][1].split()[:40], f"end{i}"])) for i in range(6)]
    check(spark, rows)
