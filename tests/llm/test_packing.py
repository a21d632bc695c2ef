import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aerolith.llm import packing, queries
from tests.conftest import SMALL

SHAPE = "doc_id long, text string, row int, sign string, ids string"


@pytest.fixture(scope="module")
def tokenizer():
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens.encode_special_tokens = True
    return lambda text: [*tokens.encode(text or "", add_special_tokens=False).ids, 0]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "", "") for i, t in rows], SHAPE).repartition(3)


def whole(rows, texts, tokenizer):
    """Each id in exactly one piece, sequences gapless and at most 1024 long; returns sequence lengths."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids, at = tokenizer(texts[doc]), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    lengths = []
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        lengths.append(at)
    return lengths


def test_query_places_every_id_once(spark, tokenizer):
    rows = queries.QUERIES["op2_packing"](spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    lengths = whole(rows, texts, tokenizer)
    assert sum(n < 1024 for n in lengths) <= 1


def test_shards_and_odd_texts(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 16)
    monkeypatch.setattr(packing, "TASK", 64)
    draw = random.Random(0)
    texts = {i: " ".join(draw.choices(["alpha", "beta", "Γάμμα", "delta!", "\n\n", "x" * 30, "𐍈"], k=draw.randint(0, 900))) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: "<|endoftext|> and more", 1003: "word " * 30_000, 1004: "same", 1005: "same"}
    lengths = whole(packing.pieces(docs(spark, list(texts.items()))).collect(), texts, tokenizer)
    assert sum(n < 1024 for n in lengths) <= 8


def test_both_readers_of_the_vocabulary_agree(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    texts += ["<|endoftext|>", "  \t\n\r\x0b\x00 é́ 漢字 🙂‍ 'S 'll 123,456", "퟿", "a" * 5000, "  x"]
    json, ranks = (packing.encoder(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", packing.VOCABULARY))
    assert json(texts) == ranks(texts)


def test_repeated_rows_and_empty_table(spark):
    got = packing.pieces(docs(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (None, None)])).collect()
    assert len(got) == 4 and len({r["sequence_id"] for r in got}) == 1
    assert packing.pieces(docs(spark, [])).count() == 0


def test_scores_are_bm25():
    draw = np.random.default_rng(1)
    pieces = [draw.integers(0, 30, draw.integers(1, 40)) for _ in range(20)]
    idf, mean = draw.random(30), 17.0
    index = packing.Index(pieces, idf, mean)
    for q in range(20):
        want = [sum(idf[t] * (c := int((d == t).sum())) * (packing.K1 + 1) / (c + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
                    for t in set(pieces[q].tolist()) if (d == t).any()) for d in pieces]
        assert index.scores(q) == pytest.approx(want)


def test_a_seed_is_joined_by_its_neighbours():
    alike = [np.full(200, t) for t in (1, 2, 1, 2, 1, 2, 1, 2)]
    windows = packing.fill(alike, 800, np.ones(3), 200.0)
    assert [sorted(i % 2 for i, _, _ in w) for w in windows] == [[0] * 4, [1] * 4]


def test_long_runs_of_one_character(tokenizer):
    """A million blanks, line ends, letters, digits or signs: the same ids as by the tokenizers file."""
    encode = packing.encoder(public_tokenizers.path(packing.VOCABULARY))
    for run in (" ", "\n", " \n", "\t"):
        text = f"a{run * 1_000_000}b"
        assert [*encode([text])[0], 0] == tokenizer(text)
    for run in ("a", "7", "!"):
        text = f"x {run * 20_000} y"
        assert [*encode([text])[0], 0] == tokenizer(text)
