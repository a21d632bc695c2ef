import zlib

import numpy as np
import pytest

from aerolith.llm import language
from tests.conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    return language.learn(docs.where("crc32(cast(doc_id AS string)) % 5 <> 0"))


def test_held_out_documents(spark, model):
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = [(model.names[int(model.evidence(r["text"]).argmax())], r["lang"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_reading_pages():
    page = '<!DOCTYPE html><HTML class=x lang="FR-ca"><script>var a="</p>";</script><!-- x --><p>Un&eacute; b<b>c</b>'
    assert language.declared(page) == "fr"
    assert language.visible(page).split() == ["Uné", "b", "c"]
    assert language.declared('<meta http-equiv="Content-Language" content="de">') == "de"
    assert language.declared("<html><p lang=en>") is None and language.declared("") is None
    assert language.address("https://u:p@A.b.Example.CO:80/x?y") == ("a.b.example.co", "example.co", "co")
    assert [language.address(u) for u in (None, "", "nonsense", "mailto:x")] == [("", "", "")] * 4
    assert language.visible("<p>open <script>never closed") .split() == ["open"]


def test_fusion_equals_direct_formula(spark, model):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["id"]: r for r in language.identify(pages, model).collect()}
    read = []
    for r in pages.collect():
        evidence = model.evidence(language.visible(r["html"]))
        best = model.names[int(evidence.argmax())] if evidence.any() else None
        read.append((r["page_id"], *language.address(r["url"]), language.declared(r["html"]), best, evidence))
    assert len(got) == len(read)
    count = lambda k, v, lang: sum(x[k] == v and x[5] == lang for x in read)
    total = sum(x[5] is not None for x in read)
    kinds = {k: len({x[k] for x in read} - {None}) for k in (3, 4)}
    for page, host, domain, suffix, said, best, evidence in read:
        scores = []
        for i, lang in enumerate(model.names):
            n_lang, own = sum(x[5] == lang for x in read), best == lang
            base = (n_lang + 1) / (total + len(model.names))
            of = lambda k, v: sum(x[k] == v and x[5] is not None for x in read) - (best is not None)
            d = (count(2, domain, lang) - own + 4 * base) / (of(2, domain) + 4)
            h = (count(1, host, lang) - own + 4 * d) / (of(1, host) + 4)
            score = evidence[i] + np.log(h)
            if said is not None:
                score += np.log((count(4, said, lang) + 0.5 + 5 * (said == lang)) / (n_lang + 0.5 * kinds[4] + 5))
            if suffix:
                score += np.log((count(3, suffix, lang) + 0.5) / (n_lang + 0.5 * kinds[3]))
            scores.append(score)
        odds = np.exp(np.array(scores) - max(scores))
        assert got[page]["lang"] == model.names[int(np.argmax(scores))]
        assert got[page]["probability"] == pytest.approx(odds.max() / odds.sum(), rel=1e-9)
        assert got[page]["posterior"] == pytest.approx(dict(zip(model.names, odds / odds.sum())), rel=1e-9, abs=1e-12)


SHAPE = "page_id long, url string, html string, host string, evidence int"


def test_odd_pages(spark, model):
    rows = [(1, None, None, "", 1), (2, "", "", "", 1), (2, "", "", "", 1), (None, "http://x.example/", "<p>", "", 1),
            (3, "http://a.b.de/", "<html lang=de>" + "der und die " * 20_000, "", 1), (4, "http://a.b.de/", "123", "", 1)]
    pages = spark.createDataFrame(rows, SHAPE)
    got = language.identify(pages, model).collect()
    assert len(got) == len(rows) and all(r["lang"] in model.names and 0 < r["probability"] <= 1 for r in got)
    assert {r["id"]: r["lang"] for r in got}[4] == "de"
    assert language.identify(pages.limit(0), model).count() == 0
    nothing = language.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r["lang"] for r in language.identify(pages, nothing).collect()] == [None] * len(rows)


def test_a_rare_language_is_in_the_model_at_every_size(spark):
    """Names come from all documents and each language has a sample of its own."""
    rows = [(i, "the house and the garden", "en") for i in range(3000)] + [(5000 + i, "það var þó ekki hægt", "is") for i in range(3)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100)
    assert model.names == ["en", "is"]
    assert model.names[int(model.evidence("ekki var það hægt").argmax())] == "is"
    # Both tables are learnt, not smoothing alone.
    assert all(len(np.unique(model.log[:, k])) > 1 for k in range(2))


def test_tags_are_read_by_their_first_part_and_junk_is_no_language(spark):
    rows = [(1, "the house", "en-US"), (2, "the garden", " EN"), (3, "das haus", "de_AT"), (4, "x", "english"), (5, "x", "??"), (6, "x", None), (7, "x", "")]
    assert language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).names == ["de", "en"]


def test_many_languages_cost_little_more_than_few(spark):
    """Two hundred languages of invented letters: right answers, and a plan no longer than that of four."""
    draw = np.random.default_rng(7)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 1200)]
    code = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    text = lambda k, n: " ".join("".join(draw.choice(letters[6 * k:6 * k + 6], 4)) for _ in range(n))
    docs = spark.createDataFrame([(k, text(k, 60), code(k)) for k in range(200)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(k, f"http://h{k % 9}.example/{k}", text(k, 20)) for k in range(200)], "page_id long, url string, html string")
    model = language.learn(docs)
    found = language.identify(pages, model)
    assert len(model.names) == 200 and sum(r["lang"] == code(r["id"]) for r in found.collect()) > 195
    few = language.identify(pages, language.learn(docs.where("doc_id < 4")))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().split("score"))
    assert size(found) == size(few)
