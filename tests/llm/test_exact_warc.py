import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from aerolith.llm import exact, warc
from aerolith.session import scratch

DOCS = "doc_id long, text string, copies int, row string"


def docs(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).repartition(parts)


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
def test_groups_equal_brute_force(spark, keep, pick):
    rows = [(i, ["a", "b", None, "", "long " * 9000, f"own {i}"][min(i % 7, 5)]) for i in range(200)]
    rows += [(1000 + i, "hot") for i in range(300)]
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    for parts in (1, 5, 70):
        got = exact.groups(docs(spark, rows, parts), keep=keep).collect()
        assert len(got) == len(rows)
        want = {i: (pick(ids), len(ids)) for ids in by.values() for i in ids}
        assert {r["id"]: (r["keep_id"], r["copies"]) for r in got} == want
        assert sum(r["row"] == r["keep_row"] for r in got) == len(by)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    got = exact.groups(docs(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "z")])).collect()
    assert sorted((r["keep_id"] or -1, r["copies"]) for r in got) == [(-1, 1), (1, 3), (1, 3), (1, 3)]
    assert sum(r["row"] == r["keep_row"] for r in got) == 2
    assert exact.groups(docs(spark, [])).count() == 0


def test_deduplicate_keeps_columns(spark):
    kept = exact.deduplicate(docs(spark, [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "q")]), keep="largest")
    assert kept.columns == ["doc_id", "text", "copies", "row"]
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 4]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, value string, id int").repartition(3)


def test_round_trip(spark):
    separator = warc.SEPARATOR
    texts = {1: "x" * 1000, 2: "x" * 1000, 3: "short", 4: "short", 5: None, 6: "", 7: "é€𐍈" * 50_000,
             8: separator * 40, 9: "a" * 70_000 + separator + "\r\n\r\nWARC/1.1", 10: "\r\n" * 600, 11: "\r\n" * 600}
    rows = [(i, "http://x/a\r\nWARC-Type: b" if i % 2 else None, t, "v", 1) for i, t in texts.items()]
    path = warc.write(pages(spark, rows), scratch(spark, "warc"), chunk=4096)
    got = {r["record_id"]: r for r in warc.read(spark, path).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        data = (t or "").encode()
        r = got[str(i)]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        if r["record_type"] == "response":
            assert r["chunk_no"] >= len(data) / 4096
    assert {i for i, r in got.items() if r["record_type"] == "revisit"} == {"1", "10"}
    assert got["1"]["refers_to"] == "2" and got["10"]["refers_to"] == "11"


def test_archive_without_pages_and_with_odd_rows(spark):
    path = warc.write(pages(spark, []), scratch(spark, "warc"))
    assert warc.read(spark, path).count() == 0
    path = warc.write(pages(spark, [(None, None, None, None, None), (1, "u", "p" * 2000, "", 1), (1, "u", "p" * 2000, "", 1)]),
                      scratch(spark, "warc"))
    got = sorted((r["record_id"], r["record_type"], r["payload_bytes"]) for r in warc.read(spark, path).collect())
    assert got == [("1", "response", 2000), ("1", "response", 2000), ("null", "response", 0)]


def test_files_hold_the_whole_payload(spark):
    path = warc.write(pages(spark, [(1, "u", "abc" * 5000, "", 1)]), scratch(spark, "warc"), chunk=1000)
    files = glob.glob(f"{path.removeprefix('file:')}/part-*.gz")
    text = "".join(gzip.open(name, "rt", encoding="utf-8", newline="").read() for name in files)
    bodies = [part.partition("\r\n\r\n")[2] for part in text.split("WARC/1.1\r\n")[1:]]
    assert "".join(b.removesuffix("\r\n\r\n") for b in [bodies[0].partition("\r\n\r\n")[2], *bodies[1:]]) == "abc" * 5000


def test_a_changed_chunk_is_noticed(spark):
    path = warc.write(pages(spark, [(1, "u", "abc" * 5000, "", 1)]), scratch(spark, "warc"), chunk=1000)
    lines = spark.read.option("lineSep", warc.SEPARATOR).text(path)
    other = scratch(spark, "warc")
    lines.coalesce(1).select(F.regexp_replace("value", "cab", "cba").alias("value")).write.option(
        "lineSep", warc.SEPARATOR).option("compression", "gzip").text(other)
    with pytest.raises(Exception, match="digest differs"):
        warc.read(spark, other).collect()
