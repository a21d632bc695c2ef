import math
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from aerolith.llm import sharding
from aerolith.session import scratch

DOCS = "doc_id long, text string, shard string, size int, slot int"


def docs(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "s", 1, 1) for i, t in rows], DOCS).repartition(parts)


def u(*parts):
    return (int(sha256(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def plain(key, tree):
    """One descent after another, node by node."""
    def pick(attempt, name, rooms):
        return max((math.log(u(key, attempt, f"{name}.{c}")) / room, c) for c, room in enumerate(rooms) if room)[1]

    for attempt in range(sharding.ATTEMPTS):
        r = pick(attempt, "tree", [sum(map(sum, racks)) for racks in tree.rooms])
        k = pick(attempt, f"tree.{r}", [sum(slots) for slots in tree.rooms[r]])
        s = pick(attempt, f"tree.{r}.{k}", tree.rooms[r][k])
        shard, weight = tree.shards.get((r, k, s), (-1, 0.0))
        if u(key, attempt, "take", r, k, s) < weight / tree.rooms[r][k][s]:
            return shard
    return max((math.log(u(key, "last", s)) / w, s) for s, w in tree.shards.values() if w)[1]


UNEVEN = sharding.Tree((((1.0, 2.0), (3.0,)), ((1.0, 0.0, 4.0),)), {(0, 0, 1): (0, 2.0), (0, 1, 0): (1, 1.5), (1, 0, 2): (2, 0.5)})


@pytest.mark.parametrize("tree", [sharding.grid(40), sharding.grid(1), sharding.grid(5, (2, 2, 2), {3: 0.25}), UNEVEN])
def test_places_equal_plain_descents(spark, tree):
    rows = spark.range(150).select(F.col("id").cast("string").alias("k"))
    got = {r["k"]: r["s"] for r in rows.select("k", sharding.place(F.col("k"), tree)[0].alias("s")).collect()}
    assert got == {k: plain(k, tree) for k in got}


@pytest.mark.parametrize("count", [1, 7, 39, 40, 63])
def test_one_more_shard_takes_rows_only_into_itself(spark, count):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    both = sharding.place(F.col("k"), sharding.grid(count), sharding.grid(count + 1))
    pairs = [tuple(r["p"]) for r in rows.select(both.alias("p")).collect()]
    moved = [b for a, b in pairs if a != b]
    assert set(moved) == {count} and abs(len(moved) - 4000 / (count + 1)) < 5 * math.sqrt(4000 / (count + 1))
    assert set(Counter(a for a, _ in pairs)) == set(range(count))


def test_shares_follow_weights_and_only_the_changed_shard_moves_rows(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    before, after = (sharding.grid(10, weights={3: w}) for w in (0.5, 0.2))
    pairs = [tuple(r["p"]) for r in rows.select(sharding.place(F.col("k"), before, after).alias("p")).collect()]
    assert {a for a, b in pairs if a != b} == {3}
    sizes = Counter(b for _, b in pairs)
    for shard in range(10):
        share = (0.2 if shard == 3 else 1.0) / 9.2
        assert abs(sizes[shard] - 20_000 * share) < 5 * math.sqrt(20_000 * share)


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_slots_sizes_and_digests(spark, parts):
    rows = [(i % 150, ["a", None, "", "ß" * 9000, f"own {i}"][i % 5]) for i in range(400)] + [(None, "x"), (None, None)]
    got = sharding.assign(docs(spark, rows, parts), sharding.grid(5), sharding.grid(6)).collect()
    assert len(got) == len(rows)
    for shard in range(5):
        mine = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        ids = [-1 if r["id"] is None else r["id"] for r in mine]
        assert ids == sorted(ids)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in got) == want


def test_one_identifier_with_a_third_of_the_rows(spark):
    rows = [(7 if i % 3 == 0 else 1000 + i, "t") for i in range(900)]
    got = sharding.assign(docs(spark, rows, 9), sharding.grid(4)).collect()
    hot = [r for r in got if r["id"] == 7]
    assert len({r["shard"] for r in hot}) == 1 and len({r["slot"] for r in hot}) == 300


def test_written_shards_hold_every_row(spark):
    given = docs(spark, [(i, f"t{i}") for i in range(200)]).withColumnRenamed("shard", "other")
    path = sharding.write(given, sharding.grid(6), scratch(spark, "shards"))
    back = spark.read.parquet(path)
    assert set(back.columns) == {*given.columns, "shard"} and back.count() == 200
    assert all(r["shard"] == plain(str(r["doc_id"]), sharding.grid(6)) for r in back.collect())


def test_empty_tables_and_impossible_trees(spark):
    assert sharding.assign(docs(spark, []), sharding.grid(3)).count() == 0
    with pytest.raises(ValueError):
        sharding.grid(65)
    with pytest.raises(ValueError):
        sharding.place(F.lit("k"), sharding.grid(0))


def test_no_python_on_the_way(spark):
    plan = sharding.assign(docs(spark, [(1, "a")]), sharding.grid(3))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
