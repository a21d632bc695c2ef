"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

The tree has regions, racks and slots. Every slot has room, and holds a shard of some weight up
to that room or none. A row descends from the top: at each level every child draws
ln(u) / room, u from a hash of the row's key, the attempt and the child's name, and the largest
draw wins, so a child is taken in proportion to its room. The slot that is reached takes the row
if a further draw falls below weight / room; else the row descends again with the next attempt.

Rooms never change, weights do: with a weight that rises a slot takes rows it had refused, with
one that falls it refuses rows it had taken. So rows move only into or out of the slots
whose weights change and nowhere else in the tree, and every shard has rows in
proportion to its weight. A new shard fills an empty slot and takes rows only into itself. A row that no
slot took in ATTEMPTS descents is drawn among all shards by weight at once; there too a
change moves rows only to or from the shard that changed.

Slots of a shard's rows are positions in the order of identifiers, counted by ranges: a shard with
any number of rows is never in one task. Placing moves no text.

Defined cases: a null text has no bytes; a null identifier is placed like the text "null" and
comes first in its shard; rows that repeat an identifier lie in one shard, one after another;
an empty table gives an empty result; columns other than the two named ones are not read.
"""

from typing import NamedTuple

from pyspark.sql import functions as F

from aerolith.llm.ordering import positions
from aerolith.session import store

#: Regions, racks of a region, slots of a rack.
FAN = (4, 4, 4)
ATTEMPTS = 64
RECORD_BYTES = 16


class Tree(NamedTuple):
    """rooms[region][rack][slot], and {(region, rack, slot): (shard, weight)} of the slots in use."""

    rooms: tuple
    shards: dict

    def slots(self):
        """The use of every slot in the order of the rooms: (shard or -1, weight / room)."""
        for r, racks in enumerate(self.rooms):
            for k, slots in enumerate(racks):
                for s, room in enumerate(slots):
                    shard, weight = self.shards.get((r, k, s), (-1, 0.0))
                    yield shard, weight / room if room else 0.0


def grid(count, fan=FAN, weights=None):
    """A tree of equal rooms whose shards 0 to count - 1 are dealt to regions, then racks, then slots in turn.

    weights: {shard: share of its room}, 1 where not given. The tree of one more shard differs in one slot.
    """
    regions, racks, slots = fan
    if count > regions * racks * slots:
        raise ValueError(f"{count} shards do not fit a tree of {regions * racks * slots} slots")
    rooms = tuple(tuple((1.0,) * slots for _ in range(racks)) for _ in range(regions))
    places = {(s % regions, s // regions % racks, s // (regions * racks)): (s, float((weights or {}).get(s, 1.0)))
              for s in range(count)}
    if any(not 0 <= w <= 1 for _, w in places.values()):
        raise ValueError("a weight is a share of the slot's room, from 0 to 1")
    return Tree(rooms, places)


def uniform(*parts):
    """A number in (0, 1) from 32 bits of the hash of the parts."""
    digits = F.substring(F.sha2(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))


def _let(value, use):
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _descend(key, attempt, node, rooms):
    """The child of a node with the largest weighted draw. rooms: its children's rooms."""
    def draw(room, child):
        score = F.when(room > 0, F.ln(uniform(key, attempt, F.concat_ws(".", node, child.cast("string")))) / room)
        return F.struct(F.coalesce(score, F.lit(float("-inf"))).alias("draw"), child.alias("child"))

    return F.array_max(F.transform(rooms, draw))["child"]


def _array(values, kind):
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def place(key, *trees):
    """An array of shards for a text key, one per tree; trees of one family of rooms share the draws."""
    rooms = trees[0].rooms
    if any(t.rooms != rooms for t in trees) or not all(t.shards for t in trees):
        raise ValueError("trees need shards, and the same rooms if they are to be compared")
    regions = _array([sum(map(sum, racks)) for racks in rooms], "double")
    racks = F.array(*[_array([sum(slots) for slots in racks], "double") for racks in rooms])
    slots = F.array(*[F.array(*[_array(slots, "double") for slots in racks]) for racks in rooms])
    first, starts = 0, []
    for r in rooms:
        starts.append([])
        for k in r:
            starts[-1].append(first)
            first += len(k)
    starts = F.array(*[_array(s, "int") for s in starts])
    used = [list(t.slots()) for t in trees]
    shards = F.array(*[_array([s for s, _ in u], "int") for u in used])
    shares = F.array(*[_array([w for _, w in u], "double") for u in used])

    def taken(attempt):
        """Slot and acceptance draw of one descent."""
        return _let(_descend(key, attempt, F.lit("tree"), regions), lambda r: _let(
            _descend(key, attempt, F.concat_ws(".", F.lit("tree"), r.cast("string")), F.get(racks, r)), lambda k: _let(
                _descend(key, attempt, F.concat_ws(".", F.lit("tree"), r.cast("string"), k.cast("string")), F.get(F.get(slots, r), k)),
                lambda s: F.struct((F.get(F.get(starts, r), k) + s).alias("slot"),
                                   uniform(key, attempt, F.lit("take"), r, k, s).alias("u")))))

    def attempt_once(found, attempt):
        return F.when(F.array_min(found) >= 0, found).otherwise(_let(taken(attempt), lambda at: F.transform(
            found, lambda shard, i: F.when(shard >= 0, shard).when(
                at["u"] < F.get(F.get(shares, i), at["slot"]), F.get(F.get(shards, i), at["slot"])).otherwise(F.lit(-1)))))

    def by_weight(tree):
        held = [(s, w) for s, w in tree.shards.values() if w > 0]
        return F.array_max(F.array(*[F.struct((F.ln(uniform(key, "last", str(s))) / F.lit(w)).alias("draw"),
                                              F.lit(s).alias("shard")) for s, w in held]))["shard"]

    none = F.array(*[F.lit(-1) for _ in trees])
    found = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), none, attempt_once)
    last = F.array(*[by_weight(t) for t in trees])
    return _let(found, lambda f: F.when(F.array_min(f) >= 0, f).otherwise(
        F.transform(f, lambda shard, i: F.when(shard >= 0, shard).otherwise(F.get(last, i)))))


def assign(docs, tree, grown=None, id_col="doc_id", text_col="text"):
    """Rows (id, size, text_crc32, shard, grown_shard, slot). grown: the tree after a change, to tell who moves."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    placed = docs.select(
        F.col(id_col).alias("id"), (F.length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        place(key, tree, grown or tree).alias("__found"))
    rows = store(placed.select("id", "size", "text_crc32", F.get("__found", F.lit(0)).alias("shard"),
                               (F.get("__found", F.lit(1)) if grown else F.lit(None).cast("int")).alias("grown_shard")), "placed")
    return positions(rows, ["shard"], [F.asc_nulls_first("id")], "slot")


def write(docs, tree, path, id_col="doc_id", parts=8):
    """The documents with their columns in one folder per shard, each written by up to `parts` tasks."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    whole = docs.withColumn("shard", F.get(place(key, tree), F.lit(0)))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(parts))
    whole.withColumn("__part", spread).repartition("shard", "__part").drop("__part").write.partitionBy("shard").parquet(path)
    return path


def oracle(count, fan=FAN, attempts=ATTEMPTS):
    """SQL with the rows of assign() for the grids of count and count + 1 shards over documents.

    A row that no slot takes in all attempts (one in 10^27 at 40 shards of 64) is not drawn again here.
    """
    regions, racks, slots = fan

    def u(*parts):
        return "(('0x' || substr(sha256(concat_ws(':', k, a, " + ", ".join(parts) + ")), 1, 8))::BIGINT + 0.5) / 4294967296.0"

    def best(name, prefix, n):
        draws = [f"{{'draw': ln({u(prefix + f' || {repr(str(c))}')}), 'child': {c}}}" for c in range(n)]
        return f"list_max([{', '.join(draws)}]).child AS {name}"

    return f"""WITH keyed AS (
  SELECT doc_id, encode(coalesce(text, '')) AS bytes, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
a1 AS (SELECT k, a, {best('r', "'tree.'", regions)} FROM (SELECT DISTINCT k FROM keyed), range({attempts}) AS x(a)),
a2 AS (SELECT *, {best('j', "'tree.' || r || '.'", racks)} FROM a1),
a3 AS (SELECT *, {best('s', "'tree.' || r || '.' || j || '.'", slots)} FROM a2),
probes AS (SELECT k, a, s * {regions * racks} + j * {regions} + r AS shard FROM a3),
placed AS (SELECT k, (arg_min(shard, a) FILTER (shard < {count}))::INTEGER AS shard,
                  (arg_min(shard, a) FILTER (shard < {count + 1}))::INTEGER AS grown_shard FROM probes GROUP BY k),
sums AS (
  SELECT bytes, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(bytes), '..'),
      lambda x: ('0x' || x)::BIGINT)), lambda v, b: {nibble_steps('v', 'b')}), 4294967295) AS crc
  FROM (SELECT DISTINCT bytes FROM keyed))
SELECT doc_id, (octet_length(bytes) + {RECORD_BYTES})::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, grown_shard
FROM keyed JOIN placed USING (k) JOIN sums USING (bytes)"""


def crc_table():
    """CRC-32 of the sixteen half bytes, by the rule of the reflected polynomial."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def nibble_steps(value, byte):
    """SQL of the CRC-32 register after one more byte: two lookups of half bytes."""
    table = f"[{', '.join(map(str, crc_table()))}]"
    half = f"xor({value}, {byte})"
    once = f"xor({half} >> 4, {table}[({half} & 15) + 1])"
    return f"xor(({once}) >> 4, {table}[(({once}) & 15) + 1])"
