"""Ranked lexical search over bit-sliced Bloom signatures.

Index. Each document's terms go into a Bloom filter, a term once for each step (1, 2, 3, 4, 6, 8, 12, 16 ...)
that its count reaches. Documents of like size are laid side by side in blocks, turned: one bitmap over the
block's documents for each bit of the filters (a slice). The index also keeps how many
documents hold each term, and every document's text under a row number.

Search. The documents that seem to hold a term up to some step are the AND of that term's slices. Bits
may be set by other terms but are never missing, so a term adds at most what its highest seeming
step allows, and the weighted sum over a query's terms is never below the document's score.
A first pass takes each query's best documents by that bound (SEEDS times K) and scores them exactly: the
K-th of these scores is a floor. A second pass gives every document whose bound reaches the floor,
those are scored exactly from their whole texts, and the K best are returned. What is left
out is proven to score below the floor.

Queries go through the blocks in groups of QUERIES; a group and a few blocks meet in a task.

Score, in 64-bit integers but for the logarithm: with N documents that hold a term at all, L terms in them, n in
one, df documents that hold a term and tf its count there, w = floor(1000 * ln((2N + 2) / (2df + 1))),
m = 50 + (50 n N) div L, score = sum over the query's distinct terms of w * ((10^9 tf) div (1000 tf + 20 m)).

Defined cases: a null or term-less text is in no result and a null or term-less query has none; equal
scores are ordered by identifier (null last), then by row; rows that repeat an identifier or a text are
documents, or queries, of their own; empty tables give an empty result; other columns are not read.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolith.session import store

K = 50
#: Hash functions of a filter; its bits a key at least (up to twice as many, as the width is a power of two).
HASHES, BITS = 5, 16
#: Documents by which a query's floor is found, in multiples of k.
SEEDS = 4
#: Bits of a block, about; documents of a block at most.
AREA, ROWS = 1 << 22, 2048
#: Queries of a group; blocks of a task; terms whose bounds are held at once.
QUERIES, BLOCKS, TERMS = 256, 16, 2048
#: Terms counted before they are handed on, hashes remembered by a task.
COUNTED, REMEMBERED = 150_000, 200_000

#: A-Z to lower case; every ASCII character that is no letter or digit separates terms.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text):
    """Terms of a text in UTF-8, repeats included."""
    return text.translate(_PLAIN).split()


class _Hashes(dict):
    def __missing__(self, term):
        if len(self) > REMEMBERED:
            self.clear()
        value = self[term] = xxhash.xxh64_intdigest(term, 42)
        return value


_KNOWN = _Hashes()


def _step(level):
    """Least count of a level: 1, 2, 3, 4, 6, 8, 12, 16 ..."""
    return (2 + (level + 1) % 2) << (level - 1) // 2 if level else 1


def _bits(hashes, level, width):
    """The filter's bits of terms at a level: one row of HASHES positions a term."""
    h = (hashes + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(width - 1)).astype(np.int64)


INDEX = "rows array<long>, sizes array<long>, width long, slices binary, term binary, docs long"
_LISTS = pa.list_(pa.int64())
_SHAPE = pa.schema([("rows", _LISTS), ("sizes", _LISTS), ("width", pa.int64()), ("slices", pa.binary()),
                    ("term", pa.binary()), ("docs", pa.int64())])


def _block(width, docs):
    """The slices of documents [(row, size, positions)] as one index row."""
    lane = -(-len(docs) // 8)
    slices = np.zeros((width, lane), np.uint8)
    for i, (_, _, at) in enumerate(docs):
        slices[at, i >> 3] |= np.uint8(1 << (i & 7))
    return pa.RecordBatch.from_arrays(
        [pa.array([[d[0] for d in docs]], _LISTS), pa.array([[d[1] for d in docs]], _LISTS), pa.array([width], pa.int64()),
         pa.array([slices.tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())], schema=_SHAPE)


def _counts(seen):
    n = len(seen)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, _LISTS), pa.nulls(n, _LISTS), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
         pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=_SHAPE)


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _sliced(batches):
    """Blocks of a partition's documents by filter width, and documents per term."""
    open_blocks, seen = {}, Counter()
    for batch in batches:
        for row, text in zip(_column(batch, "row").to_pylist(), _column(batch, "text")):
            words = terms(text.as_py())
            if not words:
                continue
            counts = Counter(words)
            seen.update(counts.keys())
            hashes = np.fromiter(map(_KNOWN.__getitem__, counts), np.uint64, len(counts))
            times = np.fromiter(counts.values(), np.int64, len(counts))
            reached, level = [], 0
            while _step(level) <= times.max():
                reached.append(hashes[times >= _step(level)])
                level += 1
            keys = sum(map(len, reached))
            width = BITS << max(5, (keys - 1).bit_length())
            at = np.concatenate([_bits(h, level, width).ravel() for level, h in enumerate(reached)])
            held = open_blocks.setdefault(width, [])
            held.append((row, len(words), at))
            if len(held) >= min(ROWS, max(8, AREA // width)):
                yield _block(width, open_blocks.pop(width))
            if len(seen) > COUNTED:
                yield _counts(seen)
                seen = Counter()
    for width, docs in open_blocks.items():
        yield _block(width, docs)
    if seen:
        yield _counts(seen)


def _rows(table, id_col, text_col, name):
    """Stored (row, id, text): rows numbered once and for all."""
    return store(table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                              F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")), name)


class Index:
    """docs: (row, id, text); blocks: (block, rows, sizes, width, slices); vocabulary: (term, docs); totals."""

    def __init__(self, docs, id_col="doc_id", text_col="text"):
        self.docs = _rows(docs, id_col, text_col, "searched")
        built = store(self.docs.select("row", "text").mapInArrow(_sliced, INDEX), "slices")
        self.blocks = built.where("slices IS NOT NULL").select(
            F.col("rows")[0].alias("block"), "rows", "sizes", "width", "slices")
        self.vocabulary = built.where("term IS NOT NULL").groupBy("term").agg(F.sum("docs").alias("docs"))
        total = built.where("sizes IS NOT NULL").agg(
            F.count("*"), F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()
        self.count, self.n, self.length = (int(v or 0) for v in total)


def _query_terms(batches):
    for batch in batches:
        found = [(row, term) for row, text in zip(_column(batch, "row").to_pylist(), _column(batch, "text"))
                 for term in dict.fromkeys(terms(text.as_py()))]
        if found:
            rows, words = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.binary())], names=["item", "term"])


def _weighted(index, items):
    """Stored queries (grp, item, terms, hashes, weights): terms that some document holds, with their weight."""
    weight = F.floor(1000 * F.ln(F.lit(float(2 * index.n + 2)) / (2 * F.col("docs") + 1).cast("double")))
    held = items.select("row", "text").mapInArrow(_query_terms, "item long, term binary").join(index.vocabulary, "term")
    each = held.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("term", weight.alias("w")))).alias("t"))
    groups = max(1, -(-items.count() // QUERIES))
    return store(each.select(
        F.pmod(F.xxhash64("item"), F.lit(groups)).cast("long").alias("grp"), "item", F.col("t.term").alias("terms"),
        F.transform("t", lambda t: F.xxhash64(t["term"])).alias("hashes"), F.col("t.w").alias("weights")), "queries")


def worth(tf, n, docs, length):
    """What a count of a term adds per weight, in whole numbers; n: terms of the document."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))


def _seeming(hashes, slices, width, sizes, docs, length):
    """Per term and document the most that the term can add per weight."""
    most = np.zeros((len(hashes), len(sizes)))
    left, level = np.arange(len(hashes)), 0
    while len(left) and _step(level) <= sizes.max():
        seen = np.bitwise_and.reduce(slices[_bits(hashes[left], level, width)], axis=1)
        some = seen.any(axis=1)
        left, seen = left[some], seen[some]
        bits = np.unpackbits(seen, axis=1, count=len(sizes), bitorder="little").view(bool)
        value = worth(np.minimum(_step(level + 1) - 1, sizes), sizes, docs, length).astype(float)
        most[left] = np.where(bits, value, most[left])
        level += 1
    return most


def _group(items):
    """A group of queries: item numbers, floors, and per slab of terms the hashes and each query's share of them."""
    all_hashes = np.unique(np.concatenate([np.array(i["hashes"], np.int64) for i in items])).view(np.uint64)
    all_hashes.sort()
    slabs = []
    for a in range(0, len(all_hashes), TERMS):
        slab = all_hashes[a:a + TERMS]
        uses = []
        for number, item in enumerate(items):
            h = np.array(item["hashes"], np.int64).view(np.uint64)
            at = np.searchsorted(slab, h)
            fits = (at < len(slab)) & (slab[np.minimum(at, len(slab) - 1)] == h)
            if fits.any():
                uses.append((number, at[fits], np.array(item["weights"], float)[fits]))
        slabs.append((slab, uses))
    return np.array([i["item"] for i in items]), np.array([i["least"] for i in items], float), slabs


def _bounds(items, slabs, rows, sizes, width, slices, docs, length):
    """Upper bounds of every query of the group for every document of a block."""
    sizes = np.array(sizes, np.int64)
    slices = np.frombuffer(slices, np.uint8).reshape(width, -1)
    bounds = np.zeros((len(items), len(rows)))
    for hashes, uses in slabs:
        most = _seeming(hashes, slices, width, sizes, docs, length)
        for number, at, weights in uses:
            bounds[number] += weights @ most[at]
    return bounds


def _passing(docs, length, best):
    """Stream (grp, part) groups, first the queries, then blocks: (item, row, bound) of what reaches a query's floor.

    With `best`, a query's floor rises to its `best`-th largest bound in the group, and only the largest are given.
    """
    def run(batches):
        now, items, floors, slabs, kept = None, None, None, None, []

        def top():
            item, row, bound = (np.concatenate(c) for c in zip(*kept))
            order = np.lexsort((row, -bound, item))
            item, row, bound = item[order], row[order], bound[order]
            starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
            place = np.arange(len(item)) - np.repeat(starts, np.diff(np.append(starts, len(item))))
            few = place < best
            return item[few], row[few], bound[few]

        def batch_of(found):
            return pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["item", "row", "bound"])

        for batch in batches:
            grp, part, kind, queries, rows, sizes, width, slices = (
                _column(batch, c) for c in ("grp", "part", "kind", "queries", "rows", "sizes", "width", "slices"))
            for i in range(batch.num_rows):
                key = grp[i].as_py(), part[i].as_py()
                if kind[i].as_py() == 0:
                    if kept:
                        yield batch_of(top())
                    now, kept = key, []
                    items, floors, slabs = _group(queries[i].as_py())
                    continue
                if key != now:
                    continue  # a group without queries
                numbers = np.array(rows[i].as_py(), np.int64)
                bounds = _bounds(items, slabs, numbers, sizes[i].as_py(), width[i].as_py(), slices[i].as_py(), docs, length)
                q, d = np.nonzero((bounds >= floors[:, None]) & (bounds > 0))
                if not len(q):
                    continue
                found = items[q], numbers[d], bounds[q, d]
                if not best:
                    yield batch_of(found)
                    continue
                kept.append(found)
                if sum(len(f[0]) for f in kept) > 4 * best * len(items):
                    kept = [top()]
                    full = np.flatnonzero(np.bincount(np.searchsorted(np.sort(items), kept[0][0]), minlength=len(items)) == best)
                    for n in np.argsort(items)[full]:
                        floors[n] = max(floors[n], kept[0][2][kept[0][0] == items[n]].min())
        if kept:
            yield batch_of(top())

    return run


def _pass(index, queries, best=None):
    """(item, row, bound) of the documents whose bound reaches the query's `least`."""
    groups = queries.groupBy("grp").agg(F.collect_list(F.struct("item", "least", "hashes", "weights")).alias("queries"))
    parts = max(1, -(-index.count // BLOCKS))
    every = [row.grp for row in queries.select("grp").distinct().collect()]  # numbers of groups of QUERIES
    nothing = F.lit(None)
    lists, blank = nothing.cast("array<long>"), nothing.cast("binary")
    first = groups.select(
        "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(0).alias("kind"),
        "queries", lists.alias("rows"), lists.alias("sizes"), nothing.cast("long").alias("width"), blank.alias("slices"))
    then = index.blocks.select(
        F.explode(F.array(*[F.lit(g) for g in every]).cast("array<long>")).alias("grp"), F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"),
        F.lit(1).alias("kind"), nothing.cast(groups.schema["queries"].dataType).alias("queries"), "rows", "sizes", "width", "slices")
    stream = first.unionByName(then).repartition("grp", "part").sortWithinPartitions("grp", "part", "kind")
    return stream.mapInArrow(_passing(index.n, index.length, best), "item long, row long, bound double")


def _exact(docs, length):
    """Exact scores of (row, id, text, wanted queries)."""
    def run(batches):
        for batch in batches:
            out = []
            for row, text, wanted in zip(_column(batch, "row").to_pylist(), _column(batch, "text"), _column(batch, "wanted")):
                words = terms(text.as_py())
                counts, n = Counter(words), len(words)
                for query in wanted.as_py():
                    score = 0
                    for term, weight in zip(query["terms"], query["weights"]):
                        tf = counts.get(term)
                        if tf:
                            score += weight * worth(tf, n, docs, length)
                    if score > 0:
                        out.append((query["item"], row, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["item", "row", "score"])

    return run


def _scored(index, queries, pairs):
    """Exact scores above 0 of stored (item, row) pairs, from the whole texts of just those rows."""
    # Stored, so that the join knows how few the rows are and leaves the other texts where they lie.
    asked = store(pairs.select("row").distinct(), "asked")
    texts = index.docs.join(asked, "row", "left_semi").select("row", "text")
    wanted = pairs.select("item", "row").join(queries, "item").groupBy("row", "grp").agg(
        F.collect_list(F.struct("item", "terms", "weights")).alias("wanted"))
    return texts.join(wanted, "row").select("row", "text", "wanted").mapInArrow(
        _exact(index.n, index.length), "item long, row long, score long")


def _best(scored, k, *order):
    place = F.row_number().over(Window.partitionBy("item").orderBy(*order)).alias("rank")
    return scored.select("*", place).where(F.col("rank") <= k)


def search(index, items, k=K, id_col="item_id", text_col="text"):
    """Rows (item_id, rank, id, score): each query's k best documents with a score above 0."""
    items = _rows(items, id_col, text_col, "items")
    if not index.n:
        return items.join(index.docs.select("row", F.col("id").alias("doc")), "row").where("false").select(
            F.col("id").alias("item_id"), F.lit(0).alias("rank"), F.col("doc").alias("id"), F.lit(0).cast("long").alias("score"))
    queries = _weighted(index, items)
    first = _pass(index, queries.withColumn("least", F.lit(0.0)), SEEDS * k)
    seeds = store(_best(first, SEEDS * k, F.desc("bound"), "row"), "seeds")
    floors = _best(_scored(index, queries, seeds), k, F.desc("score"), "row").groupBy("item").agg(
        F.when(F.count("*") == k, F.min("score")).otherwise(1).cast("double").alias("least"))
    open_queries = store(queries.join(floors, "item"), "floors")
    pairs = store(_pass(index, open_queries).select("item", "row"), "open")
    scored = store(_scored(index, queries, pairs), "scored")
    named = scored.join(index.docs.select("row", "id"), "row")
    best = _best(named, k, F.desc("score"), F.asc_nulls_last("id"), "row")
    return best.join(items.select(F.col("row").alias("item"), F.col("id").alias("item_id")), "item").select(
        "item_id", "rank", "id", "score")
