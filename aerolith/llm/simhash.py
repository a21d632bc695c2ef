"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint is cut into segments of 23 bits. The binary Golay code is perfect: every 23-bit
word is within 3 bits of exactly one codeword, and a word has either one or six codewords
within 4 bits. Two segments that differ in at most 2 bits have one of these in common, so
the 12-bit indices of the nearby codewords are keys that survive bit errors. Candidates
share a key; their whole fingerprints are then compared.

Two ways of keying:
- exact(): 64 bits, distance at most 2, nothing lost. By the pigeonhole principle one of the
  segments of 23, 23 and 18 bits has no error, and the others have 2 at most; a key joins
  the error-free segment with a codeword of another one.
- banded(): 184 bits of the set of words, for a shingle similarity of 0.8 and more. A key
  joins a codeword of a segment with eight bits of the next one. Pairs are verified on the texts.

Words alone do not tell which texts have common shingles, so near_duplicates() also takes the keys
of shingled(): each joins the least of DEPTH hash orders of the shingles, which two texts of
similarity J have in common with probability J^DEPTH whatever was edited. One of TURNS such keys
is shared by all but (1 - J^DEPTH)^TURNS of the pairs, 1 in 97,000 at 0.8. Members of a key are
first verified against its two ends; where they are of several classes after that, the texts of
the group meet in one task and every pair of two classes is verified there (across()).

Crowded keys are cut into blocks and every pair of blocks is one group, so no group has
more than two blocks of rows; a group of near() larger than ALL_PAIRS gives a spanning forest, not
its pairs, and near_duplicates() relies on shingled() for the pairs that the forest stands for.

Defined cases: a null text is empty; a text without words has fingerprint zero; a text of
fewer words than a shingle is one shingle; repeated rows have one fingerprint; null
identifiers are kept and count as larger than any other; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from aerolith.llm.components import components
from aerolith.llm.exact import keep_rows
from aerolith.session import store

SEED = 42
BASE = 0x9E3779B97F4A7C15
SEGMENT = 23
BANDS, BAND_BITS, MOST_BITS = 8, 8, 42
SIMILARITY = 0.8
SHINGLE = 5
BLOCK = 4096
ALL_PAIRS = 32
#: Keys of a text's shingles, and the hash orders that each joins; texts of a block whose shingles are compared.
TURNS, DEPTH = 16, 3
TEXT_BLOCK = 1024
#: Generator polynomial of the binary Golay code [23, 12, 7].
GENERATOR = 0b110001110101


def _syndromes(words):
    """Remainders of 23-bit words modulo the generator."""
    words = words.astype(np.int64).copy()
    for bit in range(SEGMENT - 1, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


def _decoder():
    """Error pattern of each syndrome: the 2048 patterns of up to 3 bits, one each."""
    bits = np.int64(1) << np.arange(SEGMENT, dtype=np.int64)
    one, two = bits, [bits[i] | bits[j] for i in range(SEGMENT) for j in range(i)]
    three = [bits[i] | bits[j] | bits[k] for i in range(SEGMENT) for j in range(i) for k in range(j)]
    errors = np.array([0, *one, *two, *three], np.int64)
    table = np.empty(1 << 11, np.int64)
    table[_syndromes(errors)] = errors
    return table


_TABLES = []


def _tables():
    if not _TABLES:
        low, high = np.arange(1 << 12), np.arange(1 << 11) << 12
        _TABLES.extend((_syndromes(low), _syndromes(high), _decoder()))
    return _TABLES


def nearest(words):
    """Index of the only codeword within 3 bits of each 23-bit word."""
    low, high, errors = _tables()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def codewords(words):
    """Indices of all codewords within 4 bits, as (position in words, index): one or six each."""
    flips = np.concatenate([[0], np.int64(1) << np.arange(SEGMENT, dtype=np.int64)])
    found = np.sort(nearest(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    at, column = np.nonzero(new)
    return at, found[at, column]


# Fingerprints

def _votes(hashes, width):
    """Number of set bits per position over 64-bit hashes of shape (n, width)."""
    total = np.zeros(64 * width, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[start:start + (1 << 14)])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return total


def _majority(hashes, width=1):
    """Words of 64 bits, a bit set where it is set in over half of the hashes."""
    if not len(hashes):
        return np.zeros(width, np.int64)
    set_bits = (_votes(hashes, width) * 2 > len(hashes)).astype(np.uint8)
    return np.packbits(set_bits, bitorder="little").view("<u8").astype(np.uint64).view(np.int64)


def shingle_hashes(data, size, seed=SEED):
    """XXH64 of every shingle of a text in bytes, repeats included."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:len(words) - size + 1].tolist()
    stops = (ends[size - 1:] - 1).tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))


def _word_hashes(data):
    """192 bits per distinct word."""
    words = set(data.lower().split())
    hashes = np.empty((len(words), 3), np.uint64)
    for k, word in enumerate(words):
        wide = xxhash.xxh3_128_intdigest(word, SEED)
        hashes[k] = wide & 0xFFFFFFFFFFFFFFFF, wide >> 64, xxhash.xxh64_intdigest(word, SEED)
    return hashes


def _fingerprints(make):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            prints = np.array([make(text.as_py()) for text in texts], np.int64).reshape(batch.num_rows, 3)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("row", "id", "hash")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(prints[:, k]) for k in range(3))],
                                             names=["row", "id", "hash", "w0", "w1", "w2"])

    return run


def _shingled(size):
    return lambda data: (_majority(shingle_hashes(data, size))[0], 0, 0)


def _worded(data):
    return _majority(_word_hashes(data), 3)


def fingerprints(docs, id_col="doc_id", text_col="text", shingle=None):
    """Stored rows (row, id, hash, w0, w1, w2): 64 bits of the shingles, or 192 of the words if shingle is None."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                       F.xxhash64(text).alias("hash"), text.cast("binary").alias("text"))
    make = _shingled(shingle) if shingle else _worded
    return store(rows.mapInArrow(_fingerprints(make), "row long, id long, hash long, w0 long, w1 long, w2 long"), "fingerprints")


# Keys

def exact(prints):
    """Keys of 64-bit fingerprints: (position, key). Loses no pair within 2 bits."""
    word = prints[:, 0].view(np.uint64)
    a, b = (word & 0x7FFFFF).astype(np.int64), (word >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (word >> np.uint64(46)).astype(np.int64)
    at_a, near_a = codewords(a)
    at_b, near_b = codewords(b)
    return (np.concatenate([at_b, at_a, at_a]),
            np.concatenate([a[at_b] << 12 | near_b, 1 << 36 | b[at_a] << 12 | near_a, 2 << 36 | c[at_a] << 12 | near_a]))


def banded(prints):
    """Keys of 184 bits: a codeword of each segment with some bits of the next."""
    segments = []
    for band in range(BANDS):
        word, shift = divmod(band * SEGMENT, 64)
        value = prints[:, word].view(np.uint64) >> np.uint64(shift)
        if shift > 64 - SEGMENT:
            value = value | prints[:, word + 1].view(np.uint64) << np.uint64(64 - shift)
        segments.append((value & np.uint64(0x7FFFFF)).astype(np.int64))
    positions, keys = [], []
    for band in range(BANDS):
        at, near = codewords(segments[band])
        positions.append(at)
        keys.append((band << BAND_BITS | segments[(band + 1) % BANDS][at] & (1 << BAND_BITS) - 1) << 12 | near)
    return np.concatenate(positions), np.concatenate(keys)


def _read(batch):
    prints = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("w0", "w1", "w2")], axis=1)
    return batch.column(batch.schema.get_field_index("vertex")).to_numpy(), prints


def _key_rows(keying, whole):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                vertex, prints = _read(batch.slice(start, 2048))
                at, keys = keying(prints)
                columns = [pa.array(keys)]
                if whole:
                    columns += [pa.array(vertex[at]), *(pa.array(prints[at, k]) for k in range(3))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "vertex", "w0", "w1", "w2"][:len(columns)])

    return run


# Comparison within a key

def _distance(a, b):
    # Counted as unsigned: of a negative number the bits of its absolute value would be counted.
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _forest(vertex, prints, side, most):
    """Closest links that span a large group: each component takes its nearest outside link until none is left."""
    n = len(vertex)
    label = np.arange(n)
    out = []
    while True:
        best, partner = np.full(n, most + 1), np.full(n, -1)
        for start in range(0, n, 256):
            part = slice(start, min(n, start + 256))
            apart = _distance(prints[part, None, :], prints[None, :, :])
            apart[label[part, None] == label[None, :]] = most + 1
            if side is not None:
                apart[side[part, None] == side[None, :]] = most + 1
            nearest_one = apart.argmin(axis=1)
            best[part], partner[part] = apart[np.arange(len(nearest_one)), nearest_one], nearest_one
        joined = False
        for i in np.argsort(best, kind="stable"):
            if best[i] > most:
                break
            a, b = label[i], label[partner[i]]
            if a != b:
                label[label == max(a, b)] = min(a, b)
                out.append((vertex[i], vertex[partner[i]]))
                joined = True
        if not joined:
            return out


def _links(most):
    """Links of a stream that is sorted by group; groups go on over the ends of batches."""
    def close(key, vertex, prints, lo, hi, own):
        """Links of whole groups: small ones by shifted comparison of all at once, large ones as a forest."""
        new = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        group = np.cumsum(new) - 1
        small = sizes[group] <= ALL_PAIRS
        first, second = [], []
        for lag in range(1, min(ALL_PAIRS, sizes.max())):
            i = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
            if not len(i):
                break
            i = i[_distance(prints[i], prints[i + lag]) <= most]
            first.append(vertex[i])
            second.append(vertex[i + lag])
        for start, size in zip(starts[sizes > ALL_PAIRS], sizes[sizes > ALL_PAIRS]):
            rows = slice(start, start + size)
            # Between two blocks only links from one to the other are new.
            side = None if lo[start] == hi[start] else own[rows]
            pairs = _forest(vertex[rows], prints[rows], side, most)
            if pairs:
                a, b = zip(*pairs)
                first.append(np.array(a))
                second.append(np.array(b))
        a, b = np.concatenate([np.empty(0, np.int64), *first]), np.concatenate([np.empty(0, np.int64), *second])
        keep = a != b
        pairs = np.unique(np.stack([np.maximum(a, b)[keep], np.minimum(a, b)[keep]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            vertex, prints = _read(batch)
            parts = [vertex, prints, *(batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("key", "lo", "hi", "own"))]
            if held is not None:
                parts = [np.concatenate(pair) for pair in zip(held, parts)]
            vertex, prints, key, lo, hi, own = parts
            mixed = np.stack([key, lo, hi], axis=1)
            last = len(key) - 1 - np.argmin((mixed[::-1] == mixed[-1]).all(axis=1)) if (mixed != mixed[-1]).any() else -1
            if last >= 0:
                cut = last + 1
                groups = np.append(0, np.cumsum((mixed[1:cut] != mixed[:cut - 1]).any(axis=1)))
                yield close(groups, *(p[:cut] for p in (vertex, prints, lo, hi, own)))
                parts = [p[cut:] for p in parts]
            held = parts
        if held is not None:
            vertex, prints, key, lo, hi, own = held
            yield close(np.zeros(len(key), np.int64), vertex, prints, lo, hi, own)

    return run


def near(vertices, keying, most):
    """Distinct links (a, b), a > b, of rows (vertex, w0, w1, w2) that share a key and differ in at most `most` bits.

    Small groups give every link, large ones a spanning forest of the closest.
    """
    given = vertices.select("vertex", "w0", "w1", "w2")
    crowded = store(given.mapInArrow(_key_rows(keying, False), "key long").groupBy("key").count().where(
        F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks")), "crowded")
    rows = given.mapInArrow(_key_rows(keying, True), "key long, vertex long, w0 long, w1 long, w2 long")
    if crowded.isEmpty():
        zero = F.lit(0).cast("long")
        rows = rows.withColumns({"own": zero, "lo": zero, "hi": zero})
    else:
        rows = rows.join(crowded, "key", "left").withColumn(
            "own", F.coalesce(F.pmod(F.xxhash64("vertex"), F.col("blocks")), F.lit(0).cast("long")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
        rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("blocks", "other")
    grouped = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "vertex")
    return grouped.mapInArrow(_links(most), "a long, b long").distinct()


# The operators

def classes(docs, id_col="doc_id", text_col="text", shingle=3, most=2):
    """Rows (row, id, fingerprint, component_id): classes of 64-bit fingerprints that link within `most` (at most 2) bits."""
    if most > 2:
        raise ValueError("the keys lose no pair up to 2 bits")
    rows = fingerprints(docs, id_col, text_col, shingle)
    distinct = rows.groupBy("w0").agg(F.min("id").alias("least"))
    vertices = distinct.select(F.col("w0").alias("vertex"), "w0", F.lit(0).cast("long").alias("w1"), F.lit(0).cast("long").alias("w2"))
    found = components(near(vertices, exact, most))
    named = distinct.join(found, distinct["w0"] == found["id"], "left").select(
        "w0", "least", F.coalesce("component_id", "w0").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = named.select("w0", "root").join(least, "root").select("w0", "component_id")
    return rows.join(answer, "w0").select("row", "id", F.col("w0").alias("fingerprint"), "component_id")


def _similar(size, least):
    """Keep the links whose shingle sets have a Jaccard similarity of at least `least`."""
    def run(batches):
        for batch in batches:
            a, b, s, t = (batch.column(batch.schema.get_field_index(n)) for n in ("a", "b", "s", "t"))
            good = []
            for i in range(batch.num_rows):
                left, right = (np.unique(shingle_hashes(c[i].as_py(), size)) for c in (s, t))
                both = len(np.intersect1d(left, right, assume_unique=True))
                union = len(left) + len(right) - both
                good.append(not union or both >= least * union)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def shingled(size):
    """TURNS keys a text: the least shingles by DEPTH hash orders each. Texts without shingles have the same ones."""
    draw = np.random.default_rng(SEED)
    odd, turn = draw.integers(0, 1 << 63, (2, TURNS * DEPTH, 1), dtype=np.uint64)
    odd = odd * np.uint64(2) + np.uint64(1)

    def keys(data):
        hashes = np.unique(shingle_hashes(data, size))
        least = np.full(TURNS * DEPTH, np.iinfo(np.uint64).max)
        for start in range(0, len(hashes), 1 << 12):
            mixed = (hashes[start:start + (1 << 12)] ^ turn) * odd
            mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(BASE)
            least = np.minimum(least, (mixed ^ mixed >> np.uint64(29)).min(axis=1))
        least = least.reshape(TURNS, DEPTH)
        joined = np.arange(1, TURNS + 1, dtype=np.uint64)
        for k in range(DEPTH):
            joined = (joined ^ least[:, k]) * np.uint64(BASE)
            joined ^= joined >> np.uint64(31)
        return joined.view(np.int64)

    def run(batches):
        for batch in batches:
            vertex, texts = (batch.column(batch.schema.get_field_index(n)) for n in ("vertex", "text"))
            found = [keys(text.as_py()) for text in texts]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), pa.array(np.repeat(vertex.to_numpy(), TURNS))], names=["key", "vertex"])

    return run


def across(sets, label, side, least):
    """Links (i, j) of similar shingle sets of two classes, until no pair of two classes is unverified.

    Of a pair of two classes one is not of the largest, so only the others are compared with all.
    """
    label, n = label.copy(), len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owners, known = np.repeat(np.arange(n), sizes)[order], every[order]
    names, counts = np.unique(label, return_counts=True)
    out = []
    for i in np.flatnonzero(label != names[counts.argmax()]):
        starts, ends = np.searchsorted(known, sets[i]), np.searchsorted(known, sets[i], "right")
        spans = ends - starts
        flat = np.repeat(starts - np.append(0, np.cumsum(spans)[:-1]), spans) + np.arange(spans.sum()) if len(spans) else []
        both = np.bincount(owners[flat], minlength=n) if len(flat) else np.zeros(n, np.int64)
        good = (both >= least * (sizes + sizes[i] - both)) & (label != label[i])
        if side is not None:
            good &= side != side[i]
        for j in np.flatnonzero(good):
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _across(size, least):
    """Links inside the groups of a sorted stream; a group goes on over the ends of batches."""
    def close(vertex, own, label, sets, lo, hi):
        # Between two blocks only links from one to the other are new.
        links = across(sets, np.array(label), None if lo == hi else np.array(own), least)
        a, b = ([vertex[pair[k]] for pair in links] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        group, held = None, ([], [], [], [])
        for batch in batches:
            names = ("key", "lo", "hi", "vertex", "own", "class", "text")
            key, lo, hi, vertex, own, label, text = (batch.column(batch.schema.get_field_index(n)) for n in names)
            for i, here in enumerate(zip(key.to_pylist(), lo.to_pylist(), hi.to_pylist())):
                if here != group:
                    if group is not None:
                        yield close(*held, *group[1:])
                    group, held = here, ([], [], [], [])
                for column, value in zip(held, (vertex[i].as_py(), own[i].as_py(), label[i].as_py(),
                                                np.unique(shingle_hashes(text[i].as_py(), size)))):
                    column.append(value)
        if group is not None:
            yield close(*held, *group[1:])

    return run


def near_duplicates(docs, id_col="doc_id", text_col="text", shingle=SHINGLE, similarity=SIMILARITY):
    """Rows (row, id, hash, root): root is the row of the smallest identifier of the class."""
    rows = fingerprints(docs, id_col, text_col)
    # Equal texts link to the first of them; only different texts are compared.
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("row"))
    firsts = store(rows.groupBy("hash").agg(F.min_by(F.struct("row", "id", "w0", "w1", "w2"), order).alias("f")).select(
        "hash", "f.*"), "texts")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # One text of each hash is enough, whichever row it comes from.
    given = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text).alias("hash"), text.cast("binary").alias("text"))

    def texts(rows):
        owners = rows.join(firsts.select("row", F.col("id").alias("i"), "hash"), "row")
        # A row that repeats identifier and text would double the pair; distinct links are taken after.
        return given.alias("t").join(owners.alias("o"), F.expr("t.hash = o.hash AND t.i <=> o.i")).select("o.row", "t.text")

    # Only keys of several texts go on; a text that is given twice has its keys once.
    keyed = store(texts(firsts.select("row")).withColumnRenamed("row", "vertex").mapInArrow(
        shingled(shingle), "key long, vertex long"), "keyed")
    ends_of = store(keyed.groupBy("key").agg(F.min("vertex").alias("low"), F.max("vertex").alias("high")).where("low < high"), "ends")
    members = store(keyed.join(ends_of, "key").distinct(), "members")
    v = F.col("vertex")
    stars = members.select(v.alias("a"), F.col("low").alias("b")).where("a > b").union(
        members.select(F.col("high").alias("a"), v.alias("b")).where("a > b"))
    pairs = store(near(firsts.withColumnRenamed("row", "vertex"), banded, MOST_BITS).union(stars).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct()
    needed = texts(ends)
    left = needed.select(F.col("row").alias("a"), F.col("text").alias("s"))
    right = needed.select(F.col("row").alias("b"), F.col("text").alias("t"))
    verified = store(pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(
        _similar(shingle, similarity), "a long, b long").distinct(), "verified")
    found = components(verified)
    # Groups of several classes: every pair of two of them is compared. Of two members the one pair is verified already.
    classed = members.join(found.withColumnRenamed("id", "v"), v == F.col("v"), "left").select(
        "key", "vertex", F.coalesce("component_id", "vertex").alias("class"))
    mixed = store(classed.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("x"), F.max("class").alias("y")).where(
        "n > 2 AND x < y").select("key", F.ceil(F.col("n") / TEXT_BLOCK).cast("long").alias("blocks")), "mixed")
    if not mixed.isEmpty():
        rows_in = store(classed.join(mixed, "key"), "open")
        rows_in = rows_in.withColumn("own", F.pmod(F.xxhash64("vertex"), F.col("blocks")))
        rows_in = rows_in.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows_in = rows_in.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        shown = texts(rows_in.select(v.alias("row")).distinct()).withColumnRenamed("row", "vertex")
        grouped = rows_in.join(shown, "vertex").select("key", "lo", "hi", "vertex", "own", "class", "text").repartition(
            "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "vertex")
        more = grouped.mapInArrow(_across(shingle, similarity), "a long, b long").distinct()
        found = components(verified.union(more))
    named = firsts.join(found.withColumnRenamed("id", "v"), firsts["row"] == F.col("v"), "left").select(
        "hash", "row", "id", F.coalesce("component_id", "row").alias("class"))
    roots = named.groupBy("class").agg(F.min_by("row", order).alias("root"))
    answer = named.select("hash", "class").join(roots, "class").select("hash", "root")
    return rows.select("row", "id", "hash").join(answer, "hash")


def deduplicate(docs, id_col="doc_id", text_col="text", shingle=SHINGLE, similarity=SIMILARITY):
    """The rows of docs that stay, one of each group of near copies: the smallest identifier."""
    found = near_duplicates(docs, id_col, text_col, shingle, similarity)
    unrepeated = found.groupBy("id", "hash").count().where("count > 1").isEmpty()
    kept = found.where("row = root").select("id", F.col("hash").alias("key"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return keep_rows(docs, kept, id_col, F.xxhash64(text), unrepeated)
