"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors of unit length are turned into the axes of the largest variance (one pass over
the data gives the d x d moments; d is fixed, so this is bounded). Within a label they are
ordered by the first axis and cut into tiles. Two tiles are compared only if their ranges
on the first axis are near enough: vectors with cosine c are sqrt(2 - 2c) apart, on every
axis at most. In a pair of tiles products are added axis by axis in blocks; after each
block the rest of a product is bounded by the product of the two suffix norms, and pairs
that cannot reach the threshold any more are left. The last decision is the cosine of
the given vectors in double precision.

Equal vectors are one vertex with a number of copies. A pair of tiles gives the number of
links of each of its vectors and a spanning forest of them, never its links one by one.

Defined cases: null or empty vectors, vectors that are zero or hold a null, a NaN or an
infinity, and vectors without a label link with nothing and are kept; vectors of different
lengths never link; repeated rows link as copies; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm.components import components
from aerolith.session import store

THRESHOLD = 0.93
#: Vectors of a tile; most of the comparison's memory is two tiles and their products.
TILE = 1024
#: Axes added before a bound is tried again.
STEP = 16
#: What rounding may change in a bound; the last decision is exact.
SLACK = 1e-6


def _moments(batches):
    """Sums of outer products per vector length, one row for each partition and length."""
    sums = {}
    for batch in batches:
        by_size = {}
        for v in batch.column(batch.schema.get_field_index("u")).to_pylist():
            by_size.setdefault(len(v), []).append(v)
        for size, rows in by_size.items():
            x = np.array(rows)
            sums[size] = sums.get(size, 0) + x.T @ x
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))],
            names=["size", "m"])


def axes(units):
    """{length: matrix whose columns are the axes, widest first}. One matrix per vector length."""
    parts = units.select("u").mapInArrow(_moments, "size long, m array<double>")
    flat = parts.select("size", F.posexplode("m").alias("at", "x")).groupBy("size", "at").agg(F.sum("x").alias("x"))
    sums = {}
    for row in flat.collect():
        sums.setdefault(row["size"], {})[row["at"]] = row["x"]
    found = {}
    for size, cells in sums.items():
        matrix = np.array([cells[i] for i in range(size * size)]).reshape(size, size)
        _, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
        found[size] = np.ascontiguousarray(vectors[:, ::-1])
    return found


def _unit(v):
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _first_axis(turn):
    """The position of each vector on the axis of the largest variance."""
    def run(batches):
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("v")).to_pylist()
            first = np.empty(len(vectors))
            by_size = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            for size, rows in by_size.items():
                first[rows] = _unit(np.array([vectors[i] for i in rows])) @ turn[size][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], names=[*batch.schema.names, "first"])

    return run


class _Sets:
    """Union of vertices within a pair of tiles."""

    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def linked(t1, v1, t2, v2, threshold, same):
    """Index pairs (i, j) with cosine of v1[i], v2[j] at least threshold; i < j if both are one tile.

    t1 and t2 are the unit vectors in the order of the axes, v1 and v2 the given ones.
    """
    size = t1.shape[1]
    rest1 = np.sqrt(np.maximum(0, np.cumsum((t1 * t1)[:, ::-1], axis=1)[:, ::-1]))
    rest2 = np.sqrt(np.maximum(0, np.cumsum((t2 * t2)[:, ::-1], axis=1)[:, ::-1]))
    out_i, out_j = [], []
    for start in range(0, len(t1), 128):
        rows = slice(start, start + 128)
        lead = min(STEP, size)
        products = t1[rows, :lead] @ t2[:, :lead].T
        left = threshold - SLACK
        if lead < size:
            possible = products + rest1[rows, lead, None] * rest2[None, :, lead] >= left
        else:
            possible = products >= left
        if same:
            possible &= np.arange(start, start + len(products))[:, None] < np.arange(len(t2))[None, :]
        i, j = np.nonzero(possible)
        sums = products[i, j]
        i = i + start
        at = lead
        while at < size and len(i):
            end = min(at + STEP, size)
            sums = sums + np.einsum("ij,ij->i", t1[i, at:end], t2[j, at:end])
            stays = sums + (rest1[i, end] * rest2[j, end] if end < size else 0) >= left
            i, j, sums, at = i[stays], j[stays], sums[stays], end
        # The given vectors decide.
        for a in range(0, len(i), 1 << 16):
            part = slice(a, a + (1 << 16))
            x, y = v1[i[part]], v2[j[part]]
            cosine = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
            good = cosine >= threshold
            out_i.append(i[part][good])
            out_j.append(j[part][good])
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *out_i]), np.concatenate([empty, *out_j])


def _compare(threshold, turn):
    """Compare the two tiles of each group of a stream sorted by (pair, side)."""
    def close(vertex, copies, sides, v):
        t = _unit(v) @ turn[v.shape[1]]
        one = sides == 0
        same = not (~one).any()
        a = np.flatnonzero(one)
        b = a if same else np.flatnonzero(~one)
        if not len(a) or not len(b):
            return
        i, j = linked(t[a], v[a], t[b], v[b], threshold, same)
        if not len(i):
            return
        i, j = a[i], b[j]
        links = np.bincount(i, copies[j], len(vertex)) + np.bincount(j, copies[i], len(vertex))
        sets, tree = _Sets(len(vertex)), []
        # Each component takes one link to another, until no link leads from one to another.
        while len(i):
            roots = np.fromiter(map(sets.find, range(len(vertex))), np.int64, len(vertex))
            apart = roots[i] != roots[j]
            i, j = i[apart], j[apart]
            if not len(i):
                break
            _, first = np.unique(roots[i], return_index=True)
            for x, y in zip(i[first].tolist(), j[first].tolist()):
                if sets.join(x, y):
                    tree.append((x, y))
        seen = np.flatnonzero(links)
        ends = np.array(tree, np.int64).reshape(-1, 2)
        none = np.zeros(len(ends), np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([vertex[seen], vertex[ends[:, 0]]])),
            pa.array(np.concatenate([links[seen].astype(np.int64), none])),
            pa.array(np.concatenate([vertex[seen], vertex[ends[:, 1]]]))], names=["a", "links", "b"])

    def run(batches):
        held, pair = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, vertex, copies, side, v = (batch.column(batch.schema.get_field_index(n)) for n in ("pair", "vertex", "copies", "side", "v"))
            key, vertex, copies, side = key.to_numpy(), vertex.to_numpy(), copies.to_numpy(), side.to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and key[lo] != pair:
                    yield from close(*map(np.concatenate, zip(*held)))
                    held = []
                pair = key[lo]
                given = v.slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1)
                held.append((vertex[lo:hi], copies[lo:hi], side[lo:hi], given))
        if held:
            yield from close(*map(np.concatenate, zip(*held)))

    return run


def near_duplicates(vectors, id_col="vec_id", vector_col="embedding", label_col="label", threshold=THRESHOLD):
    """Rows (id, n_links, component_id, kept), one per input row.

    label_col names the group that a comparison stays in; rows without one link with nothing.
    """
    rows = store(vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")), "vectors")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # A vector too small or large to be squared is scaled first; the cosine does not change.
    largest = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    usable = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~odd)
    usable = usable.withColumn("largest", largest).where("largest > 0")
    unit = F.when((F.col("largest") > 1e100) | (F.col("largest") < 1e-100), F.transform("v", lambda x: x / F.col("largest"))).otherwise(F.col("v"))
    usable = usable.withColumn("v", F.transform(unit, lambda x: x + F.lit(0.0)))
    # Copies of a vector are one vertex; rows find it by label and vector.
    firsts = store(usable.groupBy("label", "v").agg(
        F.count("*").alias("copies"), F.min("row").alias("vertex"), F.min("id").alias("least")), "vertices")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    turn = axes(firsts.select("v", norm.alias("norm")).select(F.transform("v", lambda x: x / F.col("norm")).alias("u")))
    found = _tiles(firsts.select("label", F.size("v").cast("long").alias("size"), "vertex", "copies", "v"), turn, threshold)
    counted = found.where("a = b").groupBy(F.col("a").alias("vertex")).agg(F.sum("links").alias("others"))
    joined = components(found.where("a <> b").select("a", "b"))
    named = firsts.select("label", "v", "vertex", "copies", "least").join(counted, "vertex", "left").join(
        joined.withColumnRenamed("id", "vertex"), "vertex", "left").select(
        "label", "v", "copies", "least", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component_id", "vertex").alias("root"))
    named = store(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select(
        F.col("label").alias("l"), F.col("v").alias("w"), (F.col("others") + F.col("copies") - 1).alias("links"), "component_id")
    own = usable.select("row", "id", "label", "v")
    known = own.join(classes, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("row", "links", "component_id")
    return rows.select("row", "id").join(known, "row", "left").select(
        "id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("component_id")))


def _tiles(vertices, turn, threshold):
    """Stored rows (a, links, b): links of vertex a where a = b, else an edge of a forest."""
    # Position within the label: cells of the first axis are counted, then rows are numbered within their cell.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    cell = F.floor((F.col("first") + 1.0) * 256).cast("long")
    fine = vertices.mapInArrow(_first_axis(turn), T.StructType([*vertices.schema.fields, T.StructField("first", T.DoubleType())]))
    fine = fine.withColumn("cell", cell)
    sizes = fine.groupBy("label", "size", "cell").agg(F.count("*").alias("n"))
    parts = sizes.withColumn("parts", F.ceil(F.col("n") / TILE).cast("long"))
    # Neighbouring cells of few rows share a tile: the running count of rows, cut at every TILE.
    order = Window.partitionBy("label", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    parts = parts.withColumn("tile", F.when(F.col("n") >= TILE, F.col("cell") * 2 + 1).otherwise(
        F.lit(-1) - F.floor(F.col("before") / TILE)))
    parts = store(parts.select("label", "size", "cell", "tile", "parts"), "cells")
    placed = fine.join(parts, ["label", "size", "cell"]).withColumn(
        "part", F.when(F.col("tile") < 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("vertex"), F.col("parts"))).cast("long"))
    placed = store(placed.drop("cell", "parts"), "placed")
    tiles = store(placed.groupBy("label", "size", "tile", "part").agg(F.min("first").alias("lo"), F.max("first").alias("hi")), "tiles")
    name = F.struct("tile", "part")
    one = tiles.select("label", "size", name.alias("x"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    two = tiles.select("label", "size", name.alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = one.join(two, ["label", "size"]).where(
        (F.col("x") <= F.col("y")) & (F.col("lo2") <= F.col("hi1") + reach) & (F.col("lo1") <= F.col("hi2") + reach))
    pairs = store(pairs.select(F.monotonically_increasing_id().alias("pair"), "label", "size", "x", "y"), "tile-pairs")
    sides = pairs.select("pair", "label", "size", F.col("x.*"), F.lit(0).alias("side")).unionByName(
        pairs.where("x <> y").select("pair", "label", "size", F.col("y.*"), F.lit(1).alias("side")))
    moved = placed.join(sides, ["label", "size", "tile", "part"]).select("pair", "side", "vertex", "copies", "v")
    compared = moved.repartition("pair").sortWithinPartitions("pair", "side", "vertex").mapInArrow(
        _compare(threshold, turn), "a long, links long, b long")
    return store(compared, "compared")
