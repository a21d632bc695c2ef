"""Sampled Shapley values: paired walks through feature orders, scored inside Arrow batches.

A fitted pipeline is read into arrays once (its size is that of the model) and evaluated with
numpy where the rows are. A row's walks start at training rows drawn by number from all of them.
Only the row's summed values leave the task, so no row of a walk is ever laid out or shuffled.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import functions as F

from aerolith import session
from aerolith.operators.series import KEY, TS

#: Rows whose walks are scored at once.
SLAB = 32
_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")


class Trees:
    """An ensemble as flat node arrays; a leaf is its own child."""

    def __init__(self, model):
        weights = np.array(model.treeWeights, float)
        if isinstance(model, RandomForestRegressionModel):
            weights = weights / len(weights)
        self.weights, self.roots, nodes = weights, [], []
        lines = [line.strip() for line in model.toDebugString.splitlines() if line.strip().startswith(("If", "Predict"))]
        at = 0

        def grow(depth):
            nonlocal at
            line, mine = lines[at], len(nodes)
            at += 1
            split = _SPLIT.match(line)
            if not split:
                nodes.append([0, np.inf, mine, mine, float(line.split(":")[1])])
                return depth
            nodes.append([int(split[1]), float(split[2]), mine + 1, None, 0.0])
            deepest = grow(depth + 1)
            nodes[mine][3] = len(nodes)
            return max(deepest, grow(depth + 1))

        self.depth = 0
        for _ in weights:
            self.roots.append(len(nodes))
            self.depth = max(self.depth, grow(0))
        feature, threshold, left, right, value = zip(*nodes)
        self.feature, self.left, self.right = (np.array(c, np.int32) for c in (feature, left, right))
        self.threshold, self.value = np.array(threshold), np.array(value)

    def __call__(self, x):
        at = np.broadcast_to(np.array(self.roots, np.int32), (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.value[at] @ self.weights


class Linear:
    def __init__(self, model):
        self.slopes, self.bias = model.coefficients.toArray(), float(model.intercept)

    def __call__(self, x):
        return x @ self.slopes + self.bias


class Compiled:
    """A pipeline of this engine as one function of raw rows; a missing input is NaN."""

    def __init__(self, model):
        from aerolith.operators.models import FourierFeatures

        scaler, *middle, last = model.stages
        self.centre, self.scale, self.fill = (np.array(scaler.getOrDefault(p)) for p in (scaler.centre, scaler.scale, scaler.fill))
        self.steps = [s.frequencies() for s in middle if isinstance(s, FourierFeatures)]
        if isinstance(last, LinearRegressionModel):
            self.last = Linear(last)
        elif isinstance(last, (RandomForestRegressionModel, GBTRegressionModel)):
            self.last = Trees(last)
        else:
            raise TypeError(f"no vectorised form of {type(last).__name__}")

    def __call__(self, x):
        x = (np.where(np.isnan(x), self.fill, x) - self.centre) / self.scale
        for frequencies, phases in self.steps:
            x = np.sqrt(2.0 / len(phases)) * np.cos(x @ frequencies + phases)
        return self.last(x)


def values_of(columns):
    """The columns as one array, NaN where missing."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])


class Reference:
    """Training rows under gapless numbers: (number, values), and how many there are."""

    def __init__(self, df, columns):
        rows = session.store(df.select(F.monotonically_increasing_id().alias("_at"), values_of(columns).alias("values")), "reference")
        task = F.shiftright("_at", 33)
        counts = sorted(rows.groupBy(task.alias("t")).count().collect())  # one a task of the write
        self.count, starts = 0, []
        for t, n in counts:
            starts.append((t, self.count))
            self.count += n
        if not self.count:
            raise ValueError("no training row to start a walk from")
        offsets = df.sparkSession.createDataFrame(starts, "_t long, _start long")
        self.rows = rows.join(offsets, task == F.col("_t")).select(
            (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("number"), "values")


def _mix(h):
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _orders(hashes, walk, size):
    """A feature order per row, from the row's hash."""
    draws = _mix(hashes[:, None] + np.uint64(walk) * np.uint64(0x9E3779B97F4A7C15)
                 + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return np.argsort(draws, axis=1, kind="stable")


def _walk(predict, x, start, order):
    """Shares of the features when they join in the given order; and the prediction at the start."""
    rows, size = x.shape
    rank = np.argsort(order, axis=1)
    joined = rank[:, None, :] < np.arange(size + 1)[None, :, None]
    states = np.where(joined, x[:, None, :], start[:, None, :])
    f = predict(states.reshape(-1, size)).reshape(rows, size + 1)
    return np.take_along_axis(np.diff(f, axis=1), rank, axis=1), f[:, 0]


def _explained(predict, size, keys):
    def run(batches):
        for batch in batches:
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            hashes = column["_h"].to_numpy().view(np.uint64)
            x = np.array(column["_x"].to_pylist(), float).reshape(-1, size)
            starts = np.array(column["_starts"].to_pylist(), float).reshape(len(x), -1, size)
            shares, base = np.zeros(x.shape), np.zeros(len(x))
            for a in range(0, len(x), SLAB):
                part = slice(a, a + SLAB)
                for pair in range(starts.shape[1]):
                    order = _orders(hashes[part], pair, size)
                    for way in (order, order[:, ::-1]):
                        share, first = _walk(predict, x[part], starts[part, pair], way)
                        shares[part] += share
                        base[part] += first
            walks = 2 * max(1, starts.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*[column[k] for k in keys], pa.array(base / walks), pa.array(list(shares / walks), pa.list_(pa.float64()))],
                names=[*keys, "base", "_values"])

    return run


def sampled(model, df, columns, reference, samples=100, key=KEY, ts=TS):
    """Sampled Shapley values of any pipeline (Castro, Gomez and Tejada, 2009), long: key, time, feature, value, base.

    A walk goes from a training row to the explained one; the change in prediction when a feature joins is its share. Walks
    come in pairs: an order and its reverse from one start, which halves the error for near-additive models. Starts and orders
    follow from a hash of the key, so a repeated task repeats its numbers. Values add up to prediction minus base.
    """
    pairs = max(1, samples // 2)
    rows = session.store(df.select(key, ts, F.xxhash64(key, ts).alias("_h"), values_of(columns).alias("_x")), "explained-rows")
    draws = rows.select(key, ts, F.explode(F.sequence(F.lit(1), F.lit(pairs))).alias("_s")).withColumn(
        "number", F.pmod(F.xxhash64(key, ts, "_s"), F.lit(reference.count)))
    starts = draws.join(reference.rows, "number").groupBy(key, ts).agg(
        F.array_sort(F.collect_list(F.struct("_s", "values"))).alias("_starts"))
    ready = rows.join(starts, [key, ts]).select(key, ts, "_h", "_x", F.col("_starts.values").alias("_starts"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shape = f"{key} {kinds[key]}, {ts} {kinds[ts]}, base double, _values array<double>"
    found = ready.mapInArrow(_explained(Compiled(model), len(columns), (key, ts)), shape)
    names = F.array(*[F.lit(c) for c in columns])
    return found.select(key, ts, "base", F.posexplode("_values").alias("_j", "value")).select(
        key, ts, F.get(names, F.col("_j")).alias("feature"), "value", "base")
