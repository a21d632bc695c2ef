"""Sums of products of columns, from which every linear model over them can be solved.

One pass gives each group of rows its matrix of sums over [1, columns, label]. A model over some of the
columns, or over some of the groups, then needs no further pass over the data: matrices add up.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Entries of all matrices a task may hold before it hands them on.
HELD = 4_000_000


def _products(names, by, width):
    def run(batches):
        held = {}

        def given():
            for group, matrix in held.items():
                upper = matrix[np.triu_indices(width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group] * len(upper), pa.string()), pa.array(np.arange(len(upper))), pa.array(upper)],
                    names=["_group", "_at", "_sum"])

        for batch in batches:
            x = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names], axis=1)
            x = np.hstack([np.ones((len(x), 1)), x.astype(float)])
            groups = np.array(batch.column(batch.schema.get_field_index(by)).to_pylist(), object)
            for group in set(groups.tolist()):
                rows = x[groups == group]
                held[group] = held.get(group, 0.0) + rows.T @ rows
            if len(held) * width * width > HELD:
                yield from given()
                held = {}
        yield from given()

    return run


class Gram:
    """Matrices by group, over [1, columns - shift, label - shift]; as many as there are groups, of the columns' square."""

    def __init__(self, columns, label, shift, matrices):
        self.columns, self.label, self.shift, self.matrices = list(columns), label, shift, matrices

    def of(self, *groups):
        """The matrix of several groups together."""
        width = len(self.columns) + 2
        return sum((self.matrices[g] for g in groups if g in self.matrices), np.zeros((width, width)))


def gram(df, columns, label, by, fill=None):
    """The Gram of rows with a label, grouped by the text column ``by``.

    A missing value counts as ``fill`` of its column, or as the column's mean. Columns are taken from their means, which keeps the sums exact.
    """
    names = [*columns, label]
    known = df.where(F.col(label).isNotNull())
    means = known.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names]).first().asDict()
    shift = np.array([0.0 if means[c] is None else means[c] for c in names])
    fill = fill or {}
    moved = [(F.coalesce(F.col(c).cast("double"), F.lit(float(fill.get(c, m)))) - F.lit(float(m))).alias(f"_x{i}")
             for i, (c, m) in enumerate(zip(names, shift))]
    width = len(names) + 1
    parts = known.select(F.col(by).alias("_by"), *moved).mapInArrow(
        _products([f"_x{i}" for i in range(len(names))], "_by", width), "_group string, _at long, _sum double")
    upper = np.triu_indices(width)
    matrices = {}
    for group, at, value in parts.groupBy("_group", "_at").agg(F.sum("_sum")).collect():
        matrix = matrices.setdefault(group, np.zeros((width, width)))
        matrix[upper[0][at], upper[1][at]] = matrix[upper[1][at], upper[0][at]] = value
    return Gram(columns, label, shift, matrices)


def moments(matrix):
    """Rows, means and population covariance of a matrix's columns and label (from their shifts)."""
    n = matrix[0, 0]
    mean = matrix[0, 1:] / n
    return n, mean, matrix[1:, 1:] / n - np.outer(mean, mean)


def ridge(matrix, chosen, reg, scale=None):
    """(slopes, intercept) of a ridge fit on the chosen columns (by number), as the engine's ridge fits them.

    ``scale``: divisors of all columns, population deviations if not given. The penalty is on slopes of scaled columns,
    relative to the deviation of the label.
    """
    n, mean, cov = moments(matrix)
    chosen = np.asarray(chosen)
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale = np.where(spread > 0, spread, 1.0)[:-1] if scale is None else np.asarray(scale)
    s = scale[chosen]
    # A column that does not vary has no slope.
    live = spread[:-1][chosen] > 0
    slopes = np.zeros(len(chosen))
    if live.any() and spread[-1] > 0:
        at = chosen[live]
        inner = cov[np.ix_(at, at)] / np.outer(s[live], s[live])
        penalty = reg / spread[-1] * np.eye(len(at))
        slopes[live] = np.linalg.solve(inner + penalty, cov[at, -1] / s[live]) / s[live]
    return slopes, mean[-1] - slopes @ mean[chosen]


def rmse(matrix, chosen, slopes, intercept):
    """Root mean square error of a linear model on the rows of a matrix."""
    weights = np.zeros(len(matrix))
    weights[0], weights[-1] = intercept, -1.0
    weights[1 + np.asarray(chosen)] = slopes
    return float(np.sqrt(max(0.0, weights @ matrix @ weights) / matrix[0, 0]))
