"""Whitening of embeddings by Chan's merge of partial covariances.

An entry c of a vector is taken as the whole number ``floor(256 * c)``.  Each
distinct vector of whole numbers counts once.  Every task sums up its vectors as
(count, exact sums, mean, centred scatter), batch by batch; Chan's formula merges
two such summaries, within a task and between tasks (``treeReduce``), so centring
comes before multiplying and no large numbers cancel.  The driver sees one
summary (dimension squared) and takes its eigenvectors; a second pass over the
distinct vectors verifies that the whitened components have the identity as covariance.

Rows whose vector is null, empty or holds a null or non-finite entry are dropped,
and so are those whose length is not the commonest (of equally common ones, the
shortest).  Rows that repeat an id are rows of their own; a null id stays null.
Entries beyond a long are held at its bounds.  A deviation that doesn't fit a long
is null.  A component without variance has a null ``whitened`` and no part in
``identity_error``; without any variance ``explained`` is null and
``identity_error`` is 0.  A table without vectors gives no rows; with fewer
dimensions than components each dimension is one.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

COMPONENTS = 4
SCALE = 256
#: Components with less than this share of the largest variance count as without any.
FLAT = 1e-12
_LONG = (1 << 63) - 1

#: (count, exact sums, mean, centred scatter)
Summary = tuple[int, list[int], np.ndarray, np.ndarray]


def _sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns of whole numbers."""
    if len(x) and np.abs(x.astype(float)).max() * len(x) > 2.0**62:
        return [sum(map(int, column)) for column in x.T]
    return [int(s) for s in x.sum(0)]


def summary(x: np.ndarray, values: np.ndarray | None = None) -> Summary:
    """Of the rows of ``values``, or of the whole numbers ``x`` themselves."""
    values = x.astype(float) if values is None else values
    mean = values.mean(0) if len(values) else np.zeros(values.shape[1])
    centred = values - mean
    return len(values), _sums(x), mean, centred.T @ centred


def merge(a: Summary, b: Summary) -> Summary:
    """Chan's formula for two disjoint sets of rows."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n = a[0] + b[0]
    step = b[2] - a[2]
    return n, [s + t for s, t in zip(a[1], b[1], strict=True)], a[2] + step * (b[0] / n), a[3] + b[3] + np.outer(step, step) * (a[0] * b[0] / n)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of whole numbers, without a Python object for each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(fit: DataFrame, dims: int, project: Callable[[np.ndarray], np.ndarray] | None = None) -> Summary:
    """The summary of all vectors: one for each task, merged as a tree."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: Summary | None = None
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            part = summary(x, None if project is None else project(x))
            whole = part if whole is None else merge(whole, part)
        if whole is not None:
            yield pa.RecordBatch.from_pydict({"summary": pa.array([pickle.dumps(whole)], pa.binary())})

    width = dims if project is None else project(np.zeros((1, dims), np.int64)).shape[1]
    nothing: Summary = (0, [0] * dims, np.zeros(width), np.zeros((width, width)))
    found = fit.select("x").mapInArrow(task, "summary binary").rdd.map(lambda r: pickle.loads(bytes(r["summary"])))
    return merge(nothing, found.treeReduce(merge)) if found.getNumPartitions() and not fit.isEmpty() else nothing


class Whitener:
    """Components of the covariance of whole-number vectors."""

    def __init__(self, whole: Summary, components: int = COMPONENTS):
        self.n, self.sums, _, scatter = whole
        self.total = np.array(self.sums, dtype=object)
        covariance = scatter / max(1, self.n)
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        self.trace = float(np.trace(covariance))
        self.values = np.maximum(values[order], 0.0)
        vectors = vectors[:, order]
        high = np.abs(vectors).argmax(0)
        self.vectors = vectors * np.where(vectors[high, np.arange(len(order))] < 0, -1.0, 1.0)
        self.live = self.values > FLAT * max(self.values.max(initial=0.0), 0.0)

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: longs where they fit, else Python's whole numbers."""
        most = max([abs(s) for s in self.sums], default=0)
        if np.abs(x.astype(float)).max(initial=0.0) * self.n + most < 2.0**62:
            return x * np.int64(self.n) - self.total.astype(np.int64)
        return x.astype(object) * self.n - self.total

    def deviations(self, offsets: np.ndarray) -> list[int | None]:
        high = np.abs(offsets.astype(float)).max(initial=0.0)
        if offsets.dtype == object or high**2 * offsets.shape[1] >= 2.0**62:
            exact = [sum(int(v) ** 2 for v in row) for row in offsets]
            return [v if v <= _LONG else None for v in exact]
        return (offsets**2).sum(1).tolist()

    def whitened(self, offsets: np.ndarray) -> np.ndarray:
        """A column for each component; those without variance are 0."""
        scale = np.where(self.live, np.sqrt(np.where(self.live, self.values, 1.0)), np.inf)
        return (offsets.astype(float) / max(1, self.n)) @ self.vectors / scale


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    scratch = Scratch(embeddings.sparkSession, "whitening")
    entries = embeddings.select(embeddings[id_col].cast("long").alias("vec_id"), embeddings[vector_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = entries.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))
    common = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = common["dims"] if common else 1
    rows = rows.where(F.size("x") == dims)
    fit = scratch.table(rows.select("x").distinct(), "fit")
    model = Whitener(_summed(fit, dims), components)
    checked = _summed(fit, dims, lambda x: model.whitened(model.offsets(x)))
    off = np.abs(checked[3] / max(1, checked[0]) - np.eye(len(model.live)))[np.ix_(model.live, model.live)]
    error = float(off.max(initial=0.0))
    parts = [float(v / model.trace) if model.trace > 0 else None for v in model.values]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.live)
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets = model.offsets(_matrix(batch.column("x"), dims))
            n = len(offsets)
            each = np.repeat(np.arange(n), k)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(each)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                "n": pa.array(np.full(n * k, model.n, np.int64)),
                "deviation": pa.array(model.deviations(offsets), pa.int64()).take(pa.array(each)),
                "whitened": pa.array(model.whitened(offsets).ravel(), pa.float64(), mask=np.tile(~model.live, n)),
                "explained": pa.array(parts * n, pa.float64()),
                "identity_error": pa.array(np.full(n * k, error)),
            })

    return rows.mapInArrow(task, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
