"""Quality scores from a factorisation machine.

Features of a text are its hashed words (weighted by their share), bins of
structure statistics (letter case, symbols, repetition, lines) and bins of
metadata (the declared length).  The machine adds to a linear model the
interactions of all pairs through vectors of low rank, in time linear in the
number of features by ``sum_{i<j} <v_i,v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2``.

It is trained by minibatch Adam on at most ``MAX_ROWS`` labelled rows, taken by a
hash of their id.  Their features are made by all tasks and meet in one, which
fits the machine; the driver sees the machine alone, and broadcasts it (its size
is fixed by ``BUCKETS`` and ``RANK``).  Every row is scored, whole texts, in one pass without a shuffle.

Null and empty texts are scored by their bins alone.  Labels that are null, or
that contradict each other for one doc_id, teach nothing; where no row teaches,
or only one label is there, every score is 0.5.  Of rows that repeat a doc_id the
smallest text teaches, and all are scored as rows of their own; a null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .scratch import small_batches

#: Hash buckets for words; bins come after them.
BUCKETS = 1 << 15
RANK = 6
#: Labelled rows that teach, at most.
MAX_ROWS = 12_000
EPOCHS, BATCH, RATE, DECAY = 8, 256, 0.02, 1e-4
#: Steps that a small sample gets at least, by smaller batches and more epochs.
MIN_STEPS = 400
#: Features that the gradient is taken over at once; a batch with more is summed by parts.
PART_FEATURES = 1 << 17

_STATS = 16
_BINS = 12
_FEATURES = BUCKETS + _STATS * _BINS
_CLASS = np.zeros(256, np.uint8)  # other bytes, among them those of letters beyond ASCII
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 6
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 7


def _bin(share: float) -> int:
    """0 for nothing, then bins whose bounds double."""
    return 0 if share <= 0 else int(min(_BINS - 1, max(1, _BINS - 1 + np.ceil(np.log2(share)))))


def _long_bin(n: float) -> int:
    return int(min(_BINS - 1, np.log2(n + 1) * 0.75))


def structure(raw: bytes, words: np.ndarray, counts: np.ndarray, n_words: int, n_chars: float | None) -> list[int]:
    """A bin for each structure statistic and for the metadata."""
    size = max(1, len(raw))
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / size
    lines = raw.split(b"\n")
    repeated = 1 - len(set(lines)) / len(lines)
    unique = len(words) / max(1, n_words)
    top = counts.max() / n_words if n_words else 0.0
    return [
        *(_bin(kinds[k]) for k in (0, 1, 2, 3, 6, 7)), _bin(kinds[2] / max(1e-9, kinds[1] + kinds[2])), _bin(repeated), _bin(1 - unique), _bin(unique), _bin(top),
        _long_bin(n_words), _long_bin(len(lines)), _long_bin(size / max(1, n_words)), _bin(raw.count(b"|") / max(1, n_words)),
        0 if n_chars is None or n_chars != n_chars else 1 + min(_BINS - 2, _long_bin(n_chars)),
    ]


def features(texts: list[str | None], lengths: list[float | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, values) of each text; words first, in the order of their buckets."""
    offset = BUCKETS + np.arange(_STATS) * _BINS
    bins_value = np.full(_STATS, 1 / np.sqrt(_STATS))
    for a, b, raws in W.blocks(texts):
        hashes, at = W.hash_words([r.lower() for r in raws])
        buckets = (hashes >> np.uint64(20)) & np.uint64(BUCKETS - 1)
        for i in range(b - a):
            n = int(at[i + 1] - at[i])
            words, counts = np.unique(buckets[at[i] : at[i + 1]].astype(np.int64), return_counts=True)
            value = np.sqrt(counts / max(1, n))  # of length 1
            bins = offset + structure(raws[i], words, counts, n, lengths[a + i])
            yield np.concatenate((words, bins)), np.concatenate((value, bins_value))


class Machine:
    """A factorisation machine over ``_FEATURES`` features."""

    def __init__(self, bias: float = 0.0, weights: np.ndarray | None = None, vectors: np.ndarray | None = None):
        self.bias = bias
        self.weights = np.zeros(_FEATURES) if weights is None else weights
        self.vectors = np.zeros((_FEATURES, RANK)) if vectors is None else vectors

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.vectors[index] * value[:, None]
        total = v.sum(0)
        return float(self.bias + self.weights[index] @ value + 0.5 * (total @ total - (v * v).sum()))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(index, value), -30, 30))))


def _parts(batch: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The batch in parts of at most PART_FEATURES features, or of one row."""
    ends = np.cumsum([len(rows[i][0]) for i in batch])
    return np.split(batch, np.flatnonzero(np.diff((ends - 1) // max(1, PART_FEATURES - _FEATURES))) + 1)


def _gradient(theta: np.ndarray, bias: float, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, their gradients, error of each row) of the loss over ``n`` rows, of which these are some."""
    sizes = [len(i) for i, _ in rows]
    index = np.concatenate([i for i, _ in rows]).astype(np.int64)
    value = np.concatenate([v for _, v in rows]).astype(float)
    row = np.repeat(np.arange(len(rows)), sizes)
    cut = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    v = theta[index, 1:] * value[:, None]
    total = np.add.reduceat(v, cut)
    margin = bias + np.add.reduceat(theta[index, 0] * value, cut) + 0.5 * ((total**2).sum(1) - np.add.reduceat((v * v).sum(1), cut))
    error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) / n
    each = error[row] * value
    grad = np.concatenate((each[:, None], each[:, None] * (total[row] - v)), axis=1)
    used, place = np.unique(index, return_inverse=True)
    return used, np.stack([np.bincount(place, grad[:, k], len(used)) for k in range(1 + RANK)], axis=1), error


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Minibatch Adam on the logistic loss; gradients of a batch are summed by feature.

    Rows keep their narrow types (6 bytes a feature) and are widened a batch at a time.
    """
    if len(rows) == 0 or labels.min() == labels.max():
        return Machine()
    rng = np.random.default_rng(seed)
    size = min(BATCH, max(16, len(rows) // 16))
    epochs = max(epochs, -(-MIN_STEPS * size // len(rows)))
    share = labels.mean()
    bias = float(np.log(share / (1 - share)))
    theta = np.concatenate((np.zeros((_FEATURES, 1)), rng.normal(0, 0.05, (_FEATURES, RANK))), axis=1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    bias_first = bias_second = 0.0
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), size):
            part = order[lo : lo + size]
            sums = [_gradient(theta, bias, [rows[i] for i in few], labels[few], len(part)) for few in _parts(part, rows)]
            error = np.concatenate([e for _, _, e in sums])
            used, place = np.unique(np.concatenate([u for u, _, _ in sums]), return_inverse=True)
            grad = np.concatenate([g for _, g, _ in sums])
            summed = np.stack([np.bincount(place, grad[:, k], len(used)) for k in range(1 + RANK)], axis=1) + DECAY * theta[used]
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            first[used] = 0.9 * first[used] + 0.1 * summed
            second[used] = 0.999 * second[used] + 0.001 * summed**2
            theta[used] -= RATE * fix * first[used] / (np.sqrt(second[used]) + 1e-8)
            bias_first = 0.9 * bias_first + 0.1 * error.sum()
            bias_second = 0.999 * bias_second + 0.001 * error.sum() ** 2
            bias -= RATE * fix * bias_first / (np.sqrt(bias_second) + 1e-8)
    return Machine(bias, theta[:, 0].copy(), theta[:, 1:].copy())


def _inputs(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars): a declared length that isn't there is null."""
    named = [c for c in docs.columns if c == "n_chars"]
    length = docs["n_chars"].cast("double") if len(named) == 1 else F.lit(None).cast("double")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), length.alias("n_chars"))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose crc32 of the id as text leaves remainder 1 by 3 never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """Fits the machine on at most ``max_rows`` labelled rows that are not held out, in one task."""
    small_batches(docs.sparkSession)
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("high")).where("quality = high").drop("high")
    docs = _inputs(docs)
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # a label without a document takes no place in the sample
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (index, value), label, doc_id in zip(features(batch["text"].tolist(), batch["n_chars"].tolist()), batch["quality"], batch["doc_id"], strict=True):
                out.append((doc_id, label, index.astype("<u2").tobytes(), value.astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "quality", "index", "value"])

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({"doc_id": [], "quality": [], "index": [], "value": []})])
        got = got.sort_values("doc_id")
        data = [(np.frombuffer(i, "<u2"), np.frombuffer(v, "<f4")) for i, v in zip(got["index"], got["value"], strict=True)]
        machine = fit(data, got["quality"].to_numpy(float))
        yield pd.DataFrame({"bias": [machine.bias], "weights": [machine.weights.tobytes()], "vectors": [machine.vectors.tobytes()]})

    taught = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", "n_chars")).alias("t"))  # one row an id, so max_rows in all
    taught = taught.select("doc_id", "quality", "t.text", "t.n_chars").mapInPandas(rows, "doc_id long, quality int, index binary, value binary")
    one = taught.repartition(1).mapInPandas(fitted, "bias double, weights binary, vectors binary").first()
    if one is None:
        return Machine()
    return Machine(one["bias"], np.frombuffer(one["weights"]), np.frombuffer(one["vectors"]).reshape(-1, RANK))


def score_column(machine: Machine, spark):
    """A vectorised function of (text, n_chars) that gives the score."""
    shared = spark.sparkContext.broadcast((machine.bias, machine.weights.astype(np.float32), machine.vectors.astype(np.float32)))

    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        bias, weights, vectors = shared.value
        own = Machine(bias, weights.astype(float), vectors.astype(float))
        for texts, lengths in batches:
            yield pd.Series([own.score(i, v) for i, v in features(texts.tolist(), lengths.tolist())], dtype=float)

    return F.pandas_udf(scores, T.DoubleType(), F.PandasUDFType.SCALAR_ITER)


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    machine = train(docs, labels, max_rows)
    scored = _inputs(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(machine, docs.sparkSession)("text", "n_chars").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that score 0.5 and more, with all their columns."""
    machine = train(docs, labels, max_rows)
    length = docs["n_chars"].cast("double") if docs.columns.count("n_chars") == 1 else F.lit(None).cast("double")
    return docs.where(score_column(machine, docs.sparkSession)(docs["text"].cast("string"), length) >= 0.5)
