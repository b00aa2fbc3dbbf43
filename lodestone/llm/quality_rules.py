"""Quality rules, and a likelihood ratio of hashed n-grams between trusted and raw texts.

Two multinomials over hash buckets of words and pairs of neighbouring words are
counted: of all texts (raw), and of all texts that a label trusts (quality 1).
The ratio of a bucket is ``log((trusted + a) / (expected + a))``, where
``expected`` is the bucket's raw count scaled to as many trusted n-grams and ``a``
is ``PRIOR`` mean counts, so a bucket that says little is near 0.  A text's verdict
is the mean of its n-grams' ratios against ``THRESHOLD``: whole numbers (millionths)
are summed, so it is the same on every run and for any split of the rows.

Counts cover all documents.  The number of buckets grows with the corpus, a power
of two of about one for ``BYTES_A_BUCKET`` bytes of text, up to ``MOST_BUCKETS``:
then a table of ratios is 64 MB, what a task can hold; a corpus beyond that shares
buckets.  Each task counts its own rows in pages of buckets, pages are added up in
a stream, and the driver sees sums alone.  Scoring is one pass without a shuffle.

The rules of a text: words are runs of anything but space and \\x09-\\x0D; repeated
windows are found by hash within each text and settled on the words themselves.

A null text is empty: no words, so it fails.  Labels that are null, that contradict
each other or that have no document trust nothing; where nothing is trusted all
ratios are 0 and the rules alone decide.  Rows that repeat a doc_id are rows of
their own, each with its own text, and a trusted id trusts all of them.  A null
doc_id is kept as null and is never trusted.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch, checked_broadcast, narrow, small_batches

BYTES_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 64, 1 << 14, 1 << 24
#: Mean counts of trusted n-grams that every bucket is given.
PRIOR = 8
#: Where held-out labels part best: clean texts lie above it from a thousand documents on, others below it the more surely the larger the corpus.
THRESHOLD = -0.08
MIN_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
PAGE = 1 << 10
_UNIT = 1_000_000
_WORD = np.ones(256, np.int64)  # bytes that begin a code point of a word
_WORD[0x80:0xC0] = 0
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def n_grams(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words and pairs of one text's neighbours, the text of each)."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pairs = W.runs(hashes, 2)
    inside = text[1:] == text[:-1]
    return np.concatenate((hashes, pairs[inside])), np.concatenate((text, text[:-1][inside]))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that are found twice or more; exact."""
    _, ids = np.unique(np.array(words, dtype=object), return_inverse=True)
    for width in (1, 2, 4):  # ids of runs of 2, 4 and 8 words
        if len(ids) <= width:
            return 0
        _, ids = np.unique(ids[:-width].astype(np.int64) * (int(ids.max()) + 1) + ids[width:], return_inverse=True)
    found = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found, 1)
    np.add.at(edges, found + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def _suspects(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts with two windows of equal hash."""
    windows = W.runs(hashes, WINDOW)
    if not len(windows):
        return np.empty(0, np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = text[WINDOW - 1 :] == text[: len(windows)]
    windows, text = windows[inside], text[: len(windows)][inside]
    keys = W.mix(windows + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    return np.unique(text[order[1:][same]])


def _repeated_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def rules(raws: list[bytes], hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    joined = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))[:-1]
    out = np.zeros((len(raws), 5), np.int64)
    out[:, 0] = np.diff(at)
    out[:, 1] = np.add.reduceat(_WORD[joined], begins)
    out[:, 2] = np.add.reduceat(_SYMBOL[joined], begins)
    out[:, 3] = [_repeated_lines(r) for r in raws]
    for i in _suspects(hashes, at):
        out[i, 4] = repeated_words(raws[i].split())
    return out


def _buckets(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << int(math.log2(max(1, size / BYTES_A_BUCKET))))))


def _trusted_ids(labels: DataFrame) -> DataFrame:
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    return known.groupBy("doc_id").agg(F.min("y").alias("low"), F.max("y").alias("high")).where("low = 1 and high = 1").select("doc_id", F.lit(True).alias("trusted"))


def _pages(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(page, packed counts) of pages that hold any; ``counts`` is (2, buckets): raw and trusted."""
    for page in np.flatnonzero(counts[0].reshape(-1, PAGE).any(1)):
        part = counts[:, page * PAGE : (page + 1) * PAGE]
        yield int(page), zlib.compress(np.ascontiguousarray(part.astype("<i8").view(np.uint8).reshape(2, PAGE, 8).transpose(0, 2, 1)).tobytes(), 1)  # like bytes together


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(2, 8, PAGE).transpose(0, 2, 1)).view("<i8").reshape(2, PAGE)


def counted(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """(page, packed, raw, trusted): the raw and trusted counts of all documents, and their sums of a page."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            trusted = np.array(batch.column("trusted").to_pylist(), bool)
            for a, b, raws in W.blocks(batch.column("text").to_pylist()):
                grams, text = n_grams(*W.hash_words(raws))
                grams = (grams & np.uint64(buckets - 1)).astype(np.int64)
                for k, some in ((0, grams), (1, grams[trusted[a:b][text]])):
                    if buckets <= 4 * len(some):
                        counts[k] += np.bincount(some, minlength=buckets)
                    else:
                        np.add.at(counts[k], some, 1)
        pages = list(_pages(counts))
        yield pa.RecordBatch.from_pydict({"page": pa.array([p for p, _ in pages], pa.int32()), "packed": pa.array([x for _, x in pages], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros((2, PAGE), np.int64)
        for batch in batches:
            done = []
            for page, packed in zip(batch.column("page").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if page != now:
                    if now is not None:
                        done.append((now, total))
                    now, total = page, np.zeros((2, PAGE), np.int64)
                total += _unpacked(packed)
            yield sums(done)
        if now is not None:
            yield sums([(now, total)])

    def sums(done: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        packed = [zlib.compress(t.astype("<i8").tobytes(), 1) for _, t in done]
        raw, trusted = ([int(t[k].sum()) for _, t in done] for k in (0, 1))
        return pa.RecordBatch.from_pydict({"page": pa.array([p for p, _ in done], pa.int32()), "packed": pa.array(packed, pa.binary()), "raw": pa.array(raw, pa.int64()), "trusted": pa.array(trusted, pa.int64())})

    marked = docs.join(checked_broadcast(_trusted_ids(labels)), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    return marked.mapInArrow(task, "page int, packed binary").repartition("page").sortWithinPartitions("page").mapInArrow(added, "page int, packed binary, raw long, trusted long")


def ratios(counts: DataFrame, buckets: int) -> np.ndarray:
    """Millionths of the log ratio of each bucket, a page in each task; the driver gets 4 bytes a bucket, MOST_BUCKETS at most."""
    sums = counts.agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).first()
    table = np.zeros(buckets, np.int32)
    if not sums["trusted"]:
        return table
    share, prior = sums["trusted"] / sums["raw"], PRIOR * sums["trusted"] / buckets
    # A bucket without any count has a ratio of 0, as pages without any have.

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for packed in batch.column("packed").to_pylist():
                raw, trusted = np.frombuffer(zlib.decompress(packed), "<i8").reshape(2, PAGE)
                found.append(np.rint(np.log((trusted + prior) / (raw * share + prior)) * _UNIT).astype("<i4").tobytes())
            yield pa.RecordBatch.from_pydict({"page": batch.column("page"), "ratio": pa.array(found, pa.binary())})

    for row in counts.mapInArrow(task, "page int, ratio binary").toLocalIterator():
        table[row["page"] * PAGE : (row["page"] + 1) * PAGE] = np.frombuffer(row["ratio"], "<i4")
    return table


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of every row.

    ``score`` is the mean log ratio of a text's n-grams, 0 without any.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "rules")
    docs = narrow(docs)
    buckets = _buckets(docs)
    table = spark.sparkContext.broadcast(ratios(scratch.table(counted(docs, labels, buckets), "counts"), buckets))
    limit = round(threshold * _UNIT)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = table.value
        for batch in batches:
            found, sums, sizes = [], [], []
            for _, _, raws in W.blocks(batch.column("text").to_pylist()):
                hashes, at = W.hash_words(raws)
                found.append(rules(raws, hashes, at))
                grams, text = n_grams(hashes, at)
                worth = ratio[(grams & np.uint64(buckets - 1)).astype(np.int64)].astype(np.int64)
                total = np.zeros(len(raws), np.int64)
                np.add.at(total, text, worth)
                sums.append(total)
                sizes.append(np.bincount(text, minlength=len(raws)))
            if not found:
                continue
            n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = np.concatenate(found).T
            total, size = np.concatenate(sums), np.concatenate(sizes)
            failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)
            columns = {"doc_id": batch.column("doc_id"), "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "base_failed": failed, "kept": ~failed & (total >= limit * size), "score": total / np.maximum(1, size) / _UNIT}
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    return docs.mapInArrow(task, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")
