"""SentencePiece encoding by unigram Viterbi, and decoding.

The pieces and log scores of a model file are held in a double-array trie over
UTF-8 bytes.  The best segmentation has the largest sum of scores; a character
that is no piece costs ``UNKNOWN`` below the smallest score and is written as its
UTF-8 byte pieces.  Spaces are the marker U+2581, one of which is put before the
text.  As no piece has a marker after another character, a text falls apart into
runs "markers, other characters" that are segmented on their own, and each
distinct run once for as long as a worker remembers it.

Null and empty texts have no ids and decode to the empty text.  Decoding gives
back every text that holds no U+2581 itself (which decodes as a space).  Rows
that repeat a doc_id are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import narrow, small_batches

MARK = "▁"
UNKNOWN = -10.0
#: Distinct runs that a worker remembers.
CACHE_RUNS = 400_000
_NORMAL, _USER, _BYTE = 1, 4, 6
_runs = re.compile(" *[^ ]+| +")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


def load_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id; raises where the file asks for a normalisation other than identity."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces = []
    for number, value in _fields(raw):
        if number == 1:
            part = dict(_fields(value))
            pieces.append((part[1].decode(), struct.unpack("<f", part.get(2, b"\0\0\0\0"))[0], part.get(3, _NORMAL)))
        elif number == 3 and dict(_fields(value)).get(2):
            raise ValueError("only the identity normalisation is supported")
    return pieces


class DoubleArray:
    """A trie in two arrays: the child of state s by byte b is base[s] + b + 1 if check[there] is s."""

    def __init__(self, base: list[int], check: list[int], value: list[int]):
        self.base, self.check, self.value = base, check, value

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        size = 1 << 10
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        words = sorted(keys.items())
        free = 1
        todo = [(0, 0, len(words), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            if lo < hi and len(words[lo][0]) == depth:
                value[state] = words[lo][1]
                lo += 1
            groups = []
            while lo < hi:
                byte, end = words[lo][0][depth], lo
                while end < hi and words[end][0][depth] == byte:
                    end += 1
                groups.append((byte, lo, end))
                lo = end
            if not groups:
                continue
            at = max(0, free - groups[0][0] - 1)
            begun, taken = at, 0
            while True:
                if at + 260 >= len(check):
                    grow = len(check)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                if check[at + groups[0][0] + 1] >= 0:
                    taken += 1
                elif all(check[at + b + 1] < 0 for b, _, _ in groups):
                    break
                at += 1
            if taken > 0.9 * (at - begun + 1):  # what lies before is nearly full: later searches begin here
                free = max(free, at)
            base[state] = at
            for byte, a, b in groups:
                check[at + byte + 1] = state
                todo.append((at + byte + 1, a, b, depth + 1))
        return cls(base, check, value)


class Unigram:
    """Encodes and decodes with the pieces of a model."""

    def __init__(self, pieces: list[tuple[str, float, int]], trie: DoubleArray | None = None):
        words = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind in (_NORMAL, _USER)}
        self.apart = not any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind in (_NORMAL, _USER))
        self.trie = trie or DoubleArray.build(words)
        self.scores = [s for _, s, _ in pieces]
        self.unknown = min([s for _, s, kind in pieces if kind == _NORMAL], default=0.0) + UNKNOWN
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(MARK, " ").encode() if kind in (_NORMAL, _USER) else b"" for p, _, kind in pieces]
        self.unk_id = next((i for i, (_, _, kind) in enumerate(pieces) if kind == 2), 0)
        self.width = 2 if len(pieces) <= 65_536 else 4
        self.seen: dict[str, bytes] = {}

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text whose spaces are markers already."""
        raw = text.encode("utf-8", "replace")
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n, size = len(raw), len(check)
        best: list[float | None] = [None] * (n + 1)
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            b = raw[at]
            char_end = at + (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
            so_far = best[at]
            state, end, single = 0, at, False
            while end < n:
                there = base[state] + raw[end] + 1
                if there >= size or check[there] != state:
                    break
                state, end = there, end + 1
                piece = value[state]
                if piece >= 0:
                    score = so_far + scores[piece]
                    if best[end] is None or score > best[end]:
                        best[end], came[end] = score, (at, piece)
                    single = single or end == char_end
            if not single:
                score = so_far + self.unknown
                if best[char_end] is None or score > best[char_end]:
                    best[char_end], came[char_end] = score, (at, -1)
            at = char_end
        ids: list[int] = []
        at = n
        while at > 0:
            start, piece = came[at]
            if piece >= 0:
                ids.append(piece)
            elif self.byte_ids:
                ids.extend(self.byte_ids[x] for x in reversed(raw[start:at]))
            else:
                ids.append(self.unk_id)
            at = start
        return ids[::-1]

    def _packed(self, run: str) -> bytes:
        got = self.seen.get(run)
        if got is None:
            if len(self.seen) >= CACHE_RUNS:
                self.seen.clear()
            got = self.seen[run] = np.asarray(self.segment(MARK + run.replace(" ", MARK)), f"<u{self.width}").tobytes()
        return got

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if not self.apart:
            return np.asarray(self.segment(MARK + text.replace(" ", MARK)), np.int32)
        parts = text.split(" ")
        if "" in parts:
            parts = [p[1:] for p in _runs.findall(" " + text)]
        try:
            packed = b"".join(map(self.seen.__getitem__, parts))
        except KeyError:
            packed = b"".join(map(self._packed, parts))
        return np.frombuffer(packed, f"<u{self.width}").astype(np.int32)

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def shared_model(spark: SparkSession, model_path: str):
    """A broadcast of pieces and trie; its size is that of the vocabulary file."""
    pieces = load_pieces(model_path)
    trie = Unigram(pieces).trie
    return spark.sparkContext.broadcast((pieces, np.asarray(trie.base, np.int32), np.asarray(trie.check, np.int32), np.asarray(trie.value, np.int32)))


_MODELS: dict[str, Unigram] = {}


def worker_model(key: str, shared) -> Unigram:
    """The model of this worker, with the runs that it remembers from earlier tasks."""
    if key not in _MODELS:
        pieces, base, check, value = shared.value
        _MODELS.clear()
        _MODELS[key] = Unigram(pieces, DoubleArray(base.tolist(), check.tolist(), value.tolist()))
    return _MODELS[key]


def _key_of(shared) -> str:
    pieces = shared.value[0]
    return hashlib.sha256(repr(pieces).encode()).hexdigest()


def tokenize(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, round_trip) of every row; one pass without a shuffle."""
    spark = docs.sparkSession
    small_batches(spark, 500, "4m")
    shared = shared_model(spark, model_path)
    key = _key_of(shared)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(key, shared)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = [model.encode(t or "") for t in texts]
            decoded = [model.decode(x.tolist()) for x in ids]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                    pa.array([hashlib.sha256(d.encode("utf-8", "replace")).hexdigest() for d in decoded]),
                    pa.array([d == (t or "") for d, t in zip(decoded, texts, strict=True)]),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"],
            )

    schema = "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean"
    return narrow(docs, id_col, text_col).mapInArrow(rows, schema)


def detokenize(tokens: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``tokens`` with the decoded text of each row's ids as ``out_col``; null ids decode to null."""
    shared = shared_model(tokens.sparkSession, model_path)
    key = _key_of(shared)

    def texts(batches):
        model = worker_model(key, shared)
        for batch in batches:
            yield pd.Series([None if x is None else model.decode([int(i) for i in x]) for x in batch], dtype=object)

    decode = F.pandas_udf(texts, T.StringType(), F.PandasUDFType.SCALAR_ITER)
    return tokens.withColumn(out_col, decode(tokens[ids_col]))
