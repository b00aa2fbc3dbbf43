"""Token ids in sorted-string-table shards.

A shard is one file: blocks of prefix-compressed entries (key, token ids), a
sparse index with the first key of every block, a Bloom filter over all keys and
a fixed footer.  Keys are document ids in an order-preserving form, so a lookup
rejects by the filter, finds the block by binary search over the index and reads
that block alone.  Shards are written in ascending key order by a range
partitioning of the documents; each partition streams its sorted rows.

Layout::

    block*    entries: shared, unshared, ids' bytes (varints), key suffix, ids; then crc32 of the block
    index     for each block: key length, key, offset, length (varints)
    bloom     number of probes (1 byte), then the bits
    footer    offsets and lengths of index and bloom, entries, ids, ids before the shard in
              its partition, partition, bytes of an id, magic

Null texts are empty (only the end id); a null doc_id has the empty key and comes
first; rows that repeat a doc_id are entries of their own.  An empty table
writes no shard and reads as no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, checked_broadcast, frame_of, narrow, small_batches

BLOCK_BYTES = 32 * 1024
SHARD_BYTES = 4 * 1024 * 1024
BITS_PER_KEY, PROBES = 10, 7
#: The writer of text files ends each file with a line feed, the magic's last byte.
MAGIC = b"LSSST01\n"
_FOOTER = struct.Struct("<QQQQQQQII8s")
#: Distinct parts of texts whose ids a worker remembers.
CACHE_WORDS = 1_200_000
_MARKS = ".,;:!?#$%&*"
#: White space other than spaces and line feeds.
_ODD_ASCII = "\t\r\v\f\x1c\x1d\x1e\x1f"
_ODD = re.compile(r"[^\S \n]|\u180e")


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as signed ids do; null sorts first."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(PROBES)]


class ShardWriter:
    """Collects entries in key order; ``finish`` gives the shard's bytes."""

    def __init__(self, width: int, partition: int, before: int, block_bytes: int = BLOCK_BYTES):
        self.width, self.partition, self.before, self.block_bytes = width, partition, before, block_bytes
        self.body, self.block = bytearray(), bytearray()
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.n_ids = 0
        self.last = self.first = b""

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.keys.append(key)
        self.n_ids += len(ids) // self.width
        self.last = key
        if len(self.block) >= self.block_bytes:
            self._close()

    def _close(self) -> None:
        if self.block:
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.first, len(self.body), len(self.block)))
            self.body += self.block
            self.block = bytearray()

    def size(self) -> int:
        return len(self.body) + len(self.block)

    def finish(self) -> bytes:
        self._close()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        filter_ = bytes([PROBES]) + struct.pack("<Q", bits) + bloom.tobytes()
        at = len(self.body)
        footer = _FOOTER.pack(at, len(index), at + len(index), len(filter_), len(self.keys), self.n_ids, self.before, self.partition, self.width, MAGIC)
        return bytes(self.body) + index + filter_ + footer


class Shard:
    """Reads one shard: every entry in order, or one key by binary search."""

    def __init__(self, raw: bytes):
        self.raw = raw
        footer = _FOOTER.unpack_from(raw, len(raw) - _FOOTER.size)
        self.index_at, index_len, self.bloom_at, _, self.n_entries, self.n_ids, self.before, self.partition, self.width, magic = footer
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.blocks, at = [], self.index_at
        while at < self.index_at + index_len:
            n, at = _read_varint(raw, at)
            key = raw[at : at + n]
            offset, at = _read_varint(raw, at + n)
            length, at = _read_varint(raw, at)
            self.blocks.append((key, offset, length))

    def _block(self, offset: int, length: int) -> Iterator[tuple[bytes, bytes]]:
        end = offset + length - 4
        if zlib.crc32(self.raw[offset:end]) != struct.unpack_from("<I", self.raw, end)[0]:
            raise ValueError("damaged block")
        at, key = offset, b""
        while at < end:
            shared, at = _read_varint(self.raw, at)
            rest, at = _read_varint(self.raw, at)
            n, at = _read_varint(self.raw, at)
            key = key[:shared] + self.raw[at : at + rest]
            at += rest
            yield key, self.raw[at : at + n]
            at += n

    def entries(self) -> Iterator[tuple[bytes, bytes]]:
        for _, offset, length in self.blocks:
            yield from self._block(offset, length)

    def may_hold(self, key: bytes) -> bool:
        bits = struct.unpack_from("<Q", self.raw, self.bloom_at + 1)[0]
        return all(self.raw[self.bloom_at + 9 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits))

    def get(self, key: bytes) -> list[bytes]:
        """The ids of every entry of this key."""
        if not self.may_hold(key):
            return []
        at = max(0, bisect_right([k for k, _, _ in self.blocks], key) - 1)
        while at > 0 and self.blocks[at][0] == key:  # repeated keys may begin in an earlier block
            at -= 1
        found = []
        for first, offset, length in self.blocks[at:]:
            if first > key:
                break
            found += [ids for k, ids in self._block(offset, length) if k == key]
        return found


class WordEncoder:
    """Ids of texts under a byte-level BPE file of the tokenizers library.

    Where every white space of a text is one space or one line feed between other
    characters, no pre-token crosses the place before it, so such a text is cut
    into parts "word" (after a space) and "\\nword".  Parts that a worker doesn't
    remember are encoded many in one call, and told apart by the only ids that
    begin with their space or line feed.  Texts with any other white
    space (a no-break space, say) or with an added token are encoded whole, and so
    is every text if the file asks for more than byte-level pre-tokens.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the others belong to other tasks
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.added = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        self.width = 2 if self.coder.get_vocab_size(with_added_tokens=True) <= 65_536 else 4
        with open(path, "rb") as f:
            rules = json.load(f)
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        own = rules.get("pre_tokenizer") or {}
        self.cuts = rules.get("normalizer") is None and {k: own.get(k) for k in plain} == plain
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.coder.get_vocab(with_added_tokens=False)
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[0] == "Ġ"]] = True  # byte 32 in byte-level form
        self.fed = np.arange(len(self.spaced)) == vocabulary.get("Ċ", -1)  # byte 10
        self.cuts = self.cuts and "Ġ" in vocabulary and "Ċ" in vocabulary

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, f"<u{self.width}").tobytes() for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str], mark: str, begins: np.ndarray) -> None:
        """Remembers the ids of parts, each of which begins with ``mark`` when it is encoded."""
        chunks = [parts[lo : lo + 200] for lo in range(0, len(parts), 200)]
        for chunk, raw in zip(chunks, self._encode([mark + mark.join(c) for c in chunks]), strict=True):
            ids = np.frombuffer(raw, f"<u{self.width}")
            cut = np.flatnonzero(begins[np.minimum(ids, len(begins) - 1)]) * self.width
            key = "" if mark == " " else mark
            if len(cut) != len(chunk):  # they can't be told apart
                self.seen.update(zip([key + p for p in chunk], self._encode([mark + p for p in chunk]), strict=True))
                continue
            ends = [*cut[1:].tolist(), len(raw)]
            self.seen.update((key + part, raw[lo:hi]) for part, lo, hi in zip(chunk, cut.tolist(), ends, strict=True))

    def _learn(self, parts: set[str]) -> None:
        """Adds the parts to those that are remembered."""
        new: dict[str, None] = {}
        marked = []
        for part in parts:
            known = self.old.get(part)
            if known is not None:
                self.seen[part] = known
                continue
            word = part.rstrip(_MARKS) if part[-1] in _MARKS else part
            if word is not part and word.isalpha():  # letters and marks are pre-tokens of their own
                marked.append((part, word))
                if word not in self.seen:
                    new[word] = None
            else:
                new[part] = None
        self._encode_parts([p for p in new if p[0] != "\n"], " ", self.spaced)
        self._encode_parts([p[1:] for p in new if p[0] == "\n"], "\n", self.fed)
        tails = list({part[len(word) :] for part, word in marked})
        ids = dict(zip(tails, self._encode(tails), strict=True))
        self.seen.update((part, self.seen[word] + ids[part[len(word) :]]) for part, word in marked)

    def _can_be_cut(self, text: str) -> bool:
        """Whether it has no white space but spaces and line feeds, and no added token; ``encode`` finds those that aren't single by their parts."""
        odd = any(x in text for x in _ODD_ASCII) if text.isascii() else _ODD.search(text)
        return self.cuts and not odd and not any(x in text for x in self.added)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; what was not met for ``CACHE_WORDS`` / 2 new parts is forgotten."""
        if len(self.seen) > CACHE_WORDS // 2:
            self.old, self.seen = self.seen, {}
        look = self.seen.__getitem__
        rows, missing = [], set()
        for text in texts:
            head, *parts = text.replace("\n", " \n").split(" ") if self._can_be_cut(text) else [text]
            if not head:
                head, parts = text, []
            try:
                got = b"".join(map(look, parts))
            except KeyError:
                got, new = None, set(parts).difference(self.seen)
                if new.isdisjoint(("", "\n")):
                    missing |= new
                else:  # repeated or trailing white space
                    head, parts = text, []
            rows.append((head, parts, got))
        self._learn(missing)
        heads = self._encode([head for head, _, _ in rows])
        return [head + (b"".join(map(look, parts)) if got is None else got) for head, (_, parts, got) in zip(heads, rows, strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker, with the words that it has seen in earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> None:
    """Writes (doc_id, text) rows as shard files under ``out``, in ascending order of doc_id.

    Texts are moved once, by range of doc_id; encoding runs on the sorted
    partitions, so ids are never shuffled.
    """
    small_batches(docs.sparkSession, 500, "4m")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer_path)
        end, before = np.asarray([end_id], f"<u{coder.width}").tobytes(), 0
        part = TaskContext.get().partitionId()
        shard = ShardWriter(coder.width, part, 0, block_bytes)
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"].tolist()]
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for doc_id, packed in zip(ids, coder.encode(texts), strict=True):
                shard.add(key_of(doc_id), packed + end)
                if shard.size() >= shard_bytes:
                    before += shard.n_ids
                    yield pd.DataFrame({"raw": [shard.finish()[:-1]]})
                    shard = ShardWriter(coder.width, part, before, block_bytes)
        if shard.keys:
            yield pd.DataFrame({"raw": [shard.finish()[:-1]]})

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select(F.col("doc_id").cast("string"), "text")  # a null stays a null in pandas
    shards = ordered.mapInPandas(rows, "raw binary")
    shards.select(F.col("raw").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(out)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, partition, start_in_partition, n_tokens, ids_crc32, ids binary of little-endian 4-byte integers)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                shard = Shard(bytes(raw))
                start, out = shard.before, []
                for key, packed in shard.entries():
                    ids = np.frombuffer(packed, f"<u{shard.width}").astype("<u4").tobytes()
                    n = len(packed) // shard.width
                    out.append((id_of(key), shard.partition, start, n, zlib.crc32(ids), ids))
                    start += n
                    if len(out) == 500:
                        yield _frame(out)
                        out = []
                if out:
                    yield _frame(out)

    small_batches(spark, 500, "4m")
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(rows, "doc_id long, partition int, start_in_partition long, n_tokens long, ids_crc32 long, ids binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = ["doc_id", "partition", "start_in_partition", "n_tokens", "ids_crc32", "ids"]
    return frame_of(rows, columns, columns[:-1])


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids binary) of the given documents, by binary search in each shard that may hold them."""
    keys = [key_of(d) for d in doc_ids]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                shard = Shard(bytes(raw))
                found = [(id_of(k), np.frombuffer(x, f"<u{shard.width}").astype("<u4").tobytes()) for k in keys for x in shard.get(k)]
                yield frame_of(found, ["doc_id", "ids"], ["doc_id"])

    small_batches(spark, 500, "4m")
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "doc_id long, ids binary")


def token_starts(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards, reads them back: (doc_id, start, n_tokens, ids_crc32) of every row.

    Starts are counted within partitions; the totals of the partitions (one row
    each, so bounded by their number) are added up and joined.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-shards")
    docs = narrow(docs, id_col, text_col)
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    write_shards(docs, tokenizer_path, scratch.path("shards"), end_id)
    read = scratch.table(read_shards(spark, scratch.path("shards")).drop("ids"), "read")
    totals = read.groupBy("partition").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("partition", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return read.join(checked_broadcast(offsets), "partition").select(
        "doc_id", (F.col("offset") + F.col("start_in_partition")).alias("start"), "n_tokens", "ids_crc32"
    )
