"""Substring dedup: removes runs of words that occur earlier, by suffix automata.

A window of ``WINDOW`` words is removed if the same words also start earlier
(smaller doc_id, or an earlier place of the same document); every word that such
a window covers goes.  Nothing is kept whole in one place:

1. Each window names an anchor, the smallest hash among its runs of ``GRAM``
   words.  Equal windows have equal anchors at equal places, so only windows of
   the same anchor need to meet.  Consecutive windows with the same anchor are
   one row, with a hash of the words they cover (their context).
2. Rows meet by anchor.  A context that came earlier in its group is removed
   as it is; so only the first row of each context goes on, and only if its group
   has several contexts.
3. For these few the words are fetched.  The contexts of a group are a reference
   shard: in order, each is streamed through the suffix automaton of the earlier
   ones, whose matching statistics give the length of the longest earlier match
   that ends at each word; where it is ``WINDOW`` or more, a window is removed.
4. Groups of more than ``HOT`` rows are split by a hash of the document.  Windows
   that are first in their part of such a group are compared by hash across the
   parts, with a pre-aggregated minimum.

The corpus as its own reference has no size bound, so its automata live in the
tasks that their anchors are dealt to.  ``remove_reference_spans`` is for a bounded
reference, whose automata are broadcast.

Words are 64-bit hashes.  Null and empty texts have no words.  Rows that repeat a
doc_id are in the order of their texts (null ids come first); rows that repeat
both are one document, listed as often.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .scratch import Scratch, checked_broadcast, narrow, small_batches

WINDOW = 20
GRAM = 8
#: Rows of an anchor, or of a part of one, that one automaton may be built from.
HOT = 4096
#: Words of a reference that is broadcast, and of one of its automata.
REFERENCE_WORDS, SHARD_WORDS = 1_000_000, 200_000


class SuffixAutomaton:
    """All runs of words of the sequences added so far."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, p: int, q: int, word: int) -> int:
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        clone = len(self.next) - 1
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
                continue
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            new, p = len(self.next) - 1, last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
            last = new

    def matches(self, words: list[int]) -> list[int]:
        """For each word the length of the longest run ending there that occurs in what was added."""
        state, n, out = 0, 0, []
        next_, link, length = self.next, self.link, self.length
        for word in words:
            while state and word not in next_[state]:
                state = link[state]
                n = length[state]
            to = next_[state].get(word)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out


def _contexts(texts: list[str | None], window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: first row, hashes, first words of texts, and of each context its row, first window, number of windows, anchor's place."""
    for a, b, raws in W.blocks(texts):
        hashes, at = W.hash_words(raws)
        n = len(hashes) - window + 1
        if n <= 0:
            continue
        mark = np.zeros(len(hashes) + 1, np.int64)
        full = np.flatnonzero(np.diff(at) >= window)
        mark[at[full]] += 1
        mark[at[full + 1] - window + 1] -= 1
        start = np.flatnonzero(np.cumsum(mark[:-1])[:n] > 0)
        if not len(start):
            continue
        grams = W.runs(hashes, gram)
        anchor = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(1)[start] + start
        cut = np.flatnonzero(np.diff(anchor, prepend=-1))
        count = np.diff(np.append(cut, len(start)))
        lo = start[cut]
        yield a, hashes, at, np.searchsorted(at, lo, "right") - 1, lo, count, anchor[cut]


def _context_hash(hashes: np.ndarray, lo: np.ndarray, end: np.ndarray, shape: np.ndarray) -> np.ndarray:
    n = len(hashes)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * W._powers(W._BASE, n))))
    return W.mix((total[end] - total[lo]) * W._powers(W._UNBASE, n)[lo] + shape.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _anchored(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, context, doc, lo, shape); shape is the number of windows, and the anchor's distance times 64."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc"].to_numpy()
            for first, hashes, at, row, lo, count, anchor in _contexts(batch["text"].tolist(), window, gram):
                shape = count + 64 * (anchor - lo)
                yield pd.DataFrame(
                    {
                        "anchor": W.runs(hashes, gram)[anchor].view(np.int64),
                        "context": _context_hash(hashes, lo, lo + count + window - 1, shape).view(np.int64),
                        "doc": ids[first + row], "lo": (lo - at[row]).astype(np.int32), "shape": shape.astype(np.int32),
                    }
                )

    return docs.select("doc", "text").mapInPandas(rows, "anchor long, context long, doc long, lo int, shape int")


def _fetched(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``wanted`` (group, salt, parts, doc, lo, n) with the word hashes of each context."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "salt", "parts", "lo", "n")).alias("places"))
    texts = docs.select("doc", "text").join(checked_broadcast(lists.select("doc")), "doc", "left_semi").join(lists, "doc")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = batch["places"].tolist()
            for a, b, raws in W.blocks(batch["text"].tolist()):
                hashes, at = W.hash_words(raws)
                out = []
                for i in range(a, b):
                    own = hashes[at[i - a] : at[i - a + 1]]
                    out += [(p["anchor"], p["salt"], p["parts"], batch["doc"].iloc[i], p["lo"], p["n"], own[p["lo"] : p["lo"] + p["n"] + window - 1].tobytes()) for p in places[i]]
                yield pd.DataFrame(out, columns=["anchor", "salt", "parts", "doc", "lo", "n", "words"])

    return texts.mapInPandas(rows, "anchor long, salt int, parts int, doc long, lo int, n int, words binary")


def _matched(contexts: DataFrame, window: int) -> DataFrame:
    """(doc, lo, mask, open): the windows of each context that match an earlier one of its group.

    ``open`` has the hashes of the others where a group was split.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, automaton = None, None
        for batch in batches:
            out = []
            for anchor, salt, parts, doc, lo, n, raw in batch.itertuples(index=False, name=None):
                hashes = np.frombuffer(raw, np.uint64)
                words = hashes.tolist()
                mask = 0
                if group != (anchor, salt):
                    group, automaton = (anchor, salt), SuffixAutomaton()
                else:
                    ends = automaton.matches(words)
                    mask = sum(1 << i for i in range(n) if ends[i + window - 1] >= window)
                automaton.add(words)
                left = W.runs(hashes, window).view(np.int64)[:n] if parts > 1 else []
                out.append((doc, lo, mask, [h if not mask >> i & 1 else None for i, h in enumerate(left)]))
            yield pd.DataFrame(out, columns=["doc", "lo", "mask", "open"])

    dealt = contexts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "doc", "lo")
    return dealt.mapInPandas(rows, "doc long, lo int, mask long, open array<long>")


def _removed(docs: DataFrame, scratch: Scratch, window: int, gram: int, hot: int) -> DataFrame:
    """(doc, lo, mask): bit i says that the window starting at word lo + i of the document goes."""
    rows = _anchored(docs, window, gram)
    counts = rows.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > hot)
    large = scratch.table(counts.select("anchor", F.ceil(F.col("c") / hot).cast("int").alias("parts")), "large")
    dealt = rows.join(checked_broadcast(large), "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("salt", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc"), F.col("parts"))).otherwise(0).cast("int"))
    dealt = dealt.repartition("anchor", "salt")
    by_context = Window.partitionBy("anchor", "salt", "context")
    by_group = Window.partitionBy("anchor", "salt").orderBy("context").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = dealt.withColumn("k", F.row_number().over(by_context.orderBy("doc", "lo")))
    seen = seen.withColumn("n_rows", F.count("*").over(by_group)).withColumn("n_contexts", F.sum((F.col("k") == 1).cast("int")).over(by_group))
    met = scratch.table(seen.where("n_rows > 1 or parts > 1").drop("context", "n_rows"), "met")
    n = F.col("shape") % 64
    again = met.where("k > 1").select("doc", "lo", (F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1).alias("mask"))
    wanted = met.where("k = 1 and (n_contexts > 1 or parts > 1)").select("anchor", "salt", "parts", "doc", "lo", n.alias("n"))
    matched = scratch.table(_matched(_fetched(docs, wanted, window), window), "matched")
    inside = matched.where("mask <> 0").select("doc", "lo", "mask")
    left = matched.where("size(open) > 0").select("doc", F.col("lo"), F.posexplode("open").alias("i", "h")).where("h is not null")
    first = left.groupBy("h").agg(F.min(F.struct("doc", (F.col("lo") + F.col("i")).alias("at"))).alias("f"), F.count("*").alias("c")).where("c > 1")
    later = left.join(first, "h").where("doc <> f.doc or lo + i <> f.at").select("doc", "lo", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i")).alias("mask"))
    return again.unionByName(inside).unionByName(later)


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, doc_id, n, text): doc orders the documents; n is how often the row is listed."""
    repeated = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if repeated.isEmpty():
        return docs.select(F.col("doc_id").alias("doc"), "doc_id", F.lit(1).alias("n"), "text")
    rows = docs.groupBy("doc_id", F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").cast("int").alias("n"))
    ordered = rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    return scratch.table(ordered.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "n", "text"), "numbered")


def _kept_words(raw: bytes, places: list | None, window: int) -> tuple[list[bytes], int]:
    """The words that stay, and the number of all."""
    words = raw.split()
    if places is None or not len(places):
        return words, len(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for p in places:
        lo, mask = p["lo"], p["mask"]
        while mask:
            low = mask & -mask
            i = lo + low.bit_length() - 1
            cover[i] += 1
            cover[i + window] -= 1
            mask ^= low
    gone = np.cumsum(cover[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], len(words)


def _digests(docs: DataFrame, removed: DataFrame, window: int, with_text: bool) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]) of every row."""
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            places = batch["places"].tolist() if "places" in batch else [None] * len(batch)
            for doc_id, n, text, p in zip(batch["doc_id"], batch["n"], batch["text"], places, strict=True):
                kept, total = _kept_words((text if isinstance(text, str) else "").encode(), p, window)
                line = b" ".join(kept)
                out += [(doc_id, total, total - len(kept), hashlib.sha256(line).hexdigest(), *[line.decode()] * with_text)] * n
            yield pd.DataFrame(out, columns=[f.split()[0] for f in fields.split(", ")])

    lists = removed.groupBy("doc").agg(F.collect_list(F.struct("lo", "mask")).alias("places"))
    ids = checked_broadcast(removed.select("doc").distinct())
    plain = docs.select("doc", F.col("doc_id").cast("string"), "n", "text")  # a null stays a null in pandas
    untouched = plain.join(ids, "doc", "left_anti").drop("doc")
    touched = plain.join(ids, "doc", "left_semi").join(lists, "doc").drop("doc")
    text_fields = fields.replace("doc_id long", "doc_id string")
    both = untouched.mapInPandas(rows, text_fields).unionByName(touched.mapInPandas(rows, text_fields))
    return both.withColumn("doc_id", F.col("doc_id").cast("long"))


def dedup_substrings(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, and with ``with_text`` the kept words as ``text``."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = _numbered(narrow(docs, id_col, text_col), scratch)
    removed = scratch.table(_removed(rows, scratch, window, gram, hot), "removed")
    return _digests(rows, removed, window, with_text)


def remove_reference_spans(docs: DataFrame, reference: list[str], window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``docs`` without the maximal spans of ``window`` words and more that occur in a bounded reference.

    The reference is cut into shards of about ``SHARD_WORDS`` words (a text is never
    cut); their automata are built in the workers from a broadcast of the words.
    A reference of more than ``REFERENCE_WORDS`` words is refused: put it before
    the corpus, under smaller ids, and use ``dedup_substrings``.  Null texts stay null.
    """
    shards, size, total = [[]], 0, 0
    for text in reference:
        words = (text or "").encode().split()
        total += len(words)
        if size and size + len(words) > SHARD_WORDS:
            shards.append([])
            size = 0
        shards[-1].append(b" ".join(words))
        size += len(words)
    if total > REFERENCE_WORDS:
        raise ValueError("the reference is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(shards)

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automata = []
        for shard in shared.value:
            automata.append(SuffixAutomaton())
            for raw in shard:
                automata[-1].add(W.hash_words([raw])[0].tolist())
        for batch in batches:
            yield pd.Series([_without(t, automata, window) for t in batch], dtype=object)

    return docs.withColumn(text_col, F.pandas_udf(texts, T.StringType(), F.PandasUDFType.SCALAR_ITER)(docs[text_col].cast("string")))


def _without(text, automata: list[SuffixAutomaton], window: int):
    if not isinstance(text, str):
        return None
    words = text.encode().split()
    hashes = W.hash_words([text.encode()])[0].tolist()
    gone = np.zeros(len(words) + 1, np.int64)
    for automaton in automata:
        for i, n in enumerate(automaton.matches(hashes)):
            if n >= window:
                gone[i - n + 1] += 1
                gone[i + 1] -= 1
    cover = np.cumsum(gone[:-1]) > 0
    if not cover.any():
        return text
    return b" ".join(w for w, g in zip(words, cover.tolist(), strict=True) if not g).decode()
