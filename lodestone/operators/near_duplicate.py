"""Near-duplicate screening with exact rational thresholds.

Probes and references are token streams.  Pairs that can matter share a shingle,
so candidates come from an equi-join on the rarest shingle hashes; equal streams,
however short, come from a join on the stream's hash.  Thresholds are compared by
whole-number products, never by division.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..code.lexing import KEYWORDS, lexed
from ..session import small_side
from . import graph

# Fixed values of the screening policy.
CONTENT_WIDTH, SHAPE_WIDTH = 7, 11
POLICY = {
    "hard_jaccard": (7, 10), "hard_containment": (4, 5), "hard_shared": 32, "run_tokens": 64, "run_coverage": (3, 5),
    "gray_jaccard": (1, 2), "gray_containment": (3, 5), "gray_shared": 16, "shape_containment": (9, 10), "shape_shared": 48, "least_shingles": 32,
}
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
PRIORITY = {"clear": 0, "abstain": 1, "gray": 2, "duplicate": 3}


def tokens(text: Column) -> Column:
    """Words and single other characters."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"), F.lit(1))


def shape(stream: Column) -> Column:
    """The stream with identifiers and numbers masked."""
    return F.transform(stream, lambda t: F.when(t.rlike(r"^[\p{L}_]"), F.lit("<id>")).when(t.rlike(r"^\p{N}"), F.lit("<n>")).otherwise(t))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _finished(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the sum moves all bits of the hash."""
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def shingle_hashes(streams: pa.Array, width: int) -> pa.Array:
    """Sorted distinct hashes of the runs of ``width`` tokens of each stream; a null or short stream has none.

    Each distinct token of a batch is hashed once, and runs are sums over shifted arrays.
    """
    coded = streams.flatten().fill_null("\u0000").dictionary_encode()
    words = pd.util.hash_array(np.array(coded.dictionary.to_pylist() or [""], dtype=object), categorize=False).astype(np.uint64)
    tokens = words[coded.indices.to_numpy(zero_copy_only=False)]
    sizes = streams.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - width + 1, 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    first = np.repeat(ends - sizes, counts) + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes = np.zeros(len(row), np.uint64)
    for k in range(width):
        hashes = _finished(hashes * _ODD + tokens[first + k]) if len(row) else hashes
    return _sets_of(hashes, counts)


def _sets_of(hashes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Sorted distinct values of runs of ``counts`` hashes; ``hashes`` is sorted in place."""
    ends = np.cumsum(counts)
    for start, stop in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if stop - start > 1:
            hashes[start:stop].sort()
    row = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(counts)))))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes[new].view(np.int64)))


#: Tokens that are hashed at once; each takes some 100 bytes of arrays meanwhile.
PART = 1 << 19


def token_parts(batch: pa.Array) -> Iterator[pa.Array]:
    """The streams of a batch in parts of ``PART`` tokens, or one stream."""
    part = np.cumsum(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // PART
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(batch)]
    for start, stop in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(start, stop - start)


def shingles(stream: Column, width: int) -> Column:
    """Hashes of the distinct runs of ``width`` tokens."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in token_parts(batch):
                yield shingle_hashes(part, width)

    return F.arrow_udf(run, "array<bigint>", F.ArrowUDFType.SCALAR_ITER)(stream.cast("array<string>"))


#: Bytes of text whose words are hashed at once, and the longest word that is read in blocks of eight bytes.
TEXT_PART, LONG_WORD = 1 << 23, 256
_BLANK = np.isin(np.arange(256), [9, 10, 13, 32])
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, in order, and how many words each text has.

    Words stand between blanks, tabs and line ends.  They are found in the bytes of all
    texts together and never become objects.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.zeros(offsets[-1] - offsets[0] + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_BLANK[data[:-8]]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    begins[offsets[:-1][full]] = inside[offsets[:-1][full]]
    ends[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    at = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - at
    eight = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))
    hashes, rows = sizes.astype(np.uint64), np.flatnonzero(sizes <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        rows = rows[sizes[rows] > k]
        if not len(rows):
            break
        hashes[rows] = _finished(hashes[rows] * _ODD + (eight[at[rows] + k] & _KEPT[np.minimum(sizes[rows] - k, 8)]))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        hashes[i] = pd.util.hash_array(np.array([data[at[i] : at[i] + sizes[i]].tobytes().decode()], dtype=object), categorize=False)[0]
    return hashes, np.diff(np.searchsorted(at, offsets))


def text_shingles(texts: pa.Array, width: int) -> pa.Array:
    """Sorted distinct hashes of the runs of ``width`` words of each text."""
    words, sizes = word_hashes(texts)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width if len(runs) else 0):
        runs = _finished(runs * _ODD + words[k : k + len(runs)])
    counts = np.maximum(sizes - width + 1, 0)
    row = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts)
    return _sets_of(runs[np.arange(len(row)) + first[row]], counts)


def word_shingles(text: Column, width: int) -> Column:
    """Hashes of the distinct runs of ``width`` words of a text, words being what stands between blanks, tabs and line ends."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            part = np.cumsum(pc.binary_length(batch).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // TEXT_PART
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(batch)]
            yield pa.concat_arrays([text_shingles(batch.slice(start, stop - start), width) for start, stop in zip(cuts, cuts[1:], strict=False)])

    return F.arrow_udf(run, "array<bigint>", F.ArrowUDFType.SCALAR_ITER)(text)


def shared_counts(probes: DataFrame, references: DataFrame) -> DataFrame:
    """(probe_id, ref_id, shared, n_probe, n_ref) of pairs (id, set array<long>) that share an element.

    The join is on the element; elements that only one side has never meet.
    """
    p = probes.select(F.col("id").alias("probe_id"), F.size("set").alias("n_probe"), F.explode("set").alias("h"))
    r = references.select(F.col("id").alias("ref_id"), F.size("set").alias("n_ref"), F.explode("set").alias("h"))
    pairs = p.join(r, "h")
    return pairs.groupBy("probe_id", "ref_id").agg(F.count("*").alias("shared"), F.first("n_probe").alias("n_probe"), F.first("n_ref").alias("n_ref"))


def similar_pairs(sets: DataFrame, policy: dict = POLICY) -> DataFrame:
    """(probe_id, ref_id, shared, n_probe, n_ref) of all pairs (id, set) that ``decide`` can call more than clear; probe_id < ref_id.

    Each such pair shares the gray containment of its smaller set, and ``gray_shared``
    elements at least.  So one of the smaller set's rarest elements, all but that
    many and one more, is in the larger set: only these are joined, so elements
    that many texts have (boilerplate) make no pairs unless a text has little
    else.  Candidates are then counted exactly.
    """
    share, least = policy["gray_containment"], policy["gray_shared"]
    folder = graph.work_folder(sets.sparkSession)
    elements = sets.select("id", F.size("set").alias("n"), F.explode("set").alias("h"))
    shared = elements.withColumn("c", F.count("*").over(Window.partitionBy("h"))).where("c > 1")  # dealt once
    needed = F.greatest(F.lit(least), F.ceil(F.col("n") * share[0] / share[1]))
    listed = shared.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("l")).where(F.size("l") >= least)
    listed = graph.written(listed.select("id", "n", F.col("l.h").alias("l")), f"{folder}/shared")
    places = (F.size("l") - needed + 1).cast("int")  # elements of no other set come first and need no place
    prefix = listed.where(places > 0).select("id", "n", F.explode(F.slice("l", F.lit(1), places)).alias("h"))
    a, b = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "h"), listed.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.explode("l").alias("h"))
    pairs = a.join(b, "h").where("na < nb or na = nb and a < b").select("a", "b").distinct()
    # Of each pair the smaller set moves to the larger one.
    x, y = listed.select(F.col("id").alias("a"), F.col("l").alias("la"), F.col("n").alias("na")), listed.select(F.col("id").alias("b"), F.col("l").alias("lb"), F.col("n").alias("nb"))
    both = pairs.join(x, "a").join(y, "b")
    either = lambda p, q: F.when(F.col("a") < F.col("b"), F.col(p)).otherwise(F.col(q))
    counted = both.select(
        F.least("a", "b").alias("probe_id"), F.greatest("a", "b").alias("ref_id"), F.size(F.array_intersect("la", "lb")).cast("long").alias("shared"), either("na", "nb").alias("n_probe"), either("nb", "na").alias("n_ref")
    )
    return graph.written(counted, f"{folder}/counted").where("shared > 0")  # written, or each use of the count would count again


def at_least(part: Column, whole: Column, share: tuple[int, int]) -> Column:
    return (share[1] * part >= share[0] * whole) & (whole > 0)


def decide(pairs: DataFrame, policy: dict = POLICY) -> DataFrame:
    """Adds signals and decision (duplicate, gray, clear) from shared, n_probe, n_ref and, where there, equal, run and n_tokens (of the shorter stream), shape_shared, shape_probe, shape_ref."""
    s, a, b = F.col("shared"), F.col("n_probe"), F.col("n_ref")
    union, small = a + b - s, F.least("n_probe", "n_ref")
    hard, gray = s >= policy["hard_shared"], s >= policy["gray_shared"]
    signals = [
        F.when(F.col("equal"), "equal_stream") if "equal" in pairs.columns else F.lit(None),
        F.when(hard & at_least(s, union, policy["hard_jaccard"]), "hard_jaccard"),
        F.when(hard & at_least(s, small, policy["hard_containment"]), "hard_containment"),
        F.when((F.col("run") >= policy["run_tokens"]) & at_least(F.col("run"), F.col("n_tokens"), policy["run_coverage"]), "hard_run") if "run" in pairs.columns else F.lit(None),
        F.when(gray & at_least(s, union, policy["gray_jaccard"]), "gray_jaccard"),
        F.when(gray & at_least(s, small, policy["gray_containment"]), "gray_containment"),
    ]
    if "shape_shared" in pairs.columns:
        alike = F.col("shape_shared")
        signals.append(F.when((alike >= policy["shape_shared"]) & at_least(alike, F.least("shape_probe", "shape_ref"), policy["shape_containment"]), "gray_shape"))
    found = pairs.withColumn("signals", F.array_sort(F.filter(F.array(*signals).cast("array<string>"), lambda x: x.isNotNull())))
    strong = F.exists("signals", lambda x: ~x.startswith("gray"))
    return found.withColumn("decision", F.when(strong, "duplicate").when(F.size("signals") > 0, "gray").otherwise("clear"))


def axis_decision(comparisons: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, decision): any duplicate, else any gray, else abstain (issue, unfinished inventory, too short), else clear.

    ``comparisons`` (probe_id, decision), ``probes`` (probe_id, issue, incomplete, n_shingles).
    """
    best = comparisons.groupBy("probe_id").agg(F.bool_or(F.col("decision") == "duplicate").alias("dup"), F.bool_or(F.col("decision") == "gray").alias("gray"))
    j = probes.join(best, "probe_id", "left").fillna(False, ["dup", "gray"])
    decision = (
        F.when(F.col("issue"), "abstain").when(F.col("dup"), "duplicate").when(F.col("gray"), "gray")
        .when(F.col("incomplete") | (F.col("n_shingles") < POLICY["least_shingles"]), "abstain").otherwise("clear")
    )
    return j.select("probe_id", decision.alias("decision"))


def normalized_body(text: Column) -> Column:
    """SHA-256 of the text in NFC, with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(nfc(text), r"[ \t\n\r\f\x0B]+", " ")), 256)


def template_cluster(text: Column) -> Column:
    """SHA-256 of a text's shape stream: its tokens, words that aren't keywords masked, literals by their kind."""
    return F.sha2(F.array_join(lexed(text)["shape"], " "), 256)


def nfc(text: Column) -> Column:
    """NFC, for which the JVM functions have nothing."""

    def normalize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(normalize, "string", F.PandasUDFType.SCALAR_ITER)(text)


def longest_run(a: list[str], b: list[str]) -> int:
    """The length of the longest run of tokens that both streams hold, by halving; memory is linear in the streams.

    Tokens are numbered; runs of equal rolling hash are compared token by token.
    """
    numbers: dict[str, int] = {}
    x, y = ([numbers.setdefault(t, len(numbers) + 1) for t in s] for s in (a, b))

    def starts(s: list[int], n: int) -> Iterator[tuple[int, int]]:
        value, top = 0, pow(_BASE, n, _PRIME)
        for i, t in enumerate(s):
            value = (value * _BASE + t - (s[i - n] * top if i >= n else 0)) % _PRIME
            if i >= n - 1:
                yield value, i - n + 1

    def common(n: int) -> bool:
        seen: dict[int, list[int]] = {}
        for value, i in starts(x, n):
            at = seen.setdefault(value, [])
            if not at or all(x[j : j + n] != x[i : i + n] for j in at):
                at.append(i)
        return any(x[i : i + n] == y[j : j + n] for value, j in starts(y, n) for i in seen.get(value, ()))

    low, high = 0, min(len(a), len(b))
    while low < high:  # a common run of n implies one of n - 1
        mid = (low + high + 1) // 2
        low, high = (mid, high) if common(mid) else (low, mid - 1)
    return low


def longest_runs(pairs: DataFrame, a: str = "probe_tokens", b: str = "ref_tokens") -> DataFrame:
    """Candidate pairs with ``run``, the longest common run of their token arrays; a task has the tokens of one pair as objects."""

    def runs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([longest_run(p.as_py(), q.as_py()) for p, q in zip(x, y, strict=True)], pa.int32())

    return pairs.withColumn("run", F.arrow_udf(runs, "int", F.ArrowUDFType.SCALAR_ITER)(a, b))


def candidate_pairs(sets: DataFrame, path: str) -> DataFrame:
    """(probe, ref), distinct: keys of two sides that can share as many elements as the smaller one needs.

    ``sets`` (key, side, set, size, needed): side 0 holds probes, 1 references; the
    one of no larger ``size`` must share ``needed`` elements.  So the other has one
    of its rarest elements, all but that many and one more, and only those are
    joined.  ``path`` takes the elements that both sides have.
    """
    elements = sets.select("key", "side", "size", "needed", F.explode("set").alias("h"))
    common = elements.groupBy("h").agg(F.count("*").alias("c"), F.min("side").alias("first"), F.max("side").alias("last")).where("first <> last").select("h", "c")
    common = graph.written(common, f"{path}-common")
    shared = graph.written(elements.join(small_side(common), "h"), path)
    listed = shared.groupBy("key", "side", "size", "needed").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("l"))
    places = (F.size("l") - F.col("needed") + 1).cast("int")
    prefix = listed.where(places > 0).select("key", "side", "size", F.explode(F.slice("l", F.lit(1), places)).alias("e")).select("key", "side", "size", "e.h")
    other = shared.select(F.col("key").alias("other"), F.col("side").alias("other_side"), F.col("size").alias("other_size"), "h")
    met = prefix.join(other, "h").where("side <> other_side and size <= other_size")
    return met.select(F.when(F.col("side") == 0, F.col("key")).otherwise(F.col("other")).alias("probe"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("key")).alias("ref")).distinct()


def lexical_shape(stream: Column) -> Column:
    """The shape of a lexer's content stream: words that aren't keywords masked, everything else as it is."""
    return F.transform(stream, lambda t: F.when(t.rlike(r"^[\p{L}_$]") & ~t.isin(*sorted(KEYWORDS)), F.lit("<id>")).otherwise(t))


def lexical_probes(texts: DataFrame) -> DataFrame:
    """(id, tokens, issue) of ``texts`` (id, text) by the lexer; an unfinished string or comment, or a control character, is an issue."""
    return texts.select("id", lexed(F.coalesce("text", F.lit(""))).alias("x")).select("id", F.col("x.content").alias("tokens"), (F.size("x.issues") > 0).alias("issue"))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in a sorted table."""
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def met_shingles(stream: Column, width: int, known: Broadcast) -> Column:
    """struct(n, met): the number of distinct runs of ``width`` tokens, and the hashes of those in ``known``, a broadcast sorted array; of all if that is None."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.StructArray]:
        table = known.value
        for batch in batches:
            for part in token_parts(batch):
                sets = shingle_hashes(part, width)
                sizes, met = sets.value_lengths(), sets
                if table is not None:
                    values = sets.values.to_numpy(zero_copy_only=False)
                    hit = _among(values, table)
                    row = np.repeat(np.arange(len(sets)), sizes.to_numpy(zero_copy_only=False))
                    offsets = np.concatenate(([0], np.cumsum(np.bincount(row[hit], minlength=len(sets)))))
                    met = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values[hit]))
                yield pa.StructArray.from_arrays([sizes, met], names=["n", "met"])

    return F.arrow_udf(run, "struct<n: int, met: array<bigint>>", F.ArrowUDFType.SCALAR_ITER)(stream.cast("array<string>"))


def screen(probes: DataFrame, references: DataFrame, policy: dict = POLICY, shape_of: Callable[[Column], Column] = shape, most: int = 2_000_000) -> DataFrame:
    """(id, n_shingles, decision) of every probe (id, tokens, optionally issue) against references (tokens).

    Equal streams are compared once.  duplicate: an equal stream, content shingles
    or a common run; gray: fewer shared shingles, or the shape (identifiers and
    numbers masked); abstain: an issue, or too short to be clear.  A null or empty
    stream equals nothing.  Candidates for a run are exact too: a run that covers
    its share of a stream leaves out at most the rest of its positions, so all other
    distinct shingles are shared.  Only pairs that are still open are scanned for it.

    Of a probe only its number of shingles and those that a reference has matter.  The
    distinct shingles of the references go to all tasks where they are at most ``most``,
    and a probe's others never leave the task; beyond that all are kept and joined.
    Tokens of probes are never stored: those of open pairs are made once more.
    """
    spark = probes.sparkSession
    folder = graph.work_folder(spark)
    issue = F.coalesce("issue", F.lit(False)) if "issue" in probes.columns else F.lit(False)
    stream = F.coalesce("tokens", F.array().cast("array<string>"))
    keyed = lambda df, *cols: df.select(*cols, stream.alias("tokens")).withColumn("key", F.sha2(F.array_join("tokens", "\u0001"), 256))
    shaped = lambda df: df.withColumn("masked", shape_of(F.col("tokens"))).withColumn("shape_key", F.sha2(F.array_join("masked", "\u0001"), 256))

    one = shaped(keyed(references).groupBy("key").agg(F.first("tokens").alias("tokens")))
    one = one.select("key", "tokens", F.size("tokens").alias("n_tokens"), shingles(F.col("tokens"), CONTENT_WIDTH).alias("content"), shingles(F.col("masked"), SHAPE_WIDTH).alias("shape"), "shape_key")
    right = graph.written(one, f"{folder}/references").withColumns({"n_content": F.size("content"), "n_shape": F.size("shape")})

    def known(column: str) -> Broadcast:
        first = [r[0] for r in right.select(F.explode(column)).distinct().limit(most + 1).collect()]
        return spark.sparkContext.broadcast(np.sort(np.array(first, np.int64)) if len(first) <= most else None)

    asked = shaped(keyed(probes, "id", issue.alias("issue"))).select(
        "id", "issue", "key", "shape_key", F.size("tokens").alias("n_tokens"), met_shingles(F.col("tokens"), CONTENT_WIDTH, known("content")).alias("content"), met_shingles(F.col("masked"), SHAPE_WIDTH, known("shape")).alias("shape")
    )
    asked = graph.written(asked, f"{folder}/probes").select("id", "issue", "key", "shape_key", "n_tokens", F.col("content.n").alias("n_content"), F.col("content.met").alias("content"), F.col("shape.n").alias("n_shape"), F.col("shape.met").alias("shape"))
    columns = ["n_tokens", "n_content", "content", "n_shape", "shape"]
    left = asked.where((F.size("content") > 0) | (F.size("shape") > 0)).groupBy("key").agg(*(F.first(c).alias(c) for c in columns))
    left = graph.written(left, f"{folder}/streams")  # of the probes that can meet a reference
    sides = left.select("key", *columns, F.lit(0).alias("side")).unionByName(right.select("key", *columns, F.lit(1).alias("side")))

    def needing(column: str, size: Column, needed: Column, least: int = 0) -> DataFrame:
        rows = sides.where(size >= least).select("key", "side", F.col(column).alias("set"), size.alias("size"), needed.cast("int").alias("needed"))
        return candidate_pairs(rows, f"{folder}/elements-{column}-{least}")

    of = lambda n, name: F.ceil(n * policy[name][0] / policy[name][1])
    n_content, n_shape, n_tokens = F.col("n_content"), F.col("n_shape"), F.col("n_tokens")
    pairs = needing("content", n_content, F.greatest(F.lit(policy["gray_shared"]), of(n_content, "gray_containment")))
    pairs = pairs.union(needing("content", n_tokens, F.greatest(F.lit(1), n_content - (n_tokens - of(n_tokens, "run_coverage"))), policy["run_tokens"]))
    pairs = pairs.union(needing("shape", n_shape, F.greatest(F.lit(policy["shape_shared"]), of(n_shape, "shape_containment")))).distinct()

    a = left.select(F.col("key").alias("probe"), F.col("content").alias("pc"), F.col("n_content").alias("n_probe"), F.col("shape").alias("ps"), F.col("n_shape").alias("shape_probe"), F.col("n_tokens").alias("pn"))
    b = right.select(F.col("key").alias("ref"), F.col("content").alias("rc"), F.col("n_content").alias("n_ref"), F.col("shape").alias("rs"), F.col("n_shape").alias("shape_ref"), F.col("n_tokens").alias("rn"))
    shared = lambda x, y: F.size(F.array_intersect(x, y))
    counted = pairs.join(a, "probe").join(b, "ref").select("probe", "ref", shared("pc", "rc").alias("shared"), "n_probe", "n_ref", shared("ps", "rs").alias("shape_shared"), "shape_probe", "shape_ref", F.least("pn", "rn").alias("n_tokens"))
    decided = graph.written(decide(counted, policy), f"{folder}/decided")
    unsure = decided.where((F.col("decision") != "duplicate") & (F.col("n_tokens") >= policy["run_tokens"]) & (F.col("shared") > 0)).drop("signals", "decision")
    ids = asked.join(small_side(unsure.select(F.col("probe").alias("key")).distinct()), "key", "left_semi").select(F.col("id").alias("open_id")).distinct()
    again = keyed(probes.join(small_side(ids), F.col("id").eqNullSafe(F.col("open_id")), "left_semi")).groupBy("key").agg(F.first("tokens").alias("tokens"))
    words = lambda df, key, name: df.select(F.col("key").alias(key), F.col("tokens").alias(name))
    scanned = longest_runs(unsure.join(words(again, "probe", "probe_tokens"), "probe").join(words(right, "ref", "ref_tokens"), "ref"))
    found = decided.select("probe", "decision").union(decide(scanned.drop("probe_tokens", "ref_tokens"), policy).select("probe", "decision"))
    best = found.groupBy(F.col("probe").alias("key")).agg(F.bool_or(F.col("decision") == "duplicate").alias("hard"), F.bool_or(F.col("decision") == "gray").alias("soft"))
    same = right.where("n_tokens > 0").select("key", F.lit(True).alias("equal"))
    alike = right.select("shape_key").distinct().withColumn("alike", F.lit(True))
    settled = asked.select("id", "issue", "key", "shape_key", "n_tokens", n_content.alias("n_shingles")).join(best, "key", "left").join(small_side(same), "key", "left").join(small_side(alike), "shape_key", "left")
    decision = (
        F.when(F.col("issue"), "abstain").when(F.col("equal") | F.col("hard"), "duplicate")
        .when(F.col("soft") | (F.col("alike") & (F.col("n_tokens") >= policy["run_tokens"])), "gray")
        .when(F.col("n_shingles") < policy["least_shingles"], "abstain").otherwise("clear")
    )
    return settled.fillna(False, ["hard", "soft", "equal", "alike"]).select("id", "n_shingles", decision.alias("decision"))


def contaminated(documents: DataFrame, benchmark: DataFrame, width: int, most: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shared): documents that share shingles with a benchmark, and how many distinct ones.

    The distinct benchmark shingles, 8 bytes each, go to all tasks where they are at most
    ``most``: a document's shingles are looked up where they are made and never become rows.
    Beyond that they are exploded and joined.
    """
    known = benchmark.select(F.explode(shingles(tokens(F.lower("text")), width)).alias("h")).distinct()
    own = tokens(F.lower("text"))
    first = [r[0] for r in known.limit(most + 1).collect()]
    if len(first) > most:
        docs = documents.select("doc_id", F.explode(shingles(own, width)).alias("h"))
        return docs.join(known, "h", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_shared"))
    shared = documents.sparkSession.sparkContext.broadcast(np.sort(np.array(first, np.int64)))

    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = shared.value
        for batch in batches:
            found = shingle_hashes(batch, width)
            values, sizes = found.values.to_numpy(zero_copy_only=False), found.value_lengths().to_numpy(zero_copy_only=False)
            hit = _among(values, table)
            yield pa.array(np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=hit, minlength=len(sizes)).astype(np.int64))

    n_shared = F.arrow_udf(counts, "bigint", F.ArrowUDFType.SCALAR_ITER)(own)
    return documents.select("doc_id", n_shared.alias("n_shared")).where("n_shared > 0").groupBy("doc_id").agg(F.max("n_shared").alias("n_shared"))
