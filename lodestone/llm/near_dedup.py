"""Near-duplicates by a MinHash signature-coordinate inverted join.

A document's set is that of its distinct word shingles, as 64-bit hashes.  Equal
sets are one node from the start.  Each node has a signature of ``K`` coordinates
(smallest hash under K functions), and is posted under its (coordinate, value)
pairs.  A pair of nodes is retained if at least ``T`` coordinates collide, where T
is the largest number that a linked pair misses with a chance of at most ``MISS``.

Prefix: with a node's pairs ordered from rare to frequent, two nodes with T
collisions share one of their first K - T + 1 pairs, so only these are posted;
pairs that no other node has need no posting, but count as places.  The very
frequent ones (boilerplate) are thereby not posted unless a node has little else.
Skip: a list is merged into components of retained pairs, not into pairs.  Nodes
of the largest component lead for as long as that brings in others; then each
node still outside is compared with all of the list.  Pairs of one component are
skipped, and what a list yields is a tree for each component, never its pairs.

Components over all lists are the candidate clusters: every retained pair lies
within one.  The full sets of a cluster are merged by the same routine, with
``den * intersection >= num * union`` in the place of collisions, so each link is
confirmed on full sets, and no link between components is left out.

One task takes at most ``PART_NODES`` nodes (``PART_SHINGLES`` shingles) of a list
or cluster.  A larger one is dealt out by a hash of the node, with the same few
leaders in every part, and is merged in each part; after that only the nodes
outside its largest component are compared with all parts, in chunks.  Rows
are repeated for leaders and for such nodes alone.

Null and empty texts have an empty set and are linked with nothing, as are rows
with a null doc_id.  A text of fewer words than a shingle has one shingle of them
all.  Rows that repeat a doc_id are rows of their own that share its component.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .scratch import Scratch, checked_broadcast, free_name, narrow, small_batches

K = 64
#: Chance that a pair at the link threshold has fewer than T collisions.
MISS = 1e-6
#: Nodes and shingles of a list or a cluster that one task looks at.
PART_NODES, PART_SHINGLES = 4096, 2_000_000
#: Nodes that all parts of a large list or cluster have.
LEADERS = 8
#: Nodes that are compared with all others at once.
CHUNK_NODES = 256
#: Equal sets of more rows than this are labelled by a broadcast of their keys.
HOT_ROWS = 1000

_rng = np.random.default_rng(97)
_MULTIPLY = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2)


def least_collisions(share: float, k: int = K, miss: float = MISS) -> int:
    """The largest T such that fewer than T of k coordinates collide with a chance of at most ``miss``."""
    below, t = 0.0, 0
    while True:
        below += comb(k, t) * share**t * (1 - share) ** (k - t)
        if below > miss or t == k:
            return max(1, t)
        t += 1


def shingle_sets(texts: list[str | None], width: int, lower: bool) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b, raws in W.blocks(texts, lower):
        hashes, at = W.hash_words(raws)
        all_runs = W.runs(hashes, width)
        for i in range(b - a):
            n = int(at[i + 1] - at[i])
            if n >= width:
                yield np.unique(all_runs[at[i] : at[i + 1] - width + 1])
            elif n:
                yield W.mix(W.runs(hashes[at[i] : at[i + 1]], n) + np.uint64(n))  # all words as one
            else:
                yield np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The K smallest hashes, 32 bits each."""
    least = np.full(K, np.iinfo(np.uint32).max, np.uint64)
    for lo in range(0, len(shingles), 4096):
        part = ((shingles[lo : lo + 4096, None] ^ _FLIP) * _MULTIPLY) >> np.uint64(32)
        np.minimum(least, part.min(0), out=least)
    return least.astype(np.uint32).view(np.int32)


def _signed(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) of each row; set_key is null for empty sets."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, s in zip(batch["doc_id"], shingle_sets(batch["text"].tolist(), width, lower), strict=True):
                if len(s):
                    out.append((doc_id, len(s), _key(s), signature(s)))
                else:
                    out.append((doc_id, 0, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_key", "signature"])

    ids = docs.select(F.col("doc_id").cast("string"), "text")  # a null stays a null in pandas
    signed = ids.mapInPandas(rows, "doc_id string, n_shingles long, set_key binary, signature array<int>")
    return signed.withColumn("doc_id", F.col("doc_id").cast("long"))


def _postings(nodes: DataFrame, prefix: int, scratch: Scratch) -> DataFrame:
    """(token, node): the first ``prefix`` places of each node, without tokens that one node alone has."""
    tokens = nodes.select("node", F.posexplode("signature").alias("k", "v")).select("node", F.xxhash64("k", "v").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    shared = tokens.join(counts, "token")
    listed = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("ts"))
    places = F.lit(prefix) - (F.lit(K) - F.size("ts"))
    kept = listed.where(places > 0).select("node", F.explode(F.slice("ts", 1, places)).alias("t")).select("node", "t.token")
    return scratch.table(kept, "postings")


def _full_sets(needed: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, lower: bool) -> DataFrame:
    """(node, n_shingles, shingles) from the texts of the nodes' documents."""
    chosen = nodes.select("node", "doc_id", "set_key").join(needed, "node").select("node", "doc_id", "set_key")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = shingle_sets(batch["text"].tolist(), width, lower)
            out = [(node, len(s), s.tobytes()) for node, key, s in zip(batch["node"], batch["set_key"], found, strict=True) if _key(s) == bytes(key)]
            yield pd.DataFrame(out, columns=["node", "n_shingles", "shingles"])

    texts = docs.join(checked_broadcast(chosen), "doc_id").select("node", "set_key", "text")
    return texts.mapInPandas(sets, "node long, n_shingles long, shingles binary")


def _key(s: np.ndarray) -> bytes:
    return np.array([W.mix(s + np.uint64(1)).sum(), W.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(), len(s)], np.uint64).tobytes()


def near_duplicates(
    docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, lower: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; texts with Jaccard >= num/den are linked."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near")
    docs = narrow(docs, id_col, text_col)
    t = least_collisions(num / den)
    signed = scratch.table(_signed(docs, width, lower), "signed")
    sized = signed.where("set_key is not null and doc_id is not null")
    nodes = sized.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    # Ids of nodes grow with the task that writes them and are read from the table ever after.
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    lists = _postings(nodes, K - t + 1, scratch).join(nodes.select("node", "n_shingles", "signature"), "node")
    retained = _merged_groups(lists, "token", "n_shingles long, signature array<int>", _collisions(t, num, den), scratch, "lists")
    clusters = components(retained, scratch, "clusters")
    sets = scratch.table(_full_sets(clusters.select("node"), docs, nodes, width, lower), "sets").dropDuplicates(["node"])
    members = clusters.withColumnRenamed("root", "cluster").join(sets, "node")
    links = _merged_groups(members, "cluster", "n_shingles long, shingles binary", _full_links(num, den), scratch, "links")
    return _labelled(signed, nodes, components(links, scratch, "components"), scratch)


def merged(n: int, alike: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Component labels of ``n`` nodes; ``alike(some, others)`` tells which of two lists of nodes are linked.

    A node counts as done once it was compared with all nodes of other components.
    When only nodes of the largest component aren't done, no link between two
    components can be left.
    """
    label, done, grows = np.arange(n), np.zeros(n, bool), True
    while True:
        _, place, count = np.unique(label, return_inverse=True, return_counts=True)
        inside = place == count.argmax()
        outside = np.flatnonzero(~done & ~inside)
        if not len(outside):
            return label
        lead = np.flatnonzero(~done & inside)[:1] if grows else outside[:0]
        chosen, others = (lead, np.flatnonzero(~inside)) if len(lead) else (outside[:CHUNK_NODES], np.arange(n))
        grows = _join(label, chosen, others, alike(chosen, others))
        done[chosen] = True


def _join(label: np.ndarray, chosen: np.ndarray, others: np.ndarray, linked: np.ndarray) -> bool:
    """Gives linked nodes one label; whether any label changed."""
    changed = False
    for i, row in zip(chosen.tolist(), linked, strict=True):
        old = np.unique(label[others[row]])
        old = old[old != label[i]]
        if len(old):
            label[np.isin(label, old)] = label[i]
            changed = True
    return changed


def _collisions(t: int, num: int, den: int):
    """Whether sizes allow the threshold and at least ``t`` coordinates are equal."""

    def of(sizes: np.ndarray, payload: pa.Array):
        signs = np.ascontiguousarray(payload.flatten().to_numpy().reshape(-1, K).T)

        def alike(some: np.ndarray, others: np.ndarray) -> np.ndarray:
            a, b = signs[:, some], signs[:, others]
            same = np.zeros((len(some), len(others)), np.uint8)
            for k in range(K):
                same += a[k][:, None] == b[k][None, :]
            low, high = np.minimum.outer(sizes[some], sizes[others]), np.maximum.outer(sizes[some], sizes[others])
            return (same >= t) & (den * low >= num * high)

        return alike

    return of


class SharedElements:
    """The sizes of intersections of sets, from the elements that at least two of them have."""

    def __init__(self, sets: list[np.ndarray], most: int = 4096):
        self.n, self.most = len(sets), most
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(self.n), [len(s) for s in sets])
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        self.own, self.own_at = column, np.searchsorted(row, np.arange(self.n + 1))
        order = np.argsort(column, kind="stable")
        self.row, self.column = row[order], column[order]
        self.width = int(self.column[-1]) + 1 if len(column) else 0
        self.at = np.searchsorted(self.column, np.arange(self.width + 1))

    def with_all(self, chosen: np.ndarray) -> np.ndarray:
        """A row for each chosen set: the sizes of its intersections with all sets."""
        if len(chosen) == 1:
            own = self.own[self.own_at[chosen[0]] : self.own_at[chosen[0] + 1]]
            n = self.at[own + 1] - self.at[own]
            places = np.repeat(self.at[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            return np.bincount(self.row[places], minlength=self.n)[None, :]
        both = np.zeros((len(chosen), self.n), np.float32)
        for lo in range(0, self.width, self.most):
            a, b = self.at[lo], self.at[min(lo + self.most, self.width)]
            has = np.zeros((self.n, min(self.most, self.width - lo)), np.float32)
            has[self.row[a:b], self.column[a:b] - lo] = 1
            both += has[chosen] @ has.T
        return both.astype(np.int64)


def _full_links(num: int, den: int):
    """Whether the full sets meet the threshold."""

    def of(sizes: np.ndarray, payload: pa.Array):
        shared = SharedElements([np.frombuffer(x, np.uint64) for x in payload.to_pylist()])

        def alike(some: np.ndarray, others: np.ndarray) -> np.ndarray:
            both = shared.with_all(some)[:, others]
            return den * both >= num * (np.add.outer(sizes[some], sizes[others]) - both)

        return alike

    return of


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key from batches that are sorted by ``keys``; a key's rows are bounded by the parts."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.any([np.diff(v) != 0 for v in values], axis=0)) + 1
        ends = [*cut.tolist(), batch.num_rows]
        at = 0
        for end in ends:
            key = tuple(v[at] for v in values)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _gathered(edges: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` edges."""
    a, b, n = [], [], 0
    for x, y in edges:
        a.append(x)
        b.append(y)
        n += len(x)
        if n >= most:
            yield _edges(np.concatenate(a), np.concatenate(b))
            a, b, n = [], [], 0
    if n:
        yield _edges(np.concatenate(a), np.concatenate(b))


def _merged_groups(members: DataFrame, key: str, payload: str, relation, scratch: Scratch, name: str) -> DataFrame:
    """(a, b): a tree for each component that the relation makes of the nodes of each ``key``.

    ``members`` has (key, node, n_shingles, payload); components of a key that was
    dealt out to several parts are joined by the edges of all its parts together.
    """
    weighed = payload.endswith("binary")
    total = F.sum("n_shingles") if weighed else F.lit(0)
    parts = F.greatest(F.ceil(F.count("*") / PART_NODES), F.ceil(total / PART_SHINGLES)).cast("int")
    large = scratch.table(members.groupBy(key).agg(parts.alias("parts")).where("parts > 1"), f"{name}-large")
    columns = [key, "part", "node", *(c.split()[0] for c in payload.split(", "))]
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    some_large = not large.isEmpty()
    if some_large:
        large = checked_broadcast(large)
        dealt = members.join(large, key, "left").withColumn("part", F.coalesce(part, F.lit(0)))
        first = Window.partitionBy(key).orderBy(F.xxhash64("node", F.lit(1)), "node")
        leaders = members.join(large, key).withColumn("k", F.row_number().over(first)).where(F.col("k") <= LEADERS)
        others = F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), part)
        dealt = dealt.select(columns).unionByName(leaders.withColumn("part", F.explode(others)).select(columns))
    else:
        dealt = members.withColumn("part", F.lit(0)).select(columns)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for group in _whole(batches, [key, "part"]):
                if group.num_rows > 1:
                    node = group["node"].to_numpy()
                    label = merged(len(node), relation(group["n_shingles"].to_numpy(), group[columns[-1]].combine_chunks()))
                    rest = np.flatnonzero(label != np.arange(len(node)))
                    yield node[label[rest]], node[rest]

        return _gathered(found())

    dealt = dealt.repartition(key, "part").sortWithinPartitions(key, "part", "node")
    edges = scratch.table(dealt.mapInArrow(trees, "a long, b long"), f"{name}-trees")
    if not some_large:
        return edges
    return edges.unionByName(scratch.table(_across_parts(members.join(large, key), edges, key, columns, relation, scratch, name), f"{name}-across"))


def _across_parts(members: DataFrame, edges: DataFrame, key: str, columns: list[str], relation, scratch: Scratch, name: str) -> DataFrame:
    """(a, b): links of the nodes outside the largest component of a key with nodes of its other components."""
    roots = components(edges, scratch, f"{name}-parts")
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy(key, "root").count().groupBy(key).agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("n"))
    sizes = sizes.withColumn("chunks", F.ceil((F.col("n") - F.col("top.count")) / CHUNK_NODES).cast("int")).where("chunks > 0")
    live = placed.join(checked_broadcast(sizes.select(key, F.col("top.root").alias("top"), "chunks")), key)
    chunk = F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int")
    columns = [key, "part", "chunk", "few", "root", *columns[2:]]
    every = live.withColumn("few", F.lit(False)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    few = live.where("root <> top").withColumn("few", F.lit(True)).withColumn("chunk", chunk).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for group in _whole(batches, [key, "part", "chunk"]):
                node, root, mine = group["node"].to_numpy(), group["root"].to_numpy(), group["few"].to_numpy()
                alike = relation(group["n_shingles"].to_numpy(), group[columns[-1]].combine_chunks())
                all_, some = np.flatnonzero(~mine), np.flatnonzero(mine)
                for lo in range(0, len(some), CHUNK_NODES):
                    chosen = some[lo : lo + CHUNK_NODES]
                    for i, row in zip(chosen.tolist(), alike(chosen, all_), strict=True):
                        other = all_[row & (root[all_] != root[i])]
                        _, first = np.unique(root[other], return_index=True)  # a link to each component is enough
                        yield np.full(len(first), node[i]), node[other[first]]

        return _gathered(found())

    dealt = every.select(columns).unionByName(few.select(columns)).repartition(key, "part", "chunk").sortWithinPartitions(key, "part", "chunk", "node")
    return dealt.mapInArrow(links, "a long, b long")


def _labelled(signed: DataFrame, nodes: DataFrame, root: DataFrame, scratch: Scratch) -> DataFrame:
    """The result rows; only sets with several rows or with links are looked up, and the very common ones by a broadcast."""
    owner = nodes.select("set_key", "node", "n_rows", F.col("doc_id").alias("first_id"))
    placed = owner.join(root, "node").select("root", "set_key", "first_id")
    least = placed.groupBy("root").agg(F.min("first_id").alias("least_id"))
    moved = placed.join(least, "root").where("least_id <> first_id").select("set_key", "least_id")
    owner = owner.join(moved, "set_key", "left").where("n_rows > 1 or least_id is not null")
    owner = scratch.table(owner.select("set_key", "n_rows", F.coalesce("least_id", "first_id").alias("component_id")), "owners")
    hot = owner.where(F.col("n_rows") > HOT_ROWS).drop("n_rows")
    alone = "set_key is null or doc_id is null"
    rows = signed.select("doc_id", "n_shingles", "set_key")
    plain = rows.where(alone).withColumn("component_id", F.col("doc_id"))
    rows = rows.where(f"not ({alone})")
    common = rows.join(checked_broadcast(hot), "set_key")
    rare = rows.join(checked_broadcast(hot.select("set_key")), "set_key", "left_anti")
    rare = rare.join(owner.where(F.col("n_rows") <= HOT_ROWS).drop("n_rows"), "set_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    labelled = plain.select(columns).unionByName(common.select(columns)).unionByName(rare.select(columns))
    return labelled.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest doc_id.

    Rows without a doc_id stay; of rows that repeat a doc_id all or none stay.
    """
    name = free_name(docs, "gone")
    gone = near_duplicates(docs, width, num, den).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
