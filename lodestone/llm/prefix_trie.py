"""A trie over the turns of conversations, by chained prefix digests.

A turn is known by a digest of its role and text; the digest of a prefix is the
SHA-256 of the digest before it and of the turn, so two conversations share a
node of depth d exactly if their first d turns are equal.  Texts are hashed where
they are read and never shuffled.  Every prefix is a row, and a group by (depth,
digest) gives the nodes.

Sums over subtrees: a node goes by its smallest member, and the nodes that go by
one conversation are the lower end of its path.  These are summed up along the
path first, and only the sum of each such piece is exploded to all ancestors above
it, which are prefixes of that conversation: no more rows than there are prefixes,
where exploding every node would cost the square of a conversation's length.

Order and hot conversations: turns are sorted by range, so positions come from
counts of each range and a conversation of any length is dealt over many tasks.
Chains run in segments of ``SEGMENT`` turns, and a second chain runs over the ends
of segments; sums along a path do the same.  The ids that end at a node are joined
in chunks by tasks that each have a range of them, and hashed chunk by chunk.

Turns are ordered by turn (null first), then role, then the digest: the order of
turns that share a number is defined, and equal ones don't matter.  A null role or
text is empty; repeated rows are turns of their own; rows without a conv_id are left
out.  An empty table gives no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

#: Conversations of one family share the first turns of its head, up to ``SHARED - 1`` of them.
FAMILY, SHARED = 100, 6
#: Turns that one chain covers.
SEGMENT = 256
#: Ids that are joined to one string.
CHUNK = 4096
ROOT = bytes(32)
NO_IDS = hashlib.sha256(b"").hexdigest()


def _root() -> F.Column:
    return F.lit(bytearray(ROOT))


def positions(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((conv, part, at, digest, points), (conv, part, first, n, before)): turns in order, and how parts share a conversation.

    The position of a turn in its conversation is ``at - first + before``, from 0.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        conversations["conv_id"].cast("long").alias("conv"), conversations["turn"].cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.length(text).cast("long").alias("points"),
    ).where("conv is not null")
    order = ["conv", F.asc_nulls_first("turn"), "role", "digest"]
    ranked = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    turns = scratch.table(ranked.select("conv", F.expr("id >> 33").alias("part"), F.expr("id & ((1L << 33) - 1)").alias("at"), "digest", "points"), "turns")
    spans = turns.groupBy("part", "conv").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, scratch.table(spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "spans")


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((conv, depth, digest, points, last), (conv, length)): turns of rebuilt conversations, and all of these.

    A conversation c starts with the first h turns of c - c % 100, and goes on with its own turns after its first h.
    """
    turns, spans = positions(conversations, scratch)
    counts = spans.groupBy("conv").agg(F.sum("n").alias("own"))
    plan = counts.select("conv", "own", (F.crc32(F.col("conv").cast("string")) % SHARED).alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("head"))
    heads = counts.select(F.col("conv").alias("head"), F.col("own").alias("there"))
    plan = plan.join(heads, "head", "left").select("conv", "own", "h", "head", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    plan = scratch.table(plan, "plan")
    placed = turns.join(spans.join(plan, "conv"), ["part", "conv"]).select("conv", (F.col("at") - F.col("first") + F.col("before")).alias("at"), "digest", "points", "own", "h", "taken")
    placed = scratch.table(placed, "placed")
    rest = placed.where("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "points", (F.col("at") == F.col("own") - 1).alias("last"))
    starts = placed.where((F.col("conv") % FAMILY == 0) & (F.col("at") < SHARED - 1)).select(F.col("conv").alias("head"), "at", "digest", "points")
    shared = plan.where("taken > 0").join(starts, "head").where("at < taken")  # at most 5 turns for each conversation
    shared = shared.select("conv", (F.col("at") + 1).alias("depth"), "digest", "points", ((F.col("own") <= F.col("h")) & (F.col("at") == F.col("taken") - 1)).alias("last"))
    return rest.unionByName(shared), plan.select("conv", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def _chained(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``rows`` with the state of a chain before and after each row; a chain is the rows of one key."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, ROOT
        for batch in batches:
            before, after = [], []
            for key, link in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column(value).to_pylist(), strict=True):
                if key != now:
                    now, state = key, ROOT
                before.append(state)
                state = hashlib.sha256(state + link).digest()
                after.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=[*batch.schema.names, "before", "after"])

    schema = T.StructType([*rows.schema.fields, T.StructField("before", T.BinaryType()), T.StructField("after", T.BinaryType())])
    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(task, schema)


def _link(state: str, inner: str) -> F.Column:
    return F.unhex(F.sha2(F.concat(state, inner), 256))


def prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, depth, digest, parent, points, last) of every prefix of at least one turn; ``turns`` is what ``rebuilt`` gives."""
    parts = turns.withColumn("segment", F.expr(f"(depth - 1) div {SEGMENT}")).withColumnRenamed("digest", "turn")
    inner = scratch.table(_chained(parts, ["conv", "segment"], "depth", "turn").drop("turn"), "chains")
    ends = inner.where(F.col("depth") % SEGMENT == 0).select("conv", "segment", F.col("after").alias("inner"))
    states = _chained(ends, ["conv"], "segment", "inner").select("conv", (F.col("segment") + 1).alias("segment"), F.col("after").alias("state"))
    joined = inner.join(states, ["conv", "segment"], "left").withColumn("state", F.coalesce("state", _root()))
    first = F.col("depth") % SEGMENT == 1 % SEGMENT
    parent = F.when(first, F.col("state")).otherwise(_link("state", "before"))
    return scratch.table(joined.select("conv", "depth", _link("state", "after").alias("digest"), parent.alias("parent"), "points", "last"), "prefixes")


def _ids_joined(ends: DataFrame) -> DataFrame:
    """(digest, sha256) of the ids that end at each node, in order and joined by commas; ``ends`` is (digest, conv)."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            done = []
            for digest, conv in zip(batch.column("digest").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if digest != now or len(held) == CHUNK:
                    done.append((now, held))
                    now, held = digest, []
                held.append(conv)
            yield packed(done)
        yield packed([(now, held)])

    def packed(done: list[tuple[bytes, list[int]]]) -> pa.RecordBatch:
        done = [(d, held) for d, held in done if held]
        return pa.RecordBatch.from_pydict({"digest": pa.array([d for d, _ in done], pa.binary()), "first": pa.array([h[0] for _, h in done], pa.int64()), "ids": pa.array([",".join(map(str, h)) for _, h in done], pa.string())})

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if digest != now:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = digest, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield hashed(done)
        if now is not None:
            yield hashed([(now, sha.hexdigest())])

    def hashed(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"digest": pa.array([d for d, _ in done], pa.binary()), "sha256": pa.array([s for _, s in done], pa.string())})

    pieces = ends.repartitionByRange("digest", "conv").sortWithinPartitions("digest", "conv").mapInArrow(chunks, "digest binary, first long, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashes, "digest binary, sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, convs = rebuilt(conversations, scratch)
    paths = prefixes(turns, scratch)
    top = convs.agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(F.lit(0).cast("long").alias("depth"), _root().alias("digest"), F.lit(None).cast("binary").alias("parent"), "rep", "n_convs", F.lit(0).cast("long").alias("points"))
    nodes = paths.groupBy("depth", "digest").agg(F.min("parent").alias("parent"), F.min("conv").alias("rep"), F.count("*").alias("n_convs"), F.min("points").alias("points"))
    nodes = scratch.table(nodes.unionByName(top), "nodes")

    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, "digest", "left").select(
        "digest", "parent", "depth", "rep", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.expr(f"depth div {SEGMENT}").alias("segment"),
        F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"),
    )
    own = scratch.table(own, "own")

    # Along the path of the conversation that nodes go by: segment by segment, and within segments.
    pieces = scratch.table(own.groupBy("rep", "segment").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.min("depth").alias("top")), "pieces")
    deeper = Window.partitionBy("rep").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    later = pieces.select("rep", "segment", *(F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(f"later_{c}") for c in ("leaf", "saved")))
    within = Window.partitionBy("rep", "segment").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    down = own.select("*", *(F.sum(c).over(within).alias(f"down_{c}") for c in ("leaf", "saved"))).join(later, ["rep", "segment"])

    # The sum of each such piece of a path, exploded to the ancestors above it.
    whole = pieces.groupBy("rep").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.min("top").alias("top")).where("top > 0")
    above = paths.select("conv", "depth", "digest").join(whole.withColumnRenamed("rep", "conv"), "conv").where("depth < top").select("digest", "leaf", "saved")
    above = above.unionByName(whole.select(_root().alias("digest"), "leaf", "saved"))
    below = above.groupBy("digest").agg(F.sum("leaf").alias("below_leaf"), F.sum("saved").alias("below_saved"))

    ends = paths.where("last").select("digest", "conv").unionByName(convs.where("length = 0").select(_root().alias("digest"), "conv"))
    parents = nodes.select(F.col("digest").alias("parent"), F.col("rep").alias("parent_conv_id"))
    joined = down.join(below, "digest", "left").join(_ids_joined(ends), "digest", "left").join(parents, "parent", "left")
    return joined.select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        *((F.col(f"down_{c}") + F.col(f"later_{c}") + F.coalesce(f"below_{c}", F.lit(0))).alias(n) for c, n in (("leaf", "n_leaves"), ("saved", "saved_tokens"))),
        F.coalesce("sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
