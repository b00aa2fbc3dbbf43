"""Plans under a budget: first-fit bins and context plans, as streams over sorted rows.

A choice that depends on the choices before it is a fold. Rows are dealt by their
key and sorted, and a task goes through them with the state of one key at a time, so
a key of any number of rows needs only what its fold keeps (a sum, or its bins).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph

#: Relations that are no evidence (fixed values).
NOT_EVIDENCE = ("same_host", "same_file")


class FirstFit:
    """Bins of one capacity; the first with room is found in a tree of free space, in the logarithm of their number."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.leaves = capacity, 0, 1
        self.free = [0, capacity]

    def put(self, size: int) -> int | None:
        """The number of the bin that takes the size; None if it is larger than any bin."""
        if size > self.capacity:
            return None
        if self.free[1] < size:  # a tree of twice the size: all new bins are free
            self.free = [0, self.capacity, *(x for level in self._levels() for x in level + [self.capacity] * len(level))]
            self.leaves *= 2
        at = 1
        while at < self.leaves:
            at = 2 * at if self.free[2 * at] >= size else 2 * at + 1
        self.free[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            self.free[at] = max(self.free[2 * at], self.free[2 * at + 1])
        return found

    def _levels(self) -> Iterator[list[int]]:
        at = 1
        while at <= self.leaves:
            yield self.free[at : 2 * at]
            at *= 2


def folded(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[], Callable[[dict], int]], name: str) -> DataFrame:
    """``rows`` with the whole number ``name``: a new fold for each key, given its rows in order.

    Rows are dealt by a hash of their key, not by the key's columns: a join on these just
    before would stand in for that shuffle, and adaptive plans read such a join's side
    by the tasks that wrote it once the other side turns out small.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.IntegerType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if fold is None or key != now:
                    now, fold = key, step()
                out.append(fold(row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=schema.names)

    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(task, schema)


def first_fit_bins(items: DataFrame, groups: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """(keys, item_id, tokens, bin): items in order of ``seq`` go to the first bin with room; -1 if larger than ``capacity``."""

    def step():
        bins = None

        def put(row):
            nonlocal bins
            bins = bins or FirstFit(row["capacity"])
            found = bins.put(row["tokens"])
            return -1 if found is None else found

        return put

    rows = items.select(*groups, "item_id", F.coalesce("tokens", F.lit(0)).alias("tokens"), "seq", "capacity")
    return folded(rows, list(groups), ["seq", "item_id"], step, "bin").select(*groups, "item_id", "tokens", "bin")


def context_plan(groups: DataFrame, questions: DataFrame, candidates: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """(decisions, bundles) of each group and question.

    ``groups`` (group_id, primary_tokens, blocked), ``questions`` (group_id, question_id),
    ``candidates`` (group_id, question_id, candidate_id, seq, tokens, necessity,
    relation_type, quality).  What is required comes first: a required candidate that is
    turned down, for whatever reason, blocks its question, and then no helpful one is
    taken.  Helpful ones go first-fit into bins of what is left; each bin is a bundle,
    and a question has one at least.

    decisions: (group_id, question_id, candidate_id, status, reason, bin); status is
    selected (reason required_context or helpful_context) or omitted (reason
    distractor_rejected, relation_degraded, context_blocked or budget_exceeded).
    bundles: (group_id, question_id, bin, supporting_tokens, total_tokens,
    dispatch_allowed, issues).  Candidates of unknown groups are left out.
    """
    key = ["group_id", "question_id"]
    known = groups.select("group_id", F.col("primary_tokens").cast("long").alias("primary_tokens"), F.coalesce("blocked", F.lit(False)).alias("blocked"))
    c = candidates.select(*key, "candidate_id", "seq", F.col("tokens").cast("long").alias("tokens"), "necessity", "relation_type", "quality").join(known, "group_id")
    required = F.col("necessity") == "required"
    refused = (
        F.when((F.col("necessity") == "distractor") | F.col("relation_type").isin(*NOT_EVIDENCE), "distractor_rejected").when(~F.col("quality").eqNullSafe("exact"), "relation_degraded")
        .when(F.col("blocked"), "context_blocked").when(F.col("primary_tokens") > budget, "budget_exceeded")
    )
    c = c.withColumn("refused", refused).withColumn("required", F.coalesce(required, F.lit(False)))

    def required_step():
        spent = 0

        def take(row):
            nonlocal spent
            if row["primary_tokens"] + spent + row["tokens"] > budget:
                return -1
            spent += row["tokens"]
            return 0

        return take

    wanted = folded(c.where("required and refused is null"), key, ["seq", "candidate_id"], required_step, "bin")
    need = wanted.unionByName(c.where("required and refused is not null").withColumn("bin", F.lit(-1)))
    state = need.groupBy(*key).agg(F.sum(F.when(F.col("bin") >= 0, F.col("tokens")).otherwise(0)).alias("required_tokens"), F.max((F.col("bin") < 0).cast("int")).alias("missing"))
    helpful = c.where("not required and refused is null").join(state, key, "left").fillna(0, ["required_tokens", "missing"])
    room = helpful.where("missing = 0").withColumn("capacity", F.lit(budget) - F.col("primary_tokens") - F.col("required_tokens"))
    bins = first_fit_bins(room.withColumnRenamed("candidate_id", "item_id"), tuple(key)).select(*key, F.col("item_id").alias("candidate_id"), "bin")
    decided = [
        need.select(*key, "candidate_id", F.coalesce("refused", F.when(F.col("bin") < 0, "budget_exceeded")).alias("reason"), F.lit("required_context").alias("good"), F.lit(None).cast("int").alias("bin")),
        helpful.where("missing = 1").select(*key, "candidate_id", F.lit("context_blocked").alias("reason"), F.lit(None).cast("string").alias("good"), F.lit(None).cast("int").alias("bin")),
        bins.select(*key, "candidate_id", F.when(F.col("bin") < 0, "budget_exceeded").alias("reason"), F.lit("helpful_context").alias("good"), F.when(F.col("bin") >= 0, F.col("bin")).alias("bin")),
        c.where("not required and refused is not null").select(*key, "candidate_id", F.col("refused").alias("reason"), F.lit(None).cast("string").alias("good"), F.lit(None).cast("int").alias("bin")),
    ]
    every = decided[0].unionByName(decided[1]).unionByName(decided[2]).unionByName(decided[3])
    decisions = every.select(*key, "candidate_id", F.when(F.col("reason").isNull(), "selected").otherwise("omitted").alias("status"), F.coalesce("reason", "good").alias("reason"), "bin")

    taken = bins.where("bin >= 0").join(c.select(*key, "candidate_id", "tokens"), [*key, "candidate_id"]).groupBy(*key, "bin").agg(F.sum("tokens").alias("helpful_tokens"))
    degraded = c.where("refused = 'relation_degraded'").select(*key).distinct().withColumn("degraded", F.lit(True))
    q = questions.select(*key).distinct().join(known, "group_id").join(state, key, "left").join(degraded, key, "left").join(taken, key, "left")
    q = q.fillna(0, ["required_tokens", "missing", "bin", "helpful_tokens"]).fillna(False, ["degraded"])
    over, missing = F.col("primary_tokens") > budget, (F.col("missing") == 1) | F.col("blocked") | (F.col("primary_tokens") > budget)
    issues = F.concat_ws(",", F.when(missing, "context_insufficient"), F.when(over, "primary_exceeds_budget"), F.when(F.col("degraded"), "relation_degraded"))
    support = F.col("required_tokens") + F.col("helpful_tokens")
    return decisions, q.select(*key, "bin", support.alias("supporting_tokens"), (F.col("primary_tokens") + support).alias("total_tokens"), (~missing).alias("dispatch_allowed"), issues.alias("issues"))


def distinct_picks(members: DataFrame, folder: str) -> DataFrame:
    """(family, pick): each family, those with fewer members first and then by name, takes the smallest member that none before it has.

    ``members`` (family, member).  In rounds: a family takes its smallest free member as
    soon as no undecided family before it has that member at all, so a round decides at
    least the first family and usually most.  Families without a free member left take
    nothing and have no row.
    """
    live = members.where("family is not null and member is not null").select("family", "member").distinct()
    turn = live.groupBy("family").agg(F.count("*").alias("n"))
    live = graph.written(live.join(turn, "family"), f"{folder}/live-0")
    picked, k = None, 0
    while not live.isEmpty():
        first = live.groupBy("family").agg(F.min("member").alias("member"), F.first("n").alias("n"))
        owner = live.groupBy("member").agg(F.min(F.struct("n", "family")).alias("owner"))
        now = first.join(owner, "member").where("owner.family = family").select("family", "member")
        now = graph.written(now, f"{folder}/picked-{k}")
        picked = now if picked is None else picked.unionByName(now)
        k += 1
        live = graph.written(live.join(now.select("family"), "family", "left_anti").join(now.select("member"), "member", "left_anti"), f"{folder}/live-{k}")
    return members.select("family", F.col("member").alias("pick")).limit(0) if picked is None else picked.withColumnRenamed("member", "pick")
