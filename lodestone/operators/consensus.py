"""Two-reviewer consensus, evaluation selection and publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consensus(votes: DataFrame) -> DataFrame:
    """(rule_id, status) from votes (round_name, rule_id, decision) of two rounds.

    Both accept: accepted; both reject: rejected; both accept, one or both with
    corrections: correction_draft; anything else, or a missing round: unresolved.
    """
    wide = votes.groupBy("rule_id").agg(
        F.max(F.when(F.col("round_name") == "first", F.col("decision"))).alias("a"), F.max(F.when(F.col("round_name") == "second", F.col("decision"))).alias("b")
    )
    positive = ["accept", "accept_with_corrections"]
    status = (
        F.when((F.col("a") == "accept") & (F.col("b") == "accept"), "accepted")
        .when((F.col("a") == "reject") & (F.col("b") == "reject"), "rejected")
        .when(F.col("a").isin(positive) & F.col("b").isin(positive), "correction_draft")
        .otherwise("unresolved")
    )
    return wide.select("rule_id", status.alias("status"))


def proposals(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rounds, status): confirmed if both rounds propose the key with one and the same payload."""
    found = changes.groupBy(*keys).agg(F.count_distinct("round_name").alias("rounds"), F.count_distinct("payload_hash").alias("payloads"))
    status = F.when((F.col("rounds") == 2) & (F.col("payloads") == 1), "confirmed").when(F.col("rounds") == 2, "conflicting").otherwise("single")
    return found.select(*keys, "rounds", status.alias("status"))


def status_counts(rows: DataFrame, keys: list[str], status: str, values: list[str]) -> DataFrame:
    """One column of counts for each status, zeros included."""
    return rows.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col(status) == v, 1)), F.lit(0)).cast("long").alias(f"n_{v.lower()}") for v in values))


def evaluation_selection(candidates: DataFrame, consensus_: DataFrame, findings: DataFrame) -> DataFrame:
    """(rule_id, selected, reasons): accepted and in no finding (rule_id, kind); why not, sorted."""
    kinds = findings.groupBy("rule_id").agg(F.collect_set(F.concat(F.lit("in_"), "kind")).alias("found"))
    joined = candidates.select("rule_id").join(consensus_, "rule_id", "left").join(kinds, "rule_id", "left")
    not_accepted = F.when(F.coalesce(F.col("status") == "accepted", F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("consensus_"), F.coalesce("status", F.lit("missing")))))
    why = F.array_sort(F.concat(not_accepted, F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select("rule_id", (F.size(why) == 0).alias("selected"), why.alias("reasons"))


def publish(clauses: DataFrame, accepted: DataFrame, approved: DataFrame, mapping: DataFrame) -> DataFrame:
    """(rule_id, neighbours): accepted and approved candidates under their new ids; neighbours that aren't published go.

    ``clauses`` (candidate_id, neighbours array<string>), ``mapping`` (candidate_id, rule_id).
    """
    live = clauses.join(accepted, "candidate_id", "left_semi").join(approved, "candidate_id", "left_semi").join(mapping, "candidate_id")
    names = live.select(F.col("candidate_id").alias("n"), F.col("rule_id").alias("neighbour"))
    exploded = live.select("rule_id", F.posexplode_outer("neighbours").alias("pos", "n")).join(names, "n", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("neighbour").isNotNull(), F.struct("pos", "neighbour"))))
    return exploded.groupBy("rule_id").agg(F.transform(ordered, lambda x: x["neighbour"]).alias("neighbours"))


def unique_by(rows: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(one row a key, conflicts): rows of a key must agree in ``payload``; those that don't are the second table."""
    found = rows.groupBy(key).agg(F.min(payload).alias(payload), F.count_distinct(payload).alias("__n"))
    return found.where("__n = 1").drop("__n"), found.where("__n > 1").select(key)


def failed_attempts(raw: DataFrame, reviewed: DataFrame, receipts: DataFrame) -> DataFrame:
    """(round, stem) of artifacts, raw or reviewed, that no receipt selects."""
    return raw.select("round", "stem").union(reviewed.select("round", "stem")).distinct().join(receipts, ["round", "stem"], "left_anti")


def reduce_decisions(static: DataFrame, model: DataFrame) -> DataFrame:
    """(unit_id, tag, outcome) of a static and a model decision: agree, static_only, model_only, neither or missing."""
    both = static.withColumnRenamed("decision", "s").join(model.withColumnRenamed("decision", "m"), ["unit_id", "tag"], "full_outer")
    s, m = F.col("s") == "positive", F.col("m") == "positive"
    outcome = F.when(F.col("s").isNull() | F.col("m").isNull(), "missing").when(s & m, "agree").when(s, "static_only").when(m, "model_only").otherwise("neither")
    return both.select("unit_id", "tag", outcome.alias("outcome"))


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two tables of (keys, value) that are missing on a side or differ: an exact structural diff."""
    a, b = left.withColumnRenamed("value", "expected"), right.withColumnRenamed("value", "actual")
    joined = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), keys, "full_outer")
    return joined.where(F.col("__a").isNull() | F.col("__b").isNull() | ~F.col("expected").eqNullSafe(F.col("actual"))).select(*keys, "expected", "actual")
