"""Retrieval for all units at once, with failures of the embedding, and the evaluation of another embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, retrieval


def retrieve(units: DataFrame, exact: DataFrame, vector: DataFrame, limit: int = retrieval.RESULT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(results, diagnostics) of ``units`` (unit_id, embedded boolean).

    Both rankings are fused and cut at ``limit``.  A unit that couldn't be embedded (false
    or null) goes by its exact ranking alone and says embedding_unavailable; one
    without any result says no_evidence.  diagnostics: (unit_id, codes), sorted, for every unit.
    """
    state = units.groupBy("unit_id").agg(F.coalesce(F.min(F.coalesce("embedded", F.lit(False))), F.lit(False)).alias("embedded"))
    able = state.where("embedded").select("unit_id")
    fused = retrieval.reciprocal_rank_fusion(exact.join(state.select("unit_id"), "unit_id", "left_semi"), vector.join(able, "unit_id", "left_semi"))
    results = fused.where(F.col("rank") <= limit)
    found = results.select("unit_id").distinct().withColumn("found", F.lit(True))
    codes = F.array(F.when(~F.col("embedded"), "embedding_unavailable"), F.when(F.col("found").isNull(), "no_evidence"))
    return results, state.join(found, "unit_id", "left").select("unit_id", F.array_sort(F.filter(codes, lambda c: c.isNotNull())).alias("codes"))


def evaluate_candidate(
    queries: DataFrame, index: DataFrame, truth: DataFrame, re_embed: Callable[[DataFrame], DataFrame], gates: list[tuple[str, str, float]], ks: tuple[int, ...] = (5,), minimum: float = retrieval.MIN_SIMILARITY
) -> DataFrame:
    """(arm, k, recall, precision, mrr, failed) of the vectors as they are (current) and as ``re_embed`` makes them (candidate).

    ``re_embed`` gives a table of the same columns with another ``vector``; queries
    (unit_id, vector) and index (rule_id, vector) both go through it.  ``truth``
    (unit_id, rule_id).  ``failed`` are the gates that an arm misses.
    """
    ranked = None
    for arm, change in (("current", lambda df: df), ("candidate", re_embed)):
        pairs = retrieval.similarities(change(queries), change(index), minimum, retrieval.VECTOR_LIMIT).where("unit_id <> rule_id")
        one = retrieval.vector_ranking(pairs, minimum).select(F.lit(arm).alias("arm"), "unit_id", "rule_id", "rank")
        ranked = one if ranked is None else ranked.unionByName(one)
    found = metrics.micro_metrics(metrics.ranking_metrics(ranked, truth, ks))
    return found.join(metrics.failed_gates(found, gates, ["arm", "k"]), ["arm", "k"])
