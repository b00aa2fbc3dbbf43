"""Evaluation: confusion counts, agreement, ranking metrics, gates and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..session import rows_of


def _count(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def confusion(cases: DataFrame, actual: str, predicted: str, groups: list[list[str]] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of boolean columns; with ``groups`` one grouping set each, and null for the other keys."""
    keys = sorted({k for g in groups or [] for k in g})
    a, p = F.col(actual), F.col(predicted)
    counts = [_count(a & p).alias("tp"), _count(~a & p).alias("fp"), _count(a & ~p).alias("fn"), _count(~a & ~p).alias("tn")]
    if keys:
        found = cases.groupingSets([[F.col(k) for k in g] for g in groups], *(F.col(k) for k in keys)).agg(*counts)
    else:
        found = cases.agg(*counts)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return found.select(
        *keys, "tp", "fp", "fn", "tn", stats.ratio(tp, tp + fp).alias("precision"), stats.ratio(tp, tp + fn).alias("recall"), stats.f1(tp, fp, fn).alias("f1")
    )


def with_wilson(counts: DataFrame) -> DataFrame:
    """Precision and recall with 0 for empty denominators, and their lower Wilson bounds."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": stats.ratio_or_zero(tp, tp + fp), "recall": stats.ratio_or_zero(tp, tp + fn),
            "precision_low": F.coalesce(stats.wilson_lower(tp, tp + fp), F.lit(0.0)), "recall_low": F.coalesce(stats.wilson_lower(tp, tp + fn), F.lit(0.0)),
        }
    )


def multiset_match(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """tp, fp, fn of two multisets of ``value`` by ``keys``: shared copies, surplus copies, missing copies."""
    e = expected.groupBy(*keys, value).agg(F.count("*").alias("e"))
    a = actual.groupBy(*keys, value).agg(F.count("*").alias("a"))
    both = e.join(a, [*keys, value], "full_outer").fillna(0, ["e", "a"])
    counts = both.groupBy(*keys).agg(
        F.sum(F.least("e", "a")).alias("tp"), F.sum(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("e") - F.col("a"), F.lit(0))).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": stats.ratio_or_perfect(tp, fp, fn, fp), "recall": stats.ratio_or_perfect(tp, fp, fn, fn)})


def cohens_kappa(votes: DataFrame, first: str, second: str, keys: list[str] | None = None) -> DataFrame:
    """n, agreed, agreement_ppm, kappa and kappa_ppm of two raters' columns, by ``keys``."""
    keys = keys or []
    pairs = votes.groupBy(*keys, first, second).agg(F.count("*").alias("c"))
    n = pairs.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(first) == F.col(second), F.col("c")).otherwise(0)).alias("agreed"))
    a = pairs.groupBy(*keys, F.col(first).alias("v")).agg(F.sum("c").alias("ca"))
    b = pairs.groupBy(*keys, F.col(second).alias("v")).agg(F.sum("c").alias("cb"))
    expected = a.join(b, [*keys, "v"]).groupBy(*keys).agg(F.sum(F.col("ca") * F.col("cb")).alias("e"))
    joined = n.join(expected, keys, "left") if keys else n.join(expected, F.lit(True), "left")
    joined = joined.withColumn("e", F.coalesce("e", F.lit(0)))
    k = stats.kappa(F.col("n"), F.col("agreed"), F.col("e"))
    return joined.select(*keys, "n", "agreed", stats.ppm(F.col("agreed") / F.col("n")).alias("agreement_ppm"), k.alias("kappa"), stats.ppm(k).alias("kappa_ppm"))


def dense_matrix(cases: DataFrame, rows: tuple[str, list], columns: tuple[str, list]) -> DataFrame:
    """Counts of every (row, column) value pair of two small domains, zeros included."""
    spark = cases.sparkSession
    r = rows_of(spark, [(str(x),) for x in rows[1]], f"{rows[0]} string")
    c = rows_of(spark, [(str(x),) for x in columns[1]], f"{columns[0]} string")
    seen = cases.groupBy(F.col(rows[0]).cast("string").alias(rows[0]), F.col(columns[0]).cast("string").alias(columns[0])).agg(F.count("*").alias("n"))
    return r.crossJoin(c).join(seen, [rows[0], columns[0]], "left").fillna(0, ["n"])


def ranking_metrics(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 8)) -> DataFrame:
    """(arm, unit_id, k, hits, relevant, shown, recall, precision, reciprocal_rank) at each k.

    ``ranked`` (arm, unit_id, rule_id, rank), ``truth`` (unit_id, rule_id).  Recall is
    null without relevant records; the reciprocal rank is that of the first relevant
    one, 0 if it is missed, to 6 places; precision is over what is shown.
    """
    judged = ranked.join(truth.withColumn("hit", F.lit(True)), ["unit_id", "rule_id"], "left")
    return judged_metrics(judged, truth.groupBy("unit_id").agg(F.count_distinct("rule_id").alias("relevant")), ks)


def judged_metrics(judged: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 8)) -> DataFrame:
    """``ranking_metrics`` where the truth is too large to list: ``judged`` (arm, unit_id, rank, hit) says of each ranked record whether it is relevant (null: no), ``relevant`` (unit_id, relevant) how many there are, units without any left out."""
    top, n, hit = max(ks), relevant, F.coalesce("hit", F.lit(False))
    wide = judged.where(F.col("rank") <= top).groupBy("arm", "unit_id").agg(
        *(F.sum(F.when((F.col("rank") <= k) & hit, 1).otherwise(0)).alias(f"h{k}") for k in ks),
        *(F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"s{k}") for k in ks),
    )
    firsts = judged.where(hit).groupBy("arm", "unit_id").agg(F.min("rank").alias("first"))
    arms = judged.agg(F.collect_set("arm").alias("arms"))  # one row: the arms that are compared
    units = wide.select("arm", "unit_id").union(n.select("unit_id").join(F.broadcast(arms), F.lit(True)).select(F.explode("arms").alias("arm"), "unit_id")).distinct()
    joined = units.join(wide, ["arm", "unit_id"], "left").join(n, "unit_id", "left").join(firsts, ["arm", "unit_id"], "left").fillna(0)
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits"), F.col(f"s{k}").alias("shown")) for k in ks)))
    long = joined.select("arm", "unit_id", "relevant", "first", at.alias("x")).select("arm", "unit_id", "relevant", "first", "x.*")
    reciprocal = F.when(F.col("relevant") > 0, F.round(F.when(F.col("first") > 0, 1 / F.col("first")).otherwise(0.0), 6))
    return long.select(
        "arm", "unit_id", "k", "hits", "relevant", "shown", stats.ratio(F.col("hits"), F.col("relevant")).alias("recall"),
        stats.ratio(F.col("hits"), F.col("shown")).alias("precision"), reciprocal.alias("reciprocal_rank"),
    )


def micro_metrics(per_unit: DataFrame) -> DataFrame:
    """(arm, k): sums over sums, and the mean reciprocal rank over units that have one, to 6 places."""
    found = per_unit.groupBy("arm", "k").agg(F.sum("hits").alias("hits"), F.sum("relevant").alias("relevant"), F.sum("shown").alias("shown"), F.avg("reciprocal_rank").alias("mrr"))
    return found.select(
        "arm", "k", F.round(stats.ratio(F.col("hits"), F.col("relevant")), 6).alias("recall"), F.round(stats.ratio(F.col("hits"), F.col("shown")), 6).alias("precision"), F.round("mrr", 6).alias("mrr")
    )


def arm_deltas(metrics: DataFrame, left: str, right: str, keys: list[str], values: list[str]) -> DataFrame:
    """right - left of each value, to 6 places; null where either is."""
    sides = [F.first(F.when(F.col("arm") == arm, F.col(v)), ignorenulls=True).alias(f"__{arm}_{v}") for arm in (left, right) for v in values]
    wide = metrics.where(F.col("arm").isin(left, right)).groupBy(*keys).agg(*sides)
    return wide.select(*keys, *(F.round(F.col(f"__{right}_{v}") - F.col(f"__{left}_{v}"), 6).alias(f"{v}_delta") for v in values))


def moved_rules(ranked: DataFrame, left: str, right: str, k: int) -> DataFrame:
    """(unit_id, rule_id, change) of records in the first ``k`` of one arm only."""
    side = lambda arm: ranked.where((F.col("arm") == arm) & (F.col("rank") <= k)).select("unit_id", "rule_id")
    a, b = side(left), side(right)
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def failed_gates(metrics: DataFrame, gates: list[tuple[str, str, float]], keys: list[str]) -> DataFrame:
    """(keys, failed): sorted names of the gates (metric, '>=' or '<=', bound) that a row misses; a null value misses."""
    missed = []
    for metric, sign, bound in gates:
        ok = F.col(metric) >= bound if sign == ">=" else F.col(metric) <= bound
        missed.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{metric}{sign}{bound:g}")))
    return metrics.select(*keys, F.array_sort(F.filter(F.array(*missed), lambda x: x.isNotNull())).alias("failed"))


def worst(cases: DataFrame, keys: list[str], decision: str, priority: dict[str, int]) -> DataFrame:
    """(keys, decision): the decision of highest priority."""
    order = F.coalesce(*(F.when(F.col(decision) == d, p) for d, p in priority.items()), F.lit(-1))
    return cases.groupBy(*keys).agg(F.max_by(decision, order).alias(decision))


def label_coverage(cases: DataFrame, domain: DataFrame, label: str) -> DataFrame:
    """(label, exact, routing) over the whole domain, zeros kept; ``cases`` has booleans exact and routing."""
    counts = cases.groupBy(label).agg(_count(F.col("exact")).alias("exact"), _count(F.col("routing")).alias("routing"))
    return domain.select(label).join(counts, label, "left").fillna(0, ["exact", "routing"])


def work_estimate(probes: DataFrame, references: DataFrame, pair_limit: int, character_limit: int) -> DataFrame:
    """One row: pairs, distinct pairs, characters, and the sorted names of the limits that they exceed."""
    p = probes.agg(F.count("*").alias("p"), F.count_distinct("content").alias("pd"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("pc"))
    r = references.agg(F.count("*").alias("r"), F.count_distinct("content").alias("rd"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("rc"))
    one = p.join(r, F.lit(True)).select((F.col("p") * F.col("r")).alias("pairs"), (F.col("pd") * F.col("rd")).alias("distinct_pairs"), (F.col("pc") + F.col("rc")).alias("characters"))
    blocked = F.array(F.when(F.col("pairs") > pair_limit, "pair_limit"), F.when(F.col("characters") > character_limit, "character_limit"))
    return one.withColumn("blockers", F.array_sort(F.filter(blocked, lambda x: x.isNotNull())))
