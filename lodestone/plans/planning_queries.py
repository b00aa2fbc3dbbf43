"""Plans under a budget over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, planning
from ..session import table

BUDGET = 260


def _plan(spark, sf_dir):
    """Customers as groups, their orders of even and odd key as questions, and each order as a candidate of its items' tokens."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), F.floor(F.abs("c_acctbal") / 35).alias("primary_tokens"), (F.col("c_mktsegment") == "MACHINERY").alias("blocked"))
    tokens = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("candidate_id")).agg(F.sum("l_quantity").cast("long").alias("tokens"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), (F.col("o_orderkey") % 2).alias("question_id"), F.col("o_orderkey").alias("candidate_id"), F.col("o_orderstatus").alias("status"))
    k = F.col("candidate_id")
    need = F.when(F.col("status") == "P", "required").when(k % 13 == 0, "distractor").otherwise("helpful")
    o = o.join(tokens, "candidate_id").withColumn("seq", k).withColumn("necessity", need).withColumn("relation_type", F.when(k % 19 == 0, "same_file").otherwise("calls")).withColumn("quality", F.when(k % 17 == 0, "partial").otherwise("exact"))
    questions = c.select("group_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("question_id"))
    return planning.context_plan(c, questions, o, BUDGET)


def context_decisions(spark, sf_dir):
    """What becomes of each candidate, and why."""
    return _plan(spark, sf_dir)[0]


def context_bundles(spark, sf_dir):
    """The bundles of each question, with what they hold and whether they may go out."""
    return _plan(spark, sf_dir)[1]


def distinct_picks(spark, sf_dir):
    """Brands and types of parts as families: each takes the smallest size that no family before it has."""
    p = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("family"), F.col("p_size").alias("member"))
    return planning.distinct_picks(p, graph.work_folder(spark))


_PLAN_SQL = f"""
    WITH RECURSIVE g AS (SELECT c_custkey AS g, CAST(floor(abs(c_acctbal) / 35) AS BIGINT) AS primary_tokens, c_mktsegment = 'MACHINERY' AS blocked FROM customer),
    t AS (SELECT l_orderkey AS k, CAST(sum(l_quantity) AS BIGINT) AS tokens FROM lineitem GROUP BY 1),
    c AS (SELECT g.*, o_orderkey % 2 AS q, k, tokens, o_orderstatus = 'P' AS req,
            CASE WHEN (o_orderstatus <> 'P' AND k % 13 = 0) OR k % 19 = 0 THEN 'distractor_rejected' WHEN k % 17 = 0 THEN 'relation_degraded' WHEN blocked THEN 'context_blocked' WHEN primary_tokens > {BUDGET} THEN 'budget_exceeded' END AS refused
          FROM orders JOIN t ON k = o_orderkey JOIN g ON g = o_custkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY g, q ORDER BY k) AS n FROM c WHERE req AND refused IS NULL),
    rw(g, q, n, k, spent, ok) AS (
        SELECT g, q, n, k, CASE WHEN primary_tokens + tokens <= {BUDGET} THEN tokens ELSE 0 END, primary_tokens + tokens <= {BUDGET} FROM r WHERE n = 1
        UNION ALL SELECT r.g, r.q, r.n, r.k, rw.spent + CASE WHEN primary_tokens + rw.spent + tokens <= {BUDGET} THEN tokens ELSE 0 END, primary_tokens + rw.spent + tokens <= {BUDGET} FROM rw JOIN r ON r.g = rw.g AND r.q = rw.q AND r.n = rw.n + 1),
    state AS (SELECT g.g, q.q, primary_tokens, blocked, coalesce((SELECT max(spent) FROM rw WHERE rw.g = g.g AND rw.q = q.q), 0) AS spent,
                EXISTS (SELECT 1 FROM rw WHERE rw.g = g.g AND rw.q = q.q AND NOT ok) OR EXISTS (SELECT 1 FROM c WHERE c.g = g.g AND c.q = q.q AND req AND refused IS NOT NULL) AS missing,
                EXISTS (SELECT 1 FROM c WHERE c.g = g.g AND c.q = q.q AND refused = 'relation_degraded') AS degraded FROM g, (VALUES (0), (1)) q(q)),
    h AS (SELECT c.g, c.q, k, tokens, {BUDGET} - c.primary_tokens - spent AS room, row_number() OVER (PARTITION BY c.g, c.q ORDER BY k) AS n FROM c JOIN state s ON s.g = c.g AND s.q = c.q WHERE NOT req AND refused IS NULL AND NOT missing),
    hw(g, q, n, k, used, bin) AS (
        SELECT g, q, n, k, CASE WHEN tokens <= room THEN [tokens] ELSE [0] END, CASE WHEN tokens <= room THEN 1 END FROM h WHERE n = 1
        UNION ALL SELECT g, q, n, k, CASE WHEN slot IS NULL THEN used WHEN slot > len(used) THEN list_append(used, tokens) ELSE list_concat(used[: slot - 1], [used[slot] + tokens], used[slot + 1 :]) END, slot
        FROM (SELECT h.g, h.q, h.n, h.k, h.tokens, hw.used, CASE WHEN h.tokens <= room THEN coalesce(list_position(list_transform(hw.used, lambda u: u + h.tokens <= h.room), true), len(hw.used) + 1) END AS slot
              FROM hw JOIN h ON h.g = hw.g AND h.q = hw.q AND h.n = hw.n + 1))
"""

QUERIES = {f.__name__: f for f in (context_decisions, context_bundles, distinct_picks)}
ORACLES = {
    "context_decisions": f"""{_PLAN_SQL}
        SELECT g AS group_id, q AS question_id, k AS candidate_id, CASE WHEN ok THEN 'selected' ELSE 'omitted' END AS status, CASE WHEN ok THEN 'required_context' ELSE 'budget_exceeded' END AS reason, CAST(NULL AS INT) AS bin FROM rw
        UNION ALL SELECT g, q, k, CASE WHEN bin IS NULL THEN 'omitted' ELSE 'selected' END, CASE WHEN bin IS NULL THEN 'budget_exceeded' ELSE 'helpful_context' END, CAST(bin - 1 AS INT) FROM hw
        UNION ALL SELECT g, q, k, 'omitted', refused, NULL FROM c WHERE refused IS NOT NULL
        UNION ALL SELECT c.g, c.q, k, 'omitted', 'context_blocked', NULL FROM c JOIN state s ON s.g = c.g AND s.q = c.q WHERE NOT req AND refused IS NULL AND missing""",
    "context_bundles": f"""{_PLAN_SQL}, full_bins AS (SELECT g, q, arg_max(used, n) AS used FROM hw GROUP BY g, q),
        b AS (SELECT s.*, unnest(coalesce(used, [0])) AS u, generate_subscripts(coalesce(used, [0]), 1) - 1 AS bin, (missing OR blocked OR primary_tokens > {BUDGET}) AS poor FROM state s LEFT JOIN full_bins f ON f.g = s.g AND f.q = s.q)
        SELECT g AS group_id, CAST(q AS BIGINT) AS question_id, CAST(bin AS INT) AS bin, CAST(spent + u AS BIGINT) AS supporting_tokens, CAST(primary_tokens + spent + u AS BIGINT) AS total_tokens, NOT poor AS dispatch_allowed,
               concat_ws(',', CASE WHEN poor THEN 'context_insufficient' END, CASE WHEN primary_tokens > {BUDGET} THEN 'primary_exceeds_budget' END, CASE WHEN degraded THEN 'relation_degraded' END) AS issues FROM b""",
    "distinct_picks": """
        WITH RECURSIVE f AS (SELECT p_brand || '/' || p_type AS family, list(DISTINCT p_size) AS m FROM part GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY len(m), family) AS n FROM f),
        w(n, family, pick, used) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS INT), CAST([] AS INT[])
            UNION ALL SELECT n, family, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END
            FROM (SELECT o.n, o.family, list_min(list_filter(o.m, lambda x: NOT list_contains(w.used, x))) AS pick, w.used FROM w JOIN o ON o.n = w.n + 1))
        SELECT family, pick FROM w WHERE pick IS NOT NULL""",
}
