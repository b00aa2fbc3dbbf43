"""Mixing to target weights by soft domain membership.

A classifier learned from the table of labels gives each document posteriors
over domains: naive Bayes over hashed words for each of two labels (quality and
toxic), whose product gives four domains.  Least squares then finds document
rates >= 0, as near to 1 as may be (a document counts by its tokens), so that the
expected tokens of each domain, ``sum(rate * tokens * posterior)``, meet targets:
shares of the tokens that are wanted in all.

Projected gradient, lazily projected: the gradient of a document's rate is
``posterior . residual`` whatever its rate is, so all steps so far are summed up
in one vector of four numbers, and a rate is the projection of ``1 + posterior .
steps`` to 0 and more.  Rates are never stored, and a step is one distributed sum.
A step is scaled by the inverse Gram matrix of the documents that are not held
at 0 and is halved until the (convex) objective falls.  Steps stay in the span of
the posteriors, which may have fewer dimensions than there are domains (few labels,
uniform texts).  ``RIDGE`` weighs the rates' distance from 1 against the squared
residual: targets that can be met are met to about that share, and targets out
of reach are met in the sense of least squares; the steps then add up to large
numbers, and the fit ends where the residual is within their rounding.  A fit that
has not converged after ``MAX_STEPS`` raises.

DataFrame and SQL functions only.  Word log odds are integers (thousandths), so
sums don't depend on the order of rows.

Null and empty texts have no tokens and the prior's posteriors.  Labels that are
null or contradict each other teach nothing; a label without both values gives
everything the prior's share.  Rows that repeat a doc_id are rows of their own.
An empty table gives no rows; a table without tokens keeps rates of 1.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Domains in the order of the posteriors: (quality, toxic).
DOMAINS = ("q1t0", "q1t1", "q0t0", "q0t1")
#: Shares of the wanted tokens by domain; what is wanted in all is a multiple of what there is.
WEIGHTS = {"q1t0": 0.98, "q1t1": 0.001, "q0t0": 0.0185, "q0t1": 0.0005}
TOTAL = 1.0
BUCKETS = 1 << 16
#: Labelled rows that teach, at most.
MAX_ROWS = 20_000
#: Buckets with weaker log odds or fewer labelled documents say nothing; the sum of the others is tempered, as words depend on each other.
MIN_ODDS, MIN_DOCS, TEMPER = 1.0, 5, 0.7
MAX_STEPS, TOLERANCE, RIDGE = 200, 1e-9, 1e-9
#: Directions with less than this share of the largest variance aren't told apart; the rounding of a sum of a few products, relative to its parts.
RANK_SHARE, ROUNDING = 1e-12, 16 * np.finfo(float).eps
_SCALE = 1000
_SPLIT = r"[\x20\x09-\x0D]+"


def _words(text: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda w: w != "")


def _bucket(word: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _log_odds(pos: np.ndarray, neg: np.ndarray) -> list[int]:
    """Thousandths of log P(bucket | 1) / P(bucket | 0), with a count of 1 added to each."""
    odds = np.log((pos + 1) / (pos.sum() + len(pos))) - np.log((neg + 1) / (neg.sum() + len(neg)))
    odds[(np.abs(odds) < MIN_ODDS) | (pos + neg < MIN_DOCS)] = 0
    return [int(x) for x in np.rint(odds * _SCALE)]


def _learn(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> tuple[list[int], float]:
    """(log odds by bucket, share of label 1); counts are over documents that hold a word of the bucket.

    Labels without a document take no place in the sample and no part in the share.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("high")).where("y = high").drop("high")
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    taught = docs.join(F.broadcast(sample), "doc_id")
    words = taught.select("y", F.explode(F.array_distinct(F.transform(_words(F.col("text")), _bucket))).alias("bucket"))
    counts = words.groupBy("bucket", "y").count().agg(F.collect_list(F.struct("y", "bucket", "count")).alias("l"))  # at most 2 * BUCKETS entries
    counts = counts.select("l.y", "l.bucket", "l.count").first()
    seen = np.zeros((2, BUCKETS))
    seen[counts["y"], counts["bucket"]] = counts["count"]
    sizes = {r["y"]: r["count"] for r in taught.groupBy("y").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not (sizes.get(0) and sizes.get(1)):
        return [0] * BUCKETS, share if sizes else 0.5
    return _log_odds(seen[1], seen[0]), share


def _posterior(model: tuple[list[int], float]) -> F.Column:
    """P(label = 1) from the distinct word buckets in column ``buckets``."""
    odds, share = model
    table = F.from_json(F.lit(str(odds)), "array<int>")  # folded to one literal
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    prior = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    margin = F.lit(prior) + total * F.lit(TEMPER / _SCALE)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), margin))))


def posteriors(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, taught_by: DataFrame | None = None) -> DataFrame:
    """(row, tokens long, posterior array<double> in the order of DOMAINS); row is a struct of the columns of ``docs``.

    The labelled rows of ``taught_by`` teach, or those of ``docs``.  Where ``docs``
    was filtered by something that goes with a label, give what it was taken from.
    """
    taught_by = docs if taught_by is None else taught_by
    plain = taught_by.select(taught_by["doc_id"].cast("long").alias("doc_id"), taught_by["text"].cast("string").alias("text"))
    models = _learn(plain, labels, "quality", max_rows), _learn(plain, labels, "toxic", max_rows)
    text = docs["text"].cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.transform(_words(text), _bucket).alias("words"))
    rows = rows.select("row", F.size("words").cast("long").alias("tokens"), F.array_distinct("words").alias("buckets"))
    rows = rows.select("row", "tokens", *(_posterior(m).alias(n) for m, n in zip(models, ("q", "t"), strict=True)))
    q, t = F.col("q"), F.col("t")
    return rows.select("row", "tokens", F.array(q * (1 - t), q * t, (1 - q) * (1 - t), (1 - q) * t).alias("posterior"))


def wanted(mass: np.ndarray, weights: dict[str, float] | None, total: float, raised: dict[str, float] | None) -> np.ndarray:
    """Tokens wanted of each domain: shares of ``total`` times the tokens there, or multiples of what each domain has."""
    if raised is not None:
        return mass * np.array([raised.get(d, 1.0) for d in DOMAINS])
    shares = np.array([(WEIGHTS if weights is None else weights).get(d, 0.0) for d in DOMAINS])
    if not (shares >= 0).all() or not shares.sum() > 0:
        raise ValueError("target weights must be 0 or more, and one of them must be larger")
    return shares / shares.sum() * total * mass.sum()


def fit_rates(weighted: DataFrame, weights: dict[str, float] | None = None, total: float = TOTAL, raised: dict[str, float] | None = None) -> tuple[np.ndarray, dict]:
    """(the sum of all steps, a report) over (tokens, posterior); ``rate_column`` gives the rates.

    In units of all tokens, with x = the sum of steps, the objective is
    ``sum(tokens * max(0, 1 + posterior . x) ** 2) / 2 - target . x + RIDGE * x . x / 2``;
    its gradient is the residual of the targets, negated.
    """
    n = len(DOMAINS)
    p, t = [F.col("posterior")[k] for k in range(n)], F.col("tokens").cast("double")

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(sum of weighted squared rates, tokens reached, Gram matrix of rates over 0)."""
        rate = F.col("rate")
        live = t * (rate > 0).cast("double")
        sums = weighted.withColumn("rate", rate_column(x)).agg(
            F.sum(t * rate * rate).alias("s"), *(F.sum(t * rate * p[i]).alias(f"m{i}") for i in range(n)), *(F.sum(live * p[i] * p[j]).alias(f"g{i}{j}") for i in range(n) for j in range(i, n))
        ).first()
        gram = np.array([[sums[f"g{min(i, j)}{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
        return sums["s"] or 0.0, np.array([sums[f"m{i}"] or 0.0 for i in range(n)]), gram

    x = np.zeros(n)
    square, mass, gram = at(x)
    scale, target = mass.sum(), wanted(mass, weights, total, raised)
    report = {"mass": mass.tolist(), "target": target.tolist(), "reached": mass.tolist(), "steps": 0}
    if scale == 0:
        return x, report
    span = _span(gram / scale)  # a step outside the posteriors' span changes no rate
    objective, reached = square / scale / 2, mass
    for step in range(MAX_STEPS):
        slope = span @ (span.T @ ((reached - target) / scale + RIDGE * x))
        report |= {"reached": reached.tolist(), "steps": step}
        move = -span @ np.linalg.solve(span.T @ gram @ span / scale + RIDGE * np.eye(span.shape[1]), span.T @ slope)
        rounding = ROUNDING * np.abs(x).sum()  # of 1 + posterior . x, and so of the tokens reached
        if -slope @ move <= TOLERANCE**2 or np.abs(slope).max() <= TOLERANCE + rounding:
            return x, report
        for _ in range(60):
            square, reached, gram = at(x + move)
            y = x + move
            value = square / scale / 2 - target @ y / scale + RIDGE * y @ y / 2
            if value <= objective + 1e-4 * slope @ move + 1e-14 * max(1.0, abs(objective)):
                break
            move = move / 2
        else:
            return x, report  # no step lowers the objective within the precision of its sums
        x, objective = y, value
    raise RuntimeError(f"rates have not converged after {MAX_STEPS} steps: {report}")


def _span(gram: np.ndarray) -> np.ndarray:
    """An orthonormal basis (columns) of what the posteriors span."""
    values, vectors = np.linalg.eigh(gram)
    return vectors[:, values > RANK_SHARE * values.max()]


def rate_column(steps: np.ndarray) -> F.Column:
    rate = F.lit(1.0)
    for k, x in enumerate(steps.tolist()):
        rate = rate + F.col("posterior")[k] * F.lit(x)
    return F.greatest(F.lit(0.0), rate)


def _copies(rate: F.Column, key: F.Column) -> F.Column:
    """The rate rounded down, and one more by a hash of the key with the probability of what is left."""
    chance = F.pmod(F.xxhash64(F.lit("copies"), key), F.lit(1_000_003)) / F.lit(1_000_003.0)
    whole = F.floor(rate)
    return (whole + F.when(chance < rate - whole, 1).otherwise(0)).cast("long")


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, total: float = TOTAL, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, n_tokens, the domains' posteriors, rate, copies) of every row."""
    scratch = Scratch(docs.sparkSession, "mixing")
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    weighted = scratch.table(posteriors(plain, labels, max_rows).select("row.doc_id", "tokens", "posterior"), "posteriors")
    steps, _ = fit_rates(weighted, weights, total)
    rows = weighted.select("doc_id", F.col("tokens").alias("n_tokens"), *(F.col("posterior")[k].alias(d) for k, d in enumerate(DOMAINS)), rate_column(steps).alias("rate"))
    return rows.withColumn("copies", _copies(F.col("rate"), F.col("doc_id")))


def mix(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, total: float = TOTAL, raised: dict[str, float] | None = None, max_rows: int = MAX_ROWS, taught_by: DataFrame | None = None
) -> DataFrame:
    """``docs`` with as many copies of each row as its rate asks for; ``raised`` states targets as multiples of what each domain has."""
    scratch = Scratch(docs.sparkSession, "mix")
    weighted = scratch.table(posteriors(docs, labels, max_rows, taught_by), "posteriors")
    steps, _ = fit_rates(weighted, weights, total, raised)
    copies = _copies(rate_column(steps), F.col("row.doc_id"))
    copied = weighted.select("row", copies.cast("int").alias("copies")).where("copies > 0")
    return copied.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
