"""Rule tagging: triggers over long facts, tags to dimensions, dimensions to questions.

``facts`` is (unit_id, scope, kind, value); ``rules`` is (tag_id, status, trigger,
value), a bounded table from the configuration.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .retrieval import found_keywords


def leaf(value):
    """The text after the last dot."""
    return F.substring_index(value, ".", -1)


def _of(rules: DataFrame, trigger: str) -> DataFrame:
    return small_side(rules.where(F.col("trigger") == trigger).select("tag_id", "status", "on_kind", F.col("value").alias("__v")))


def _hits(joined: DataFrame) -> DataFrame:
    return joined.select("unit_id", "scope", "tag_id", "status", "kind", "value")


def exact_hits(facts: DataFrame, rules: DataFrame) -> DataFrame:
    r = _of(rules, "exact")
    return _hits(facts.join(r, (facts["kind"] == r["on_kind"]) & (facts["value"] == r["__v"])))


def leaf_hits(facts: DataFrame, rules: DataFrame) -> DataFrame:
    r = _of(rules, "leaf")
    return _hits(facts.join(r, (facts["kind"] == r["on_kind"]) & (leaf(facts["value"]) == r["__v"])))


def affix_hits(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Prefix and suffix triggers: a nested-loop join with the few rules of the configuration."""
    found = []
    for trigger, test in (("prefix", lambda f, v: f.startswith(v)), ("suffix", lambda f, v: f.endswith(v))):
        r = _of(rules, trigger)
        found.append(_hits(facts.join(r, (facts["kind"] == r["on_kind"]) & test(facts["value"], r["__v"]))))
    return found[0].unionByName(found[1])


def owner_role_hits(facts: DataFrame, roles: DataFrame, role_rules: DataFrame) -> DataFrame:
    """Symbol leaf together with the owner's role: facts, roles (unit_id, role), rules (tag_id, status, leaf, role)."""
    symbols = facts.where("kind = 'symbol'").withColumn("leaf", leaf(F.col("value")))
    joined = symbols.join(roles, "unit_id").join(small_side(role_rules), ["leaf", "role"])
    return _hits(joined)


def match_tags(facts: DataFrame, rules: DataFrame, *more: DataFrame) -> DataFrame:
    """(unit_id, scope, tag_id, status, kind, value), distinct, of all triggers."""
    parts = [exact_hits(facts, rules), leaf_hits(facts, rules), affix_hits(facts, rules), *more]
    return reduce(DataFrame.unionByName, parts).distinct()


def unit_tags(hits: DataFrame) -> DataFrame:
    """(unit_id, exact_tags, routing_tags, shadow_tags): Active tags by scope, Draft ones apart, Deprecated ones out."""

    def sets(cond):
        return F.array_sort(F.collect_set(F.when(cond, F.col("tag_id"))))

    active = F.col("status") == "Active"
    return hits.groupBy("unit_id").agg(
        sets(active & (F.col("scope") == "unit_exact")).alias("exact_tags"), sets(active).alias("routing_tags"), sets(F.col("status") == "Draft").alias("shadow_tags")
    )


def route_dimensions(tags: DataFrame, dimensions: DataFrame, dimension_tags: DataFrame) -> DataFrame:
    """(unit_id, dimension_id, by_tag, review): a dimension is routed if it is always checked or shares a tag.

    ``tags`` (unit_id, tag_id), ``dimensions`` (dimension_id, always_check), ``dimension_tags`` (dimension_id, tag_id).
    """
    by_tag = tags.join(small_side(dimension_tags), "tag_id").select("unit_id", "dimension_id").distinct().withColumn("by_tag", F.lit(True))
    always = tags.select("unit_id").distinct().crossJoin(small_side(dimensions.where("always_check").select("dimension_id"))).withColumn("by_tag", F.lit(False))
    both = by_tag.unionByName(always)
    return both.groupBy("unit_id", "dimension_id").agg(F.bool_or("by_tag").alias("by_tag")).withColumn("review", F.lit(True))


def bind_questions(routes: DataFrame, tags: DataFrame, questions: DataFrame, question_tags: DataFrame) -> DataFrame:
    """(unit_id, dimension_id, question_id): questions of routed dimensions that always bind or share a tag."""
    candidates = routes.join(small_side(questions), "dimension_id")
    tagged = tags.join(small_side(question_tags), "tag_id").select("unit_id", "question_id").distinct().withColumn("__t", F.lit(True))
    joined = candidates.join(tagged, ["unit_id", "question_id"], "left")
    return joined.where("always_bind or __t").select("unit_id", "dimension_id", "question_id")


def keyword_tags(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, target): rules (keyword, target) whose keyword the lower-cased text holds."""
    hits = found_keywords(texts.select("doc_id", "text"), rules, "text", "keyword").select("doc_id", "keyword")
    return hits.join(rules.select(F.lower("keyword").alias("keyword"), "target").distinct(), "keyword").select("doc_id", "target").distinct()


def compare_configs(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two results that differ: (keys, before, after, change)."""
    a = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("__a"))
    b = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("__b"))
    both = a.join(b, keys, "full_outer").where(F.col("__a").isNull() | F.col("__b").isNull() | ~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("changed")
    return both.select(*keys, "before", "after", change.alias("change"))


def candidate_dimensions(tags: DataFrame, dimensions: DataFrame, statuses: tuple[str, ...] = ("Active", "Draft")) -> DataFrame:
    """(unit_id, dimension_id): dimensions (dimension_id, tag_id, status) one of whose tags the unit (unit_id, tag_id) has."""
    live = dimensions.where(F.col("status").isin(*statuses)).select("dimension_id", "tag_id").distinct()
    return tags.select("unit_id", "tag_id").distinct().join(small_side(live), "tag_id").select("unit_id", "dimension_id").distinct()
