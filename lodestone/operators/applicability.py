"""Three-valued applicability: applicable, unknown or excluded, with sorted reasons.

A missing (null) fact of the target is unknown; an empty set is known to be empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wanted(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def reasons() -> tuple[Column, Column]:
    """(excluding, unknown) reasons from rule columns min_level, max_level, releases, modes, permissions, capabilities
    and target columns t_level, t_release, t_mode, t_permissions, t_capabilities."""
    bound = F.col("min_level").isNotNull() | F.col("max_level").isNotNull()
    excluding = [
        F.when(F.col("t_level") < F.col("min_level"), "api_level_below_minimum"),
        F.when(F.col("t_level") > F.col("max_level"), "api_level_above_maximum"),
    ]
    unknown = [F.when(bound & F.col("t_level").isNull(), "api_level_unknown")]
    for rule, target, name in (("releases", "t_release", "release"), ("modes", "t_mode", "language_mode")):
        excluding.append(F.when(_wanted(rule) & ~F.array_contains(rule, F.col(target)), f"{name}_not_applicable"))
        unknown.append(F.when(_wanted(rule) & F.col(target).isNull(), f"{name}_unknown"))
    for rule, target, name in (("permissions", "t_permissions", "permission"), ("capabilities", "t_capabilities", "system_capability")):
        excluding.append(F.when(_wanted(rule) & (F.size(F.array_except(rule, target)) > 0), f"{name}_missing"))
        unknown.append(F.when(_wanted(rule) & F.col(target).isNull(), f"{name}_set_unknown"))
    present = lambda parts: F.array_sort(F.filter(F.array(*parts), lambda x: x.isNotNull()))
    return present(excluding), present(unknown)


def evaluate(pairs):
    """``pairs`` of rule and target columns with ``decision`` and ``reasons``; an exclusion outweighs what is unknown."""
    excluding, unknown = reasons()
    both = pairs.withColumn("__x", excluding).withColumn("__u", unknown)
    decision = F.when(F.size("__x") > 0, "excluded").when(F.size("__u") > 0, "unknown").otherwise("applicable")
    why = F.when(F.size("__x") > 0, F.col("__x")).otherwise(F.col("__u"))
    return both.withColumn("decision", decision).withColumn("reasons", why).drop("__x", "__u")
