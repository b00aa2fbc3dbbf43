"""Roles of the owners of symbols, with a reason wherever there is doubt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decorators that say what a type is.
COMPONENT, ENTRY, DIALOG = ("@Component", "@ComponentV2"), "@Entry", "@CustomDialog"
#: Roles of a type with a component decorator, and of one that is an entry as well.
ROLES = ("component", "page")


def owner_roles(units: DataFrame, declarations: DataFrame, occurrences: DataFrame, roles: tuple[str, str] = ROLES) -> tuple[DataFrame, DataFrame]:
    """(evidence, diagnostics) of units that are methods, structs or classes.

    ``units`` (unit_id, file, unit_kind, owner_id), ``declarations`` (file, declaration_id,
    kind, qualified, parent_id, quality), ``occurrences`` (file, kind decorator or symbol,
    name, owner_id, quality).  evidence: (unit_id, symbol, owner_role, method_id,
    enclosing_id), for a unit's methods whose symbol is there once.  A unit abstains, with
    one code in diagnostics (unit_id, code), where its declaration, the type around it or
    the role of that type isn't there exactly once and exact: unit_unresolved,
    enclosing_owner_unresolved, recovered, role_unresolved or role_ambiguous; a method that is
    left out adds recovered, symbol_unresolved or symbol_ambiguous.
    """
    n_rows = declarations.groupBy("file", "declaration_id").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("kind", "qualified", "parent_id", "quality")))
    one = n_rows.where("n = 1").drop("n")
    side = lambda name, *keys: one.select("file", *(F.col(c).alias(k) for c, k in keys), F.struct("kind", "parent_id", "quality").alias(name))
    counts = occurrences.where(F.col("kind") == "decorator").where(F.col("name").isin(*COMPONENT, ENTRY, DIALOG)).groupBy("file", F.col("owner_id").alias("enclosing_id")).agg(
        F.count_if(F.col("name").isin(*COMPONENT)).alias("components"), F.count_if(F.col("name") == ENTRY).alias("entries"), F.count_if(F.col("name") == DIALOG).alias("dialogs"), F.count_if(~_exact("quality")).alias("unsure"),
    )
    u = units.where(F.col("unit_kind").isin("method", "struct", "class")).join(side("own", ("declaration_id", "owner_id")), ["file", "owner_id"], "left")
    u = u.withColumn("enclosing_id", F.when(F.col("own.kind") == "method", F.col("own.parent_id")).otherwise(F.col("owner_id")))
    u = u.join(side("around", ("declaration_id", "enclosing_id")), ["file", "enclosing_id"], "left").join(counts, ["file", "enclosing_id"], "left").fillna(0, ["components", "entries", "dialogs", "unsure"])
    code = _first(
        (F.col("own").isNull(), "unit_unresolved"), (~_exact("own.quality"), "recovered"), (F.col("own.kind") != F.col("unit_kind"), "unit_unresolved"),
        (F.col("around").isNull(), "enclosing_owner_unresolved"), (~_exact("around.quality"), "recovered"), (F.col("around.kind") != "struct", "role_unresolved"), (F.col("unsure") > 0, "recovered"),
        ((F.col("dialogs") > 0) & (F.col("components") + F.col("entries") > 0), "role_ambiguous"), ((F.col("dialogs") > 0) | (F.col("components") == 0), "role_unresolved"),
        ((F.col("components") != 1) | (F.col("entries") > 1), "role_ambiguous"),
    )
    u = u.withColumn("code", code)
    good = u.where("code is null").select("unit_id", "file", "owner_id", "enclosing_id", "unit_kind", "entries")
    methods = declarations.where("kind = 'method'").select("file", F.col("declaration_id").alias("method_id"), F.col("parent_id"), "qualified", "quality")
    itself = good.where("unit_kind = 'method'").join(methods.withColumn("owner_id", F.col("method_id")), ["file", "owner_id"])
    inside = good.where("unit_kind <> 'method'").join(methods.withColumn("owner_id", F.col("parent_id")), ["file", "owner_id"])
    symbols = occurrences.where("kind = 'symbol'").groupBy("file", F.col("owner_id").alias("method_id"), F.col("name").alias("qualified")).agg(F.count("*").alias("n"), F.count_if(~_exact("quality")).alias("doubts"))
    m = itself.unionByName(inside).join(symbols, ["file", "method_id", "qualified"], "left").fillna(0, ["n", "doubts"])
    m = m.withColumn("code", _first((~_exact("quality") | (F.col("doubts") > 0), "recovered"), (F.col("n") == 0, "symbol_unresolved"), (F.col("n") > 1, "symbol_ambiguous")))
    role = F.explode(F.when(F.col("entries") > 0, F.array(F.lit(roles[0]), F.lit(roles[1]))).otherwise(F.array(F.lit(roles[0]))))
    evidence = m.where("code is null").select("unit_id", F.col("qualified").alias("symbol"), role.alias("owner_role"), "method_id", "enclosing_id")
    return evidence, u.select("unit_id", "code").unionByName(m.select("unit_id", "code")).where("code is not null").distinct()


def _exact(quality: str) -> Column:
    return F.col(quality).eqNullSafe("exact")


def _first(*cases: tuple[Column, str]) -> Column:
    """The name of the first case that holds, null if none does."""
    return reduce(lambda found, case: F.when(case[0], case[1]).otherwise(found), reversed(cases), F.lit(None).cast("string"))
