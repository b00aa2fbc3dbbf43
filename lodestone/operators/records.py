"""Rules over record tables: projections, policies, canonical orders, budgets, catalogs and evaluations.

Every operator is a plan of joins, groupings and windows; keys are given by name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio, ratio_or_perfect
from ..functions.text import escape_markdown
from ..session import small_side

# Necessities of a context candidate and roles of a match, in order.
NECESSITY = ("required", "helpful", "distractor")
ROLES = ("owner", "member", "mention")


def require_at_most(df: DataFrame, most: int, what: str) -> DataFrame:
    """``df`` as it is; more than ``most`` rows are an error and are never cut."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return df


def with_signals(queries: DataFrame, signals: DataFrame, key: str) -> DataFrame:
    """The queries that have any signal; the others need no search."""
    return queries.join(signals.select(key).distinct(), key, "left_semi")


def projected_facts(facts: DataFrame, units: DataFrame, closure: DataFrame) -> DataFrame:
    """(unit_id, fact_id): exact facts whose owner is below the unit's root and whose span lies in the unit's.

    ``facts`` (fact_id, owner, quality, start, end), ``units`` (unit_id, root, start, end), ``closure`` (root, id).
    """
    exact = facts.where("quality = 'exact'").select("fact_id", F.col("owner").alias("id"), F.col("start").alias("from"), F.col("end").alias("to"))
    rooted = exact.join(small_side(closure), "id")
    return rooted.join(small_side(units), "root").where("start <= from and to <= end").select("unit_id", "fact_id")


def export_decisions(records: DataFrame, policy: DataFrame, keys: list[str]) -> DataFrame:
    """``records`` with ``allowed``: whether the allowlist has a row of their keys; a null key is never allowed."""
    listed = policy.select(*keys, F.lit(True).alias("allowed")).distinct()
    return records.join(small_side(listed), keys, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def set_mismatch(declared: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): rows declared but not expected and the other way round, as distinct sets; none if both are equal."""
    a, b = declared.select(*keys).distinct(), expected.select(*keys).distinct()
    extra = a.exceptAll(b).withColumn("problem", F.lit("not_expected"))
    return extra.unionByName(b.exceptAll(a).withColumn("problem", F.lit("not_declared")))


def role_order(role: Column, roles: tuple[str, ...]) -> Column:
    """The place of a role in the list; unknown ones come last."""
    order = F.lit(len(roles))
    for k, name in reversed(list(enumerate(roles))):
        order = F.when(role == name, k).otherwise(order)
    return order


def ordered(rows: DataFrame, groups: list[str], keys: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with their place in each group under a total order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*keys)))


def canonical_keys(texts: list[str], numbers: list[str]) -> list[Column]:
    """Sort keys under which a missing text is empty and a missing number is 0."""
    return [F.coalesce(F.col(c), F.lit("")).asc() for c in texts] + [F.coalesce(F.col(c), F.lit(0)).asc() for c in numbers]


def normalized_changes(files: DataFrame, groups: list[str], old: str, new: str, line: str, binary: str) -> DataFrame:
    """Distinct changed files in canonical order, with ``diagnostic`` for those whose lines can't be compared."""
    once = files.dropDuplicates()
    marked = once.withColumn("diagnostic", F.when(F.col(binary), "binary_file").when(F.col(old).isNull() & F.col(new).isNull(), "no_path"))
    rest = [F.col(c).asc_nulls_first() for c in files.columns if c not in (old, new, line)]
    return ordered(marked, groups, [*canonical_keys([new, old], [line]), *rest])


def sides(base: DataFrame, head: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, source_role): rows of two sides by what became of them: added, removed, changed, kept."""
    both = base.select(*keys, F.col(value).alias("was"), F.lit(True).alias("b")).join(head.select(*keys, F.col(value).alias("is"), F.lit(True).alias("h")), keys, "full")
    role = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("is")), "kept").otherwise("changed")
    return both.select(*keys, role.alias("source_role"))


def budget_summary(items: DataFrame, groups: list[str], tokens: str, limit: int) -> DataFrame:
    """By group and over all: items, their sum and largest number of tokens, and how many are over the limit."""
    t = F.col(tokens)
    return items.groupingSets([[F.col(g) for g in groups], []], *map(F.col, groups)).agg(
        F.count("*").alias("n_items"), F.sum(t).alias("total_tokens"), F.max(t).alias("largest"), F.count_if(t > limit).alias("over_limit")
    )


def pooled_ratios(units: DataFrame, groups: list[str], parts: dict[str, tuple[str, str]]) -> DataFrame:
    """By group and over all: sums of numerators over sums of denominators, null where the latter is 0."""
    rates = [ratio(F.sum(a), F.sum(b)).alias(name) for name, (a, b) in parts.items()]
    return units.groupingSets([[F.col(g) for g in groups], []], *map(F.col, groups)).agg(*rates)


def regrouped(links: DataFrame, fragment: str, atom: str, ordinal: str) -> DataFrame:
    """(direction, key, members): the atoms of each fragment by ordinal, and the fragments of each atom, sorted."""
    forward = links.groupBy(F.col(fragment).cast("string").alias("key")).agg(F.array_sort(F.collect_set(F.struct(F.col(ordinal).alias("o"), F.col(atom).cast("string").alias("m")))).alias("l"))
    back = links.select(F.col(atom).cast("string").alias("key"), F.col(fragment).alias("m")).distinct().groupBy("key").agg(F.transform(F.array_sort(F.collect_list("m")), lambda x: x.cast("string")).alias("members"))
    forward = forward.select(F.lit("fragment").alias("direction"), "key", F.col("l.m").alias("members"))
    return forward.unionByName(back.select(F.lit("atom").alias("direction"), "key", "members"))


def catalog(inventory: DataFrame, cards: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """The whole inventory with what its cards say, ``carded``, and its place in each group."""
    found = inventory.join(cards.withColumn("carded", F.lit(True)), key, "left").withColumn("carded", F.coalesce("carded", F.lit(False)))
    return ordered(found, groups, [F.col(key).asc()], "ordinal")


def field_scores(counts: DataFrame, case: str, field: str) -> DataFrame:
    """tp, fp, fn with precision and recall by case, by field and over all, by the convention that nothing expected and nothing wrong is 1."""
    sets = counts.groupingSets([[F.col(case)], [F.col(field)], []], F.col(case), F.col(field)).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sets.select(case, field, "tp", "fp", "fn", ratio_or_perfect(tp, fp, fn, fp).alias("precision"), ratio_or_perfect(tp, fp, fn, fn).alias("recall"))


def bound_calls(calls: DataFrame, imports: DataFrame, shadows: DataFrame) -> DataFrame:
    """(call_id, canonical): calls whose alias an import of the file binds, outside the scopes that shadow it.

    ``calls`` (call_id, file, alias, line), ``imports`` (file, alias, canonical), ``shadows`` (file, alias, start, end).
    """
    bound = calls.join(small_side(imports), ["file", "alias"])
    hidden = small_side(shadows)
    at = (bound["file"] == hidden["file"]) & (bound["alias"] == hidden["alias"]) & bound["line"].between(hidden["start"], hidden["end"])
    return bound.join(hidden, at, "left_anti").select("call_id", "canonical")


def annotations(clauses: DataFrame, hits: list[DataFrame], key: str = "clause_id") -> DataFrame:
    """Every clause with the sorted set of each kind of hit (clause_id, kind, value)."""
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    sets = found.distinct().groupBy(key).agg(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "value"))).alias("annotations"))
    return clauses.select(key).join(sets, key, "left").withColumn("annotations", F.coalesce("annotations", F.array().cast("array<string>")))


def observed(truth: DataFrame, seen: DataFrame, case: str) -> DataFrame:
    """(case, found, missing, extra): for each case of the truth (case, value) whether anything was seen, and the sorted differences.

    A null value of the truth expects nothing; what is seen of other cases is left out.
    """
    t = truth.select(case, "value", F.lit(True).alias("wanted")).where("value is not null").distinct()
    s = seen.select(case, "value", F.lit(True).alias("there")).where("value is not null").distinct()
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("value"))))
    by_case = t.join(s, [case, "value"], "full").groupBy(case).agg(
        F.coalesce(F.bool_or("there"), F.lit(False)).alias("found"), pick(F.col("there").isNull()).alias("missing"), pick(F.col("wanted").isNull()).alias("extra")
    )
    none = F.array().cast("array<string>")
    cases = truth.select(case).distinct().join(by_case, case, "left")
    return cases.select(case, F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("missing", none).alias("missing"), F.coalesce("extra", none).alias("extra"))


def excerpts(lines: DataFrame, clauses: DataFrame, keys: list[str], before: int, after: int) -> DataFrame:
    """(keys, clause_id, start, end, excerpt): the lines around each clause (keys, clause_id, start, end), as far as the document goes.

    ``lines`` (keys, line, text).  A clause asks for each of its lines by number, so the
    join is on (keys, line) and no document is gathered; repeated line numbers are an
    error of the input and are joined in the order of their texts.
    """
    asked = clauses.select(*keys, "clause_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("start") - before), F.col("end") + after)).alias("line"))
    found = asked.join(lines.select(*keys, "line", "text"), [*keys, "line"])
    return found.groupBy(*keys, "clause_id").agg(
        F.min("line").alias("start"), F.max("line").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("excerpt")
    )


def extracted(documents: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]], media_type: str = "media_type") -> DataFrame:
    """The rows of every extractor over the documents of its media type; a type without one is an error."""
    other = documents.where(F.col(media_type).isNull() | ~F.col(media_type).isin(*extractors)).select(media_type).first()
    if other is not None:
        raise ValueError(f"unsupported media type: {other[0]}")
    return reduce(DataFrame.unionByName, (extract(documents.where(F.col(media_type) == kind)) for kind, extract in extractors.items()))


def span_problems(spans: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` (keys, start, end, anchor) with ``problem``, null where a span lies in its document (keys, n_lines) and its anchor names it.

    A span has the first that holds of unknown_document, no_lines (null, under 1 or
    reversed), out_of_range and other_anchor (a null anchor too).
    """
    start, end = F.col("start"), F.col("end")
    known = documents.select(*keys, F.col("n_lines").alias("__lines"), F.lit(True).alias("__known"))
    anchor = F.concat(F.lit("L"), start.cast("string"), F.lit("-L"), end.cast("string"))
    problem = F.when(F.col("__known").isNull(), "unknown_document").when(~F.coalesce((start >= 1) & (start <= end), F.lit(False)), "no_lines")
    problem = problem.when(end > F.coalesce("__lines", F.lit(0)), "out_of_range").when(~F.col("anchor").eqNullSafe(anchor), "other_anchor")
    return spans.join(known, keys, "left").withColumn("problem", problem).drop("__lines", "__known")


def rendered(titles: DataFrame, entries: DataFrame, key: str, categories: dict[str, str]) -> DataFrame:
    """(key, markdown): the title of each document (key, title), then its entries (key, category, ordinal, title) under the label of each category.

    Categories come in the order of ``categories``; those without entries, and entries
    of other categories, aren't shown.  A section is gathered by (key, category) first.
    """
    line = F.concat(F.lit("- "), escape_markdown(F.coalesce("title", F.lit(""))))
    place = role_order(F.col("category"), tuple(categories))
    sections = entries.where(F.col("category").isin(*categories)).groupBy(key, "category").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines"))
    label = F.coalesce(*(F.when(F.col("category") == c, label) for c, label in categories.items()))
    text = F.concat(F.lit("### "), label, F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    whole = sections.select(key, F.struct(place.alias("place"), text.alias("text")).alias("section")).groupBy(key).agg(F.array_sort(F.collect_list("section")).alias("sections"))
    body = F.array_join(F.transform(F.coalesce("sections", F.array().cast("array<struct<place:int,text:string>>")), lambda x: F.concat(F.lit("\n"), x["text"])), "")
    head = F.concat(F.lit("# "), escape_markdown(F.coalesce("title", F.lit(""))), F.lit("\n"))
    return titles.select(key, "title").join(whole, key, "left").select(key, F.concat(head, body).alias("markdown"))
