"""What clauses are about: tags by keywords, names of known interfaces, and dimensions of the tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import identifier_signals
from ..operators import graph
from ..operators.retrieval import found_keywords
from ..operators.tagging import candidate_dimensions


def annotate(clauses: DataFrame, keywords: DataFrame, interfaces: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(id, clause, tags, dimension_ids, interfaces), sorted arrays, of every clause (id, clause, text, heading_path, parent_context).

    A clause has the tags of ``keywords`` (keyword, tag_id) that its text, its context or
    a heading above it holds in lower case; ``interfaces`` (name) of its text are those that
    are called, quoted or used as a decorator there, or whose last part is; dimensions come
    from ``dimensions`` (dimension_id, tag_id, status), deprecated ones not.
    """
    key = ["id", "clause"]
    clauses = graph.written(clauses.select(*key, "text", "heading_path", "parent_context"), f"{graph.work_folder(clauses.sparkSession)}/clauses")  # else each part would find them anew
    context = F.concat_ws("\n", "text", "parent_context", F.array_join("heading_path", "\n"))
    hits = found_keywords(clauses.select(*key, context.alias("context")), keywords, "context", "keyword").select(*key, "keyword")
    tags = hits.join(keywords.select(F.lower("keyword").alias("keyword"), "tag_id").distinct(), "keyword").select(*key, "tag_id").distinct()
    units = tags.select(F.struct(*key).alias("unit_id"), "tag_id")
    found = candidate_dimensions(units, dimensions).select("unit_id.*", "dimension_id")
    named = clauses.select(*key, F.explode(identifier_signals(F.col("text"))).alias("signal"))
    known = interfaces.select("name", F.explode(F.array_distinct(F.array("name", F.substring_index("name", ".", -1)))).alias("signal")).distinct()
    used = named.join(known, "signal").select(*key, "name").distinct()
    out = clauses.select(*key)
    for rows, column, name in ((tags, "tag_id", "tags"), (found, "dimension_id", "dimension_ids"), (used, "name", "interfaces")):
        listed = rows.groupBy(*key).agg(F.array_sort(F.collect_set(column)).alias(name))
        out = out.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out
