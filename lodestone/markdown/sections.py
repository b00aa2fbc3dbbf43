"""Sections and atoms of Markdown documents, by windows over their blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = range(1, 7)
#: Units that hold no content of their own.
REGIONS = {"heading": "heading", "break": "thematic_break", "comment": "html_comment", "blank": "blank", "front_matter": "front_matter"}
ATOMS = {"item": "list_item", "fence": "code_block", "code": "code_block", "html": "raw_block"}


def sections(blocks: DataFrame) -> DataFrame:
    """The section tree of each document, one row a section.

    (id, section from 0, kind, title, level, heading_path, parent, start_line, content_end,
    subtree_end, skipped).  A heading outside quotes with a title opens a section; its
    parent is the last heading before it of a smaller level, whatever levels are skipped
    (``skipped`` says so).  Text before the first heading is a preamble, and a document
    without headings is one document_body.  Each level's last heading is a running
    value of one window, so a document's headings need no stack.
    """
    lines = blocks.groupBy("id").agg(
        F.max("end_line").alias("last_line"), F.min(F.when(_opens(), F.col("start_line"))).alias("first_heading"),
        F.min(F.when(F.col("kind") != "blank", F.col("start_line"))).alias("first_text"),
    )
    before = Window.partitionBy("id").orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("id").orderBy("start_line").rowsBetween(1, Window.unboundedFollowing)
    level = F.col("level")
    heads = blocks.where(_opens()).select("id", "start_line", "level", F.regexp_replace(F.trim("text"), r"\s+", " ").alias("title"))
    found = heads.select(
        "*", F.array(*(F.last(F.when(level == k, F.struct(F.col("start_line").alias("line"), "level", "title")), ignorenulls=True).over(before) for k in LEVELS)).alias("last"),
        F.first("start_line").over(after).alias("next"),
        F.array(*(F.first(F.when(level <= k, F.col("start_line")), ignorenulls=True).over(after) for k in LEVELS)).alias("closing"),
    )
    # On the path: last headings of smaller levels, with none of a still smaller level after them.
    above = F.filter("last", lambda h: h.isNotNull() & (h["level"] < level))
    above = F.filter(above, lambda h: ~F.exists(above, lambda g: (g["level"] < h["level"]) & (g["line"] > h["line"])))
    found = found.withColumn("above", above).join(lines, "id")
    up = F.try_element_at("above", F.lit(-1))
    heads = found.select(
        "id", F.lit("heading").alias("kind"), "title", "level", F.concat(F.transform("above", lambda h: h["title"]), F.array("title")).alias("heading_path"), up["line"].alias("parent_line"),
        "start_line", F.coalesce(F.col("next") - 1, "last_line").alias("content_end"), F.coalesce(F.element_at("closing", level) - 1, "last_line").alias("subtree_end"),
        F.coalesce(level > up["level"] + 1, F.lit(False)).alias("skipped"),
    )
    end = F.coalesce(F.col("first_heading") - 1, "last_line")
    rest = lines.where("first_heading is null or first_text < first_heading").select(
        "id", F.when(F.col("first_heading").isNull(), "document_body").otherwise("preamble").alias("kind"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("level"),
        F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("int").alias("parent_line"), F.lit(1).alias("start_line"), end.alias("content_end"), end.alias("subtree_end"), F.lit(False).alias("skipped"),
    )
    every = heads.unionByName(rest).withColumn("section", F.row_number().over(Window.partitionBy("id").orderBy("start_line")) - 1)
    parents = every.select("id", F.col("start_line").alias("parent_line"), F.col("section").alias("parent")).alias("p")
    e = every.alias("e")
    joined = e.join(parents, F.col("e.id").eqNullSafe(F.col("p.id")) & (F.col("e.parent_line") == F.col("p.parent_line")), "left")
    return joined.select("e.id", "e.section", "kind", "title", "level", "heading_path", "p.parent", "start_line", "content_end", "subtree_end", "skipped")


def _opens() -> F.Column:
    return (F.col("kind") == "heading") & ~F.col("quoted") & (F.trim("text") != "")


def atoms(blocks: DataFrame) -> DataFrame:
    """The units of each document as atoms and regions, in order; their sources put together are the document.

    (id, unit from 0, eligible, kind, section, start_line, end_line, source).  Atoms
    (eligible) are paragraph, list_item, table, code_block, blockquote, note and
    raw_block and belong to the section above them; regions are headings, blank
    lines, rules, comments and front matter.  A quote whose first line is a marker
    like ``[!NOTE]`` or begins with ``Note:`` is a note.
    """
    note = F.col("source").rlike(r"(?i)^ {0,3}> ?(?:\[!\w+\]|\**(?:note|注意|说明|备注)\**\s*[:：])")
    kind = F.when(F.col("kind") == "quote", F.when(note, "note").otherwise("blockquote"))
    for name, renamed in (REGIONS | ATOMS).items():
        kind = kind.when(F.col("kind") == name, renamed)
    order = Window.partitionBy("id").orderBy("ordinal")
    starts = F.when(_opens(), F.col("start_line"))
    opened = F.count(starts).over(order)  # headings so far; a preamble comes before them
    text = ~F.col("kind").isin(*REGIONS)
    rows = blocks.select("id", "ordinal", kind.otherwise(F.col("kind")).alias("kind"), "unit", text.alias("eligible"), opened.alias("opened"), "start_line", "end_line", "source")
    early = F.max((F.col("opened") == 0) & (F.col("kind") != "blank")).over(Window.partitionBy("id"))
    rows = rows.withColumn("preamble", early.cast("int"))
    section = F.when(F.col("eligible"), F.col("opened") - 1 + F.col("preamble"))
    units = rows.where("unit").withColumn("number", F.row_number().over(order) - 1)
    return units.select("id", F.col("number").alias("unit"), "eligible", "kind", section.cast("int").alias("section"), "start_line", "end_line", "source")


def passages(blocks: DataFrame, allowed: list[str], excluded: list[str], name: F.Column | None = None, noise: str = r"^!\[[^\]]*\]\([^)]*\)$|^$") -> DataFrame:
    """(id, passage from 1, text, heading_path, start_line, end_line) of the paragraphs in allowed sections.

    A section begins where a heading below level 1, or a paragraph of nothing else, has an
    ``allowed`` name, and ends at an ``excluded`` one or a heading of level 1; other headings go on
    with it.  ``name`` (of ``flat``, the title with white space collapsed) is compared in
    lower case.  Paragraphs that match ``noise`` (an image alone) are left out.  heading_path
    is the title of the document (its last heading of level 1), the section and the
    heading below it, each once.
    """
    order = Window.partitionBy("id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.where(F.col("kind").isin("heading", "paragraph")).withColumn("flat", F.trim(F.regexp_replace("text", r"[\s\p{Z}]+", " ")))
    b = b.withColumn("name", F.lower(F.trim(F.regexp_replace(F.col("flat") if name is None else name, r"[：:*_]+$|^[*_]+", ""))))
    head, top = F.col("kind") == "heading", (F.col("kind") == "heading") & (F.col("level") == 1)
    begins = ~top & F.col("name").isin(*(a.lower() for a in allowed))
    stops = ~top & F.col("name").isin(*(e.lower() for e in excluded))
    last = lambda when, value: F.last(F.when(when, value), ignorenulls=True).over(order)
    b = b.select(
        "id", "ordinal", "flat", "start_line", "end_line", last(top, F.col("flat")).alias("title"), last(top | begins | stops, F.struct(F.when(begins, F.col("name")).alias("name")))["name"].alias("section"),
        last((head & ~top) | begins | stops, F.col("flat")).alias("current"), (~head & ~begins & ~stops).alias("plain"),
    )
    found = b.where("plain and section is not null").where(~F.col("flat").rlike(noise))
    path = F.array_distinct(F.filter(F.array("title", "section", "current"), lambda x: x.isNotNull()))
    return found.select("id", F.row_number().over(Window.partitionBy("id").orderBy("ordinal")).alias("passage"), F.col("flat").alias("text"), path.alias("heading_path"), "start_line", "end_line")
