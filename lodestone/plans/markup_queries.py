"""Markdown and source code over the driver's tables: sections, clauses, atoms, places, masks, brackets and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..markdown import annotations as A
from ..markdown import blocks as B
from ..markdown import clauses as C
from ..markdown import sections as S
from ..operators import positions as P
from ..session import rows_of, table


def _conversations(spark, sf_dir):
    """Each conversation as Markdown: a turn is a heading, whose level goes by its role, and a paragraph."""
    c = table(spark, sf_dir, "conversations")
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(4)
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\p{Z}]+", " "))
    turn = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.coalesce("role", F.lit("")), F.lit(" "), F.col("turn").cast("string"), F.lit("\n\nText "), flat, F.lit("\n"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("md")))), lambda t: t["md"]), "\n").alias("md"))


def markdown_sections(spark, sf_dir):
    """The section tree of each conversation as Markdown; user turns without a system turn and assistant turns skip levels."""
    s = S.sections(B.blocks(_conversations(spark, sf_dir), "conv_id", "md"))
    return s.select(F.col("id").alias("conv_id"), "section", "title", "level", F.concat_ws(" / ", "heading_path").alias("path"), "parent", "start_line", "content_end", "subtree_end", "skipped")


_SECTIONS_SQL = """
    WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS section, role || ' ' || turn AS title,
            CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 4 END AS level, 4 * count(*) OVER (PARTITION BY conv_id) - 1 AS last_line FROM conversations),
    p AS (SELECT a.*, max(b.section) AS parent FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.section < a.section AND b.level < a.level GROUP BY ALL),
    n AS (SELECT a.conv_id, a.section, min(b.section) AS stop FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.section > a.section AND b.level <= a.level GROUP BY ALL),
    path(conv_id, section, up, path) AS (SELECT conv_id, section, parent, title FROM p
        UNION ALL SELECT path.conv_id, path.section, p.parent, p.title || ' / ' || path.path FROM path JOIN p ON p.conv_id = path.conv_id AND p.section = path.up)
    SELECT p.conv_id, CAST(p.section AS INT) AS section, p.title, p.level, path.path, CAST(p.parent AS INT) AS parent, CAST(4 * p.section + 1 AS INT) AS start_line,
           CAST(CASE WHEN 4 * p.section + 4 > p.last_line THEN p.last_line ELSE 4 * p.section + 4 END AS INT) AS content_end, CAST(coalesce(4 * n.stop, p.last_line) AS INT) AS subtree_end,
           coalesce(p.level > u.level + 1, false) AS skipped
    FROM p JOIN path ON path.conv_id = p.conv_id AND path.section = p.section AND path.up IS NULL LEFT JOIN n ON n.conv_id = p.conv_id AND n.section = p.section
    LEFT JOIN p u ON u.conv_id = p.conv_id AND u.section = p.parent
"""


def guidance_passages(spark, sf_dir):
    """What users say in each conversation, as passages: their turns are allowed sections, those of assistants aren't."""
    role = F.regexp_replace("flat", " [0-9]+$", "")
    p = S.passages(B.blocks(_conversations(spark, sf_dir), "conv_id", "md"), ["user"], ["assistant"], role)
    return p.select(F.col("id").alias("conv_id"), "passage", F.sha2("text", 256).alias("text_sha256"), F.array_join("heading_path", " / ").alias("path"), "start_line", "end_line")


_PASSAGES_SQL = r"""
    WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, 'Text ' || trim(regexp_replace(coalesce(text, ''), '[\s\pZ]+', ' ', 'g')) AS flat FROM conversations),
    s AS (SELECT *, last_value(CASE WHEN role = 'system' THEN role || ' ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS title FROM t)
    SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) AS INT) AS passage, sha256(trim(flat)) AS text_sha256, concat_ws(' / ', title, 'user', 'user ' || turn) AS path, CAST(4 * i + 3 AS INT) AS start_line, CAST(4 * i + 3 AS INT) AS end_line
    FROM s WHERE role = 'user'
"""


def _clauses(spark, sf_dir):
    """Clauses of each document as Markdown: its lines in turn are a rule, a note to it, the introduction of a list and an item of that list."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " ")) != "").alias("l"))
    flat = lambda x: F.trim(F.regexp_replace(x, r"[\s\p{Z}]+", " "))
    forms = lambda x, i: F.concat(F.when(i % 4 == 0, "It must hold: ").when(i % 4 == 1, "> Note: ").when(i % 4 == 2, "So ").otherwise("- one should "), flat(x), F.when(i % 4 == 2, ":").otherwise("."))
    md = F.concat(F.lit("# Source "), F.coalesce("source", F.lit("")), F.lit("\n\n"), F.array_join(F.transform("l", forms), "\n\n"))
    return C.clauses(C.read_clauses(B.blocks(d.select("doc_id", md.alias("md")), "doc_id", "md")))


def markdown_clauses(spark, sf_dir):
    """Clauses of those documents: their types, ids, notes, contexts, lines and neighbours."""
    return _clauses(spark, sf_dir).select(
        F.col("id").alias("doc_id"), "clause", "rule_id", "rule_type", F.sha2("text", 256).alias("text_sha256"), F.length("notes").alias("note_length"), F.sha2(F.coalesce("parent_context", F.lit("")), 256).alias("context_sha256"),
        "start_line", "end_line", "previous", "next",
    )


_CLAUSES_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[\s\pZ]+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
    k AS (SELECT doc_id, source, l, unnest(range(0, len(l))) AS i FROM d),
    c AS (SELECT doc_id, source, i, 3 + 2 * i AS start_line,
            CASE WHEN i % 4 = 0 THEN 'It must hold: ' || l[i + 1] || '.' ELSE 'one should ' || l[i + 1] || '.' END AS own,
            CASE WHEN i % 4 = 0 AND i + 2 <= len(l) THEN l[i + 2] || '.' ELSE '' END AS note, CASE WHEN i % 4 = 3 THEN 'So ' || l[i] || ':' ELSE '' END AS context
          FROM k WHERE i % 4 IN (0, 3)),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS clause, count(*) OVER (PARTITION BY doc_id) AS every,
            CASE WHEN regexp_matches(lower('Source ' || source || ' ' || own), 'deprecated|废弃|弃用|不再维护') THEN 'deprecation' ELSE 'constraint' END AS rule_type,
            replace(upper(regexp_extract(CASE WHEN i % 4 = 3 THEN own ELSE 'Source ' || source END, '(?i)(?:^|[^A-Za-z0-9])((?:AC|ADR|BR|ER|FR|RC|US|VM|R)[-_][A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*)', 1)), '_', '-') AS native
          FROM c),
    r AS (SELECT *, CASE WHEN native <> '' THEN native ELSE 'Source ' || source || ':' || CASE WHEN clause < 10 THEN '0' ELSE '' END || clause END AS base FROM n)
    SELECT doc_id, CAST(clause AS INT) AS clause, CASE WHEN count(*) OVER (PARTITION BY doc_id, base) > 1 THEN base || '@L' || start_line || '-L' || (start_line + CASE WHEN note <> '' THEN 2 ELSE 0 END) ELSE base END AS rule_id, rule_type,
           sha256(own || note) AS text_sha256, CAST(length(note) AS INT) AS note_length, sha256(context) AS context_sha256, CAST(start_line AS INT) AS start_line, CAST(start_line + CASE WHEN note <> '' THEN 2 ELSE 0 END AS INT) AS end_line,
           CAST(CASE WHEN clause > 1 THEN clause - 1 END AS INT) AS previous, CAST(CASE WHEN clause < every THEN clause + 1 END AS INT) AS next
    FROM r
"""


_KEYWORDS = [("Note", "noted"), ("should", "advice"), ("must hold", "duty"), ("copyright", "legal"), ("licensed under", "legal"), ("@", "contact")]
_DIMENSIONS = [("force", "duty", "Active"), ("force", "advice", "Draft"), ("law", "legal", "Active"), ("gone", "contact", "Deprecated")]


def clause_topics(spark, sf_dir):
    """Tags and dimensions of the clauses of each document, by keywords in their text, context and headings."""
    found = A.annotate(_clauses(spark, sf_dir), rows_of(spark, _KEYWORDS, "keyword string, tag_id string"), rows_of(spark, [("ui.load",), ("save",)], "name string"), rows_of(spark, _DIMENSIONS, "dimension_id string, tag_id string, status string"))
    return found.select(F.col("id").alias("doc_id"), "clause", *(F.array_join(c, ",").alias(c) for c in ("tags", "dimension_ids", "interfaces")))


_TOPICS_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[\s\pZ]+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
    k AS (SELECT doc_id, source, l, unnest(range(0, len(l))) AS i FROM d),
    c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS clause,
            CASE WHEN i % 4 = 0 THEN 'It must hold: ' || l[i + 1] || '.' || CASE WHEN i + 2 <= len(l) THEN l[i + 2] || '.' ELSE '' END ELSE 'one should ' || l[i + 1] || '.' END AS text,
            lower('Source ' || source || chr(10) || CASE WHEN i % 4 = 0 THEN 'It must hold: ' || l[i + 1] || '.' || CASE WHEN i + 2 <= len(l) THEN l[i + 2] || '.' ELSE '' END ELSE 'one should ' || l[i + 1] || '.' || chr(10) || 'So ' || l[i] || ':' END) AS t
          FROM k WHERE i % 4 IN (0, 3))
    SELECT doc_id, CAST(clause AS INT) AS clause,
           concat_ws(',', CASE WHEN contains(t, 'should') THEN 'advice' END, CASE WHEN contains(t, '@') THEN 'contact' END, CASE WHEN contains(t, 'must hold') THEN 'duty' END, CASE WHEN contains(t, 'copyright') OR contains(t, 'licensed under') THEN 'legal' END, CASE WHEN contains(t, 'note') THEN 'noted' END) AS tags,
           concat_ws(',', CASE WHEN contains(t, 'should') OR contains(t, 'must hold') THEN 'force' END, CASE WHEN contains(t, 'copyright') OR contains(t, 'licensed under') THEN 'law' END) AS dimension_ids,
           concat_ws(',', CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_$.])([A-Za-z0-9_$.]*[.])?save\s*\(|@save($|[^A-Za-z0-9_])|`([^`]*[.])?save`') THEN 'save' END,
                          CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_$.])([A-Za-z0-9_$.]*[.])?load\s*\(|@load($|[^A-Za-z0-9_])|`(ui[.])?load`') THEN 'ui.load' END) AS interfaces FROM c
"""


def source_atoms(spark, sf_dir):
    """Documents, turns and pages read as Markdown: their atoms and regions put together are the source, and cover each line once."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    a = S.atoms(B.blocks(d.unionByName(c).unionByName(p).where("text <> ''"), "id", "text"))
    parts = F.array_sort(F.collect_list(F.struct("unit", "source")))
    whole = a.groupBy("id").agg(F.array_join(F.transform(parts, lambda u: u["source"]), "").alias("source"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("n_lines"), F.sum(F.when(F.col("kind") == "blank", F.col("end_line") - F.col("start_line") + 1).otherwise(0)).alias("n_blank"))
    return whole.select("id", F.sha2("source", 256).alias("source_sha256"), "n_lines", "n_blank")


_ATOMS_SQL = r"""
    WITH s AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations UNION ALL SELECT 'p' || page_id, html FROM pages),
    l AS (SELECT id, text, CASE WHEN text LIKE '%' || chr(10) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END AS l FROM s WHERE text <> '')
    SELECT id, sha256(text) AS source_sha256, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(l, lambda x: NOT regexp_matches(x, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\pZ]'))) AS BIGINT) AS n_blank FROM l
"""


def position_maps(spark, sf_dir):
    """Ten places in each document, asked in code points, and looked up again from their UTF-8 and UTF-16 offsets."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    asked = d.select("id", F.lit("point").alias("unit"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.floor(F.length(F.coalesce("text", F.lit(""))) * k / 10))).alias("at"))
    first = P.positions(d, asked)
    again = first.select("id", F.explode(F.array(F.struct(F.lit("utf16").alias("unit"), F.col("utf16").alias("at")), F.struct(F.lit("utf8").alias("unit"), F.col("utf8").alias("at")))).alias("p")).select("id", "p.unit", "p.at")
    return first.unionByName(P.positions(d, again)).withColumnRenamed("id", "doc_id").withColumnRenamed("at", "place").withColumnRenamed("column", "col")


_POSITIONS_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
    p AS (SELECT DISTINCT doc_id, text, CAST(floor(length(text) * k / 10) AS BIGINT) AS point FROM (SELECT doc_id, text, unnest(range(0, 11)) AS k FROM d)),
    h AS (SELECT doc_id, point, left(text, point) AS h FROM p),
    v AS (SELECT doc_id, point, CAST(length(h) + length(regexp_replace(h, '[\x{0}-\x{FFFF}]', '', 'g')) AS BIGINT) AS utf16, CAST(strlen(h) AS BIGINT) AS utf8,
                 CAST(length(h) - length(replace(h, chr(10), '')) + 1 AS BIGINT) AS line, CAST(length(list_last(string_split(h, chr(10)))) + 1 AS BIGINT) AS col FROM h)
    SELECT doc_id, 'point' AS unit, point AS place, point, utf16, utf8, line, col FROM v
    UNION ALL SELECT doc_id, 'utf16', utf16, point, utf16, utf8, line, col FROM v UNION ALL SELECT doc_id, 'utf8', utf8, point, utf16, utf8, line, col FROM v
"""

QUERIES = {f.__name__: f for f in (markdown_sections, guidance_passages, markdown_clauses, clause_topics, source_atoms, position_maps)}
ORACLES = {"markdown_sections": _SECTIONS_SQL, "guidance_passages": _PASSAGES_SQL, "markdown_clauses": _CLAUSES_SQL, "clause_topics": _TOPICS_SQL, "source_atoms": _ATOMS_SQL, "position_maps": _POSITIONS_SQL}
