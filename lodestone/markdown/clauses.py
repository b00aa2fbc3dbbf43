"""Normative clauses of Markdown documents: text with a rule type, its place, context, examples and notes.

What a clause depends on is the nearest earlier event of some kind (the heading
above, the line that introduces a list, the label before an example), so it is a
running value of a window over a document's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph

# Fixed values of the clause rules.
CUES = {
    "deprecation": ["deprecated", "废弃", "弃用", "不再维护"],
    "constraint": ["不得", "不能", "不应", "不允许", "不可", "必须", "务必", "需要", "应当", "应在", "应申请", " 应", "，应", "。应", "只允许", "只能", "禁止", "严禁", "must ", "must not", "should ", "should not", "required"],
    "guidance": ["建议", "推荐", "优先", "适合", "可以使用", "recommend", "prefer"],
    "behavior": ["默认", "返回", "触发", "生效", "支持", "调用", "发生", "进行校验", "产生告警", "will ", "returns ", "default"],
}
HEADING_CUES = ["不得", "不应", "不允许", "不可", "必须", "只能", "只允许", "禁止", "严禁", "must ", "must not", "should not"]
HEADING_LENGTH = 8
NATIVE_ID = r"(?i)(?<![A-Za-z0-9])((?:AC|ADR|BR|ER|FR|RC|US|VM|R)[-_][A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*)"
API_LEVELS = [r"(?i)API\s*(?:version\s*)?(\d+)\s*(?:起|开始|及以上|以上)", r"(?i)API\s*(?:version\s*)?(?:>=|≥)\s*(\d+)"]
NOTE_PREFIX = r"(?i)^(?:注意|说明|备注|Note)\s*[：:]\s*"
EXAMPLE_LABEL = r"(?i)^(?:\*{0,2}|【)(正例|正确示例|反例|错误示例|示例\d*)(?:\s*[：:]?\*{0,2}|】)"
EXAMPLE_KINDS = {"正例": "positive", "正确示例": "positive", "反例": "negative", "错误示例": "negative"}
METADATA_LABEL = r"(?i)^(?:参数|返回值|系统能力|起始版本|版本说明|返回类型|属性|方法)\s*[：:]$"
ACCEPTANCE_HEADS, ACCEPTANCE_ENDING = ["ACID", "AC编号"], "标准"
RULE_HEADS, RULE_COLUMNS, RULE_PARTS, RULE_TYPE = ["RULEID", "规则ID"], ["预期行为", "边界/约束"], ["触发条件", "预期行为", "边界/约束"], "类型"
NORMATIVE_HEADS = ["标准", "要求", "约束", "规则", "预期行为"]
#: Lines that a note or an unlabelled example may be below its clause, and a label.
NEAR, LABEL_NEAR = 2, 3


def _has(text: Column, cues: list[str]) -> Column:
    """Whether the text, in lower case, holds one of the cues (none of which has a sign of a pattern)."""
    return F.lower(text).rlike("|".join(cues))


def classify(text: Column, path: Column) -> Column:
    """The rule type by the first list of cues that the text holds; deprecation also looks at the headings."""
    kind = F.when(_has(F.concat_ws(" ", path, text), CUES["deprecation"]), "deprecation")
    for name in ("constraint", "guidance", "behavior"):
        kind = kind.when(_has(text, CUES[name]), name)
    return F.when(~metadata_label(text), kind)


def metadata_label(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.trim(text), r"^[*_`]+|[*_`]+$", ""))
    return plain.rlike(METADATA_LABEL)


def example_kind(text: Column) -> Column:
    label = F.regexp_extract(text, EXAMPLE_LABEL, 1)
    kind = F.lit("neutral")
    for name, value in EXAMPLE_KINDS.items():
        kind = F.when(label == name, value).otherwise(kind)
    return F.when(label != "", kind)


def native_id(text: Column) -> Column:
    found = F.regexp_extract(text, NATIVE_ID, 1)
    return F.when(found != "", F.translate(F.upper(found), "_", "-"))


def api_level(text: Column) -> Column:
    """The one API level that the text states, null for none or several."""
    levels = F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in API_LEVELS)))
    levels = F.array_distinct(F.transform(levels, lambda x: F.try_to_number(x, F.lit("999999999")).cast("int")))
    return F.when(F.size(levels) == 1, levels[0])


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def annotated(blocks: DataFrame, folder: str) -> DataFrame:
    """Blocks with the events that clauses, notes, labels and examples depend on."""
    order = Window.partitionBy("id").orderBy("ordinal")
    earlier, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda when, value, over: F.last(F.when(when, value), ignorenulls=True).over(over)
    is_, in_list = (lambda *kinds: F.col("kind").isin(*kinds)), F.size("items") > 0

    b = blocks.where(is_("heading", "paragraph", "list", "table", "row", "fence", "item")).withColumn("flat", F.when(is_("heading", "paragraph"), _flat(F.col("text"))).otherwise(""))
    colon = F.col("flat").rlike("[：:]$")
    b = b.select(
        "id", "ordinal", "parent", "kind", "level", "start_line", "end_line", "quoted", "items", "path", "cells", "flat", F.when(is_("fence"), F.col("text")).alias("text"),
        (~in_list & is_("heading", "paragraph", "list", "table", "fence")).alias("stream"), F.when(is_("paragraph"), example_kind(F.col("flat"))).alias("label"), colon.alias("colon"),
        F.when(is_("paragraph"), metadata_label(F.col("flat"))).alias("meta_label"), F.when(is_("paragraph") & ~colon, classify(F.col("flat"), F.col("path"))).alias("cued"),
        native_id(F.try_element_at("path", F.lit(-1))).alias("heading_id"), (is_("heading") & (F.length("flat") >= HEADING_LENGTH) & _has(F.col("flat"), HEADING_CUES)).alias("normative"),
    )
    b = graph.written(b, f"{folder}/events")  # else every window would compute the patterns anew
    b = b.withColumn("is_label", F.col("stream") & F.col("label").isNotNull())
    b = b.withColumn("is_meta", F.col("stream") & is_("paragraph") & F.col("label").isNull() & F.col("meta_label"))
    b = b.withColumn("in_meta", F.coalesce(last(F.col("is_meta") | F.col("is_label") | (F.col("stream") & is_("heading")), F.col("is_meta"), earlier), F.lit(False)))

    ordinary = F.col("stream") & is_("paragraph") & F.col("label").isNull() & ~F.col("is_meta") & ~F.col("in_meta")
    b = b.withColumn("is_note", ordinary & F.col("quoted")).withColumn("is_plain", ordinary & ~F.col("quoted"))
    b = b.withColumn("plain_type", F.when(F.col("is_plain"), F.coalesce("cued", F.when(F.col("heading_id").isNotNull(), "behavior"))))
    b = b.withColumn("norm_heading", F.col("stream") & F.col("normative"))
    b = b.withColumn("in_use", F.col("stream") & is_("list", "table") & ~F.col("in_meta"))
    b = b.withColumn("resets", (F.col("stream") & is_("heading")) | F.col("in_use") | F.col("is_meta") | F.col("plain_type").isNotNull())

    # The line that introduces a list, and whether the list or table that a row is in counts.
    sets = (F.col("stream") & is_("heading")) | F.col("in_use") | F.col("is_meta") | F.col("is_plain")
    b = b.withColumn("intro", last(sets, F.struct(F.when(F.col("plain_type").isNull() & F.col("is_plain") & F.col("colon"), F.col("flat")).alias("text")), earlier)["text"])
    b = b.withColumn("outer", last(F.col("stream") & is_("list", "table"), F.struct("in_use", "intro"), so_far))
    b = b.withColumn("header", last(is_("row") & (F.col("level") == 0), F.col("cells"), so_far))
    b = b.withColumn("direct", is_("paragraph") & in_list & F.coalesce(F.col("parent") == F.try_element_at("items", F.lit(-1)), F.lit(False)))
    # What windows carry to every row goes on only with those that use it.
    return b.select(
        "id", "ordinal", "kind", "level", "start_line", "end_line", "items", "path", "cells", F.when(is_("row"), F.col("header")).alias("header"), "flat", "text", "stream", "label", "cued", "heading_id", "norm_heading",
        "resets", "is_label", "is_note", "plain_type", "in_meta", "direct", F.col("outer.in_use").alias("outer_used"), F.when(F.col("direct"), F.col("outer.intro")).alias("intro"),
    )


def _list_contexts(b: DataFrame) -> DataFrame:
    """(id, ordinal, context): the nearest outer item's first line, for direct paragraphs of nested items."""
    leads = b.where("direct and label is null").groupBy("id", F.try_element_at("items", F.lit(-1)).alias("item")).agg(F.min(F.struct("ordinal", "flat")).alias("lead"))
    inner = b.where("direct and size(items) > 1").select("id", "ordinal", F.posexplode(F.expr("slice(items, 1, size(items) - 1)")).alias("depth", "item"), F.try_element_at("items", F.lit(-1)).alias("own"))
    i, x = inner.alias("i"), leads.alias("x")
    met = i.join(x, F.col("i.id").eqNullSafe(F.col("x.id")) & (F.col("i.item") == F.col("x.item"))).where("x.lead.ordinal < i.own")
    return met.groupBy("i.id", "i.ordinal").agg(F.max_by("x.lead.flat", "i.depth").alias("context"))


def _drafts(b: DataFrame) -> DataFrame:
    """``b`` with ``draft`` (type, text, native_id, context) where a row is a clause."""
    c, nested = _list_contexts(b).alias("c"), b.where("direct and size(items) > 1").alias("b")
    nested = nested.join(c, F.col("b.id").eqNullSafe(F.col("c.id")) & (F.col("b.ordinal") == F.col("c.ordinal")), "left").select("b.*", "c.context")
    b = b.where("not (direct and size(items) > 1)").withColumn("context", F.lit(None).cast("string")).unionByName(nested)
    cells, header = F.col("cells"), F.col("header")
    head = lambda k: F.coalesce(F.get(header, F.lit(k)), F.lit(""))
    key = F.upper(F.replace(head(0), F.lit(" "), F.lit("")))
    body = (F.col("kind") == "row") & (F.col("level") > 0) & F.col("outer_used") & (F.size("items") == 0)
    acceptance = body & (F.size(header) >= 2) & key.isin(*ACCEPTANCE_HEADS) & F.endswith(head(1), F.lit(ACCEPTANCE_ENDING))
    rule = body & (F.size(header) >= 5) & key.isin(*RULE_HEADS) & F.array_contains(header, RULE_COLUMNS[0]) & F.array_contains(header, RULE_COLUMNS[1]) & ~acceptance
    cell = lambda name: F.get(cells, (F.array_position(header, name) - 1).cast("int"))
    stated = lambda name: F.when(~F.coalesce(cell(name), F.lit("")).isin("", "—", "-"), F.concat(F.lit(f"{name}："), cell(name)))
    rule_text = F.concat_ws("；", *(stated(n) for n in RULE_PARTS))
    declared = F.coalesce(cell(RULE_TYPE), F.lit(""))
    declared = F.when(F.contains(declared, F.lit("约束")), "constraint").when(F.contains(declared, F.lit("指导")) | F.contains(declared, F.lit("建议")), "guidance")
    cell_id = native_id(F.get(cells, F.lit(0)))
    of = lambda kind, text, native, context: F.struct(kind.alias("rule_type"), text.alias("text"), native.alias("native_id"), context.alias("context"))
    nothing = F.lit(None).cast("string")
    draft = (
        F.when(F.col("norm_heading"), of(F.lit("constraint"), F.col("flat"), native_id(F.col("flat")), nothing))
        .when(F.col("plain_type").isNotNull(), of(F.col("plain_type"), F.col("flat"), F.col("heading_id"), nothing))
        .when(F.col("direct") & F.col("label").isNull() & F.col("cued").isNotNull() & F.col("outer_used"), of(F.col("cued"), F.col("flat"), native_id(F.col("flat")), F.coalesce("context", "intro")))
        .when(acceptance & cell_id.isNotNull() & (F.coalesce(F.get(cells, F.lit(1)), F.lit("")) != ""), of(F.coalesce(classify(F.get(cells, F.lit(1)), F.col("path")), F.lit("behavior")), F.get(cells, F.lit(1)), cell_id, head(1)))
        .when(rule & cell_id.isNotNull() & (rule_text != ""), of(F.coalesce(declared, classify(rule_text, F.col("path")), F.lit("behavior")), rule_text, cell_id, F.lit("规则定义")))
    )
    unsupported = body & ~acceptance & ~rule & F.exists(header, lambda h: F.lit(False) | _any(h, NORMATIVE_HEADS))
    return b.withColumn("draft", draft).withColumn("bad_row", (acceptance | rule) & F.col("draft").isNull()).withColumn("odd_table", unsupported)


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _attached(b: DataFrame) -> DataFrame:
    """(id, ordinal, start_line, end_line, of, flat, text, is_attached, example, issue) of notes, labels, fences and rows that belong to a clause (``of``, its ordinal) or have an issue.

    The texts of clauses stay out of the windows: no clause is attached to another or has an issue.
    """
    order = Window.partitionBy("id").orderBy("ordinal")
    earlier, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    b = b.select(
        "id", "ordinal", "kind", "start_line", "end_line", "path", "items", "text", "stream", "label", "norm_heading", "resets", "is_label", "is_note", "in_meta", "direct", "outer_used", "bad_row", "odd_table",
        F.when(F.col("is_note"), F.col("flat")).alias("flat"), F.col("draft").isNotNull().alias("is_draft"),
    )
    is_draft = F.col("is_draft")
    b = b.withColumn("prior", F.last(F.when(is_draft, F.struct("ordinal", "end_line", "path", "items")), ignorenulls=True).over(earlier))
    b = b.withColumn("run", F.sum(F.col("resets").cast("int")).over(so_far)).withColumn("by_heading", F.coalesce(F.last(F.when(F.col("resets"), F.col("norm_heading")), ignorenulls=True).over(so_far), F.lit(False)))
    same_path = F.coalesce(F.col("prior.path") == F.col("path"), F.lit(False))
    # Notes go on from their clause, or from the note before, as long as none is too far away.
    clause = Window.partitionBy("id", "prior.ordinal").orderBy("ordinal")
    noted = F.last(F.when(F.col("is_note"), F.col("end_line")), ignorenulls=True).over(clause.rowsBetween(Window.unboundedPreceding, -1))
    far = F.col("is_note") & (~same_path | (F.col("start_line") > F.coalesce(noted, "prior.end_line") + NEAR))
    b = b.withColumn("far", far)
    b = b.withColumn("is_attached", F.col("is_note") & F.col("prior").isNotNull() & (F.sum(F.col("far").cast("int")).over(clause.rowsBetween(Window.unboundedPreceding, 0)) == 0))
    reach = F.coalesce(F.max(F.when(F.col("is_attached"), F.col("end_line"))).over(clause.rowsBetween(Window.unboundedPreceding, -1)), F.col("prior.end_line"))
    b = b.withColumn("reach", reach)
    # A label belongs to the clause above; those that follow it, before anything else counts, to the same one.
    good = F.col("prior").isNotNull() & same_path & (F.col("by_heading") | (F.col("start_line") <= F.col("reach") + LABEL_NEAR))
    b = b.withColumn("good", F.when(F.col("is_label"), good))
    b = b.withColumn("good", F.when(F.col("is_label"), F.first("good", ignorenulls=True).over(Window.partitionBy("id", "run").orderBy("ordinal"))))
    stream_fence = F.col("stream") & (F.col("kind") == "fence")
    pending = F.last(F.when(F.col("is_label") | stream_fence | F.col("resets"), F.struct(F.when(F.col("good"), F.col("label")).alias("kind"))), ignorenulls=True).over(earlier)["kind"]
    near = F.col("start_line") <= F.col("reach") + NEAR
    b = b.withColumn("stream_kind", F.when(stream_fence & F.col("prior").isNotNull() & same_path & (pending.isNotNull() | near), F.coalesce(pending, F.lit("neutral"))))
    # Within an item: its own last clause, or one of its nested items.
    own = F.try_element_at("items", F.lit(-1))
    inside = F.coalesce(F.array_contains(F.col("prior.items"), own), F.lit(False))
    item = Window.partitionBy("id", own).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("inside", inside & (F.size("items") > 0))
    listed = F.last(F.when((F.col("direct") & is_draft) | (F.col("label").isNotNull() & F.col("inside")), F.struct(F.when(~is_draft, F.col("label")).alias("kind"))), ignorenulls=True).over(item)["kind"]
    item_fence = (F.size("items") > 0) & (F.col("kind") == "fence") & F.col("outer_used")
    b = b.withColumn("item_kind", F.when(item_fence & F.col("inside") & (listed.isNotNull() | (F.col("start_line") <= F.col("prior.end_line") + NEAR)), F.coalesce(listed, F.lit("neutral"))))
    lost = [
        F.when(F.col("is_label") & ~F.col("good"), "orphan_example_label"), F.when((F.size("items") > 0) & F.col("label").isNotNull() & ~F.col("inside") & F.col("outer_used"), "orphan_example_label"),
        F.when((stream_fence & F.col("stream_kind").isNull()) | (item_fence & F.col("item_kind").isNull()), "orphan_code_example"), F.when(F.col("is_note") & ~F.col("is_attached"), "orphan_normative_note"),
        F.when(F.col("stream") & F.col("in_meta") & F.col("kind").isin("list", "table"), F.concat(F.lit("skipped_metadata_"), F.col("kind"))),
        F.when(F.col("bad_row"), "invalid_acceptance_row"), F.when(F.col("odd_table"), "unsupported_normative_table"),
    ]
    b = b.select("id", "ordinal", "start_line", "end_line", F.col("prior.ordinal").alias("of"), "flat", "text", "is_attached", F.coalesce("stream_kind", "item_kind").alias("example"), F.coalesce(*lost).alias("issue"))
    return b.where("is_attached or example is not null or issue is not null")


def read_clauses(blocks: DataFrame) -> DataFrame:
    """All that ``clauses`` and ``diagnostics`` need: a row for each clause, and those of ``_attached``, as written tables."""
    folder = graph.work_folder(blocks.sparkSession)
    drafted = _drafts(graph.written(annotated(blocks, folder), f"{folder}/annotated"))
    attached = graph.written(_attached(drafted), f"{folder}/attached")
    found = drafted.where("draft is not null").select("id", "ordinal", "start_line", "end_line", "path", "draft")
    return found.unionByName(attached, allowMissingColumns=True)


def clauses(read: DataFrame, document_level: Column | None = None) -> DataFrame:
    """(id, clause from 1, rule_id, native_id, rule_type, status, text, heading_path, parent_context, start_line, end_line, api_level, notes, examples, previous, next).

    ``read`` comes from ``read_clauses``.  ``rule_id`` is the native id, or the last heading and
    the clause's number below its heading path; ids that occur again get the lines or
    a hash of the path.  ``previous`` and ``next`` are numbers of neighbours below the same headings.
    """
    found = read.where("draft is not null")
    notes = read.where("is_attached").groupBy("id", "of").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.regexp_replace("flat", NOTE_PREFIX, "").alias("text")))), lambda n: n["text"]), "").alias("notes"), F.max("end_line").alias("note_end"),
    )
    shown = read.where("example is not null").groupBy("id", "of").agg(
        F.array_sort(F.collect_list(F.struct("start_line", "end_line", F.col("example").alias("kind"), "text"))).alias("examples")
    )
    of = lambda a: F.col("d.id").eqNullSafe(F.col(f"{a}.id")) & (F.col("d.ordinal") == F.col(f"{a}.of"))
    d = found.alias("d").join(notes.alias("n"), of("n"), "left").join(shown.alias("s"), of("s"), "left")
    levels = F.filter(F.transform(F.reverse("d.path"), api_level), lambda x: x.isNotNull())
    d = d.select(
        "d.id", "d.ordinal", F.col("d.draft.native_id").alias("native_id"), F.col("d.draft.rule_type").alias("rule_type"), F.when(F.col("d.draft.rule_type") == "deprecation", "Deprecated").otherwise("Draft").alias("status"),
        F.concat("d.draft.text", F.coalesce("n.notes", F.lit(""))).alias("text"), F.col("d.path").alias("heading_path"), F.col("d.draft.context").alias("parent_context"),
        "d.start_line", F.coalesce("n.note_end", "d.end_line").alias("end_line"),
        F.coalesce(F.try_element_at(levels, F.lit(1)), api_level(F.col("d.draft.text")), F.lit(None).cast("int") if document_level is None else document_level).alias("api_level"),
        F.coalesce("n.notes", F.lit("")).alias("notes"), F.coalesce("s.examples", F.array().cast("array<struct<start_line:int,end_line:int,kind:string,text:string>>")).alias("examples"),
    )
    document = Window.partitionBy("id").orderBy("ordinal")
    d = d.withColumn("clause", F.row_number().over(document)).withColumn("place", F.row_number().over(Window.partitionBy("id", "heading_path").orderBy("ordinal")))
    near = lambda f: F.when(f("heading_path").over(document) == F.col("heading_path"), f("clause").over(document))
    anchor = F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit(""))
    d = d.withColumn("previous", near(F.lag)).withColumn("next", near(F.lead)).withColumn("base", F.coalesce("native_id", F.concat(anchor, F.lit(":"), F.format_string("%02d", "place"))))
    again = F.count("*").over(Window.partitionBy("id", "base")) > 1
    lines = F.format_string("%s@L%d-L%d", "base", "start_line", "end_line")
    hashed = F.concat("base", F.lit("@heading-"), F.substring(F.sha2(F.to_json("heading_path"), 256), 1, 12))
    rule_id = F.when(~again, F.col("base")).when(F.col("native_id").isNotNull(), lines).otherwise(hashed)
    return d.select("id", "clause", rule_id.alias("rule_id"), "native_id", "rule_type", "status", "text", "heading_path", "parent_context", "start_line", "end_line", "api_level", "notes", "examples", "previous", "next")


def diagnostics(read: DataFrame) -> DataFrame:
    """(id, start_line, issue) of what belongs to no clause: orphaned labels, examples and notes, skipped or odd tables; distinct."""
    return read.where("issue is not null").select("id", "start_line", "issue").distinct()
