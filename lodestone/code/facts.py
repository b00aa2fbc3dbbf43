"""Facts of source files: a parser per kind of file, and joins that make declarations and calls of its rows.

A parser is a class whose ``eval`` yields the facts of a text, registered for a media
type; ``parsed`` applies each to its files and gives one table of facts.  What needs more
than one place of a file (matching brackets, enclosing declarations, bindings that
an inner scope hides) is windows and joins over that table.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graph, intervals, records
from .lexing import mask

FACT = "kind string, name string, value string, start int, stop int, line int"
_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
_OPENS = r"(?:\s*<[^<>{};()]*>)?\s*(?:\?\.)?\s*\("
_CALL = re.compile(rf"(?<![A-Za-z0-9_$])({_NAME}(?:\s*(?:\?\.|\.)\s*{_NAME})*){_OPENS}")
_IMPORT = re.compile(r"""^[ \t]*(import)\s+(?!['"])((?:(?!^[ \t]*import\b)[\s\S])+?)\s+from\s+['"]([^'"]+)['"]""", re.MULTILINE)
_BARE_IMPORT = re.compile(r"""^[ \t]*(import)\s+(?:lazy\s+)?['"]([^'"]+)['"]""", re.MULTILINE)
_DECORATOR = re.compile(r"@[A-Za-z_]\w*", re.ASCII)
_TYPE = re.compile(r"\b(struct|class)\s+([A-Za-z_]\w*)[^{;]*\{", re.ASCII)
_CALLABLE = re.compile(rf"((?:@\w+\s*)*(?:(?:public|private|protected|static|async|export)\s+)*)\b({_NAME})\s*\([^;{{}}]*?\)\s*(?::\s*[^{{;]+)?\{{", re.ASCII)
_LOCAL = re.compile(rf"\b(?:let|const|var)\s+({_NAME})")
_BRACKET = re.compile(r"[{}()\[\]]")
#: Words of which a text with the syntax holds one.
_SYNTAX_WORDS = {"async_fn": ("async",), "await_expr": ("await",), "promise": ("Promise",), "arrow_fn": ("=>",), "try_catch": ("try", "catch")}
_SYNTAX = {
    "async_fn": re.compile(r"\basync\s+(?:function\s+)?[A-Za-z_$]"), "await_expr": re.compile(r"\bawait\b"), "promise": re.compile(r"\bPromise\b"),
    "arrow_fn": re.compile(r"=>"), "try_catch": re.compile(r"\btry\s*\{|\bcatch\s*\("),
}
CONTROL = frozenset({"if", "for", "while", "switch", "catch", "function", "return"})


def _after_dot(code: str, at: int) -> bool:
    """Whether the last sign before ``at`` that isn't white space is a dot."""
    while at and code[at - 1].isspace():
        at -= 1
    return at > 0 and code[at - 1] == "."


def imported(clause: str) -> Iterator[tuple[str, str]]:
    """(local name, imported name) of an import clause; ``default`` and ``*`` stand for whole modules."""
    clause = " ".join(clause.split()).removeprefix("lazy ").strip()
    head, brace, named = clause.partition("{")
    for part in filter(None, (p.strip() for p in head.split(","))):
        yield (part.removeprefix("* as ").strip(), "*") if part.startswith("* as ") else (part, "default")
    for item in filter(None, (p.strip() for p in named.rstrip("} ").split(","))) if brace else ():
        name, _, local = item.partition(" as ")
        yield (local or name).strip(), name.strip()


class ScriptFacts:
    """Facts of one script: imports, calls, decorators, syntax, declarations, local names and brackets."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is None:
            return
        code = mask(text)
        lines = [m.end() for m in re.finditer("\n", text)]

        def fact(kind: str, name: str, value: str | None, start: int, stop: int) -> tuple:
            return kind, name, value, start, stop, bisect.bisect_right(lines, start) + 1

        modules = set()
        for m in _IMPORT.finditer(text):
            if code[m.start(1) : m.end(1)] == "import":
                modules.add(m[3])
                for local, name in imported(m[2]):
                    yield fact("import", local, f"{m[3]}#{name}", m.start(1), m.end())
        for m in _BARE_IMPORT.finditer(text):
            if code[m.start(1) : m.end(1)] == "import" and m[2] not in modules:
                yield fact("import", "", f"{m[2]}#", m.start(1), m.end())
        for m in _DECORATOR.finditer(code):
            yield fact("decorator", m[0], None, m.start(), m.end())
        for m in _CALL.finditer(code):
            chain = "".join(m[1].split()).replace("?.", ".")
            if chain not in CONTROL and not _after_dot(code, m.start()):
                yield fact("call", chain, chain.split(".")[0], m.start(), m.end())
        for name, pattern in _SYNTAX.items():
            if any(w in code for w in _SYNTAX_WORDS[name]) and (found := pattern.search(code)):
                yield fact("syntax", name, None, found.start(), found.end())
        for m in _TYPE.finditer(code):
            yield fact("declaration", m[2], m[1], m.start(), m.end() - 1)
        for m in _CALLABLE.finditer(code):
            if m[2] not in CONTROL and not _after_dot(code, m.start(2)):
                kind = "builder" if "@Builder" in m[1] else "build_method" if m[2] == "build" else "ui_block" if m[2][0].isupper() and m[2] not in ("Promise", "Array") else "function"
                yield fact("declaration", m[2], kind, m.start(), m.end() - 1)
        for m in _LOCAL.finditer(code) if any(w in code for w in ("let", "const", "var")) else ():
            yield fact("local", m[1], None, m.start(1), m.end(1))
        for m in _BRACKET.finditer(code):
            yield fact("bracket", m[0], None, m.start(), m.end())


#: Parsers by media type; ``eval`` takes a text and yields rows of ``FACT``.
PARSERS: dict[str, type] = {"text/typescript": ScriptFacts, "text/javascript": ScriptFacts, "text/html": ScriptFacts}


#: Facts that a task holds as objects before it hands them on.
FACTS = 100_000


def parsed(files: DataFrame, parsers: dict[str, type] | None = None) -> DataFrame:
    """(file, kind, name, value, start, stop, line) of ``files`` (file, media_type, text).

    Files of a media type without a parser have no facts.  Offsets are code points
    from 0, lines from 1.  Texts and facts pass in Arrow batches.
    """
    schema = T._parse_datatype_string(f"file {files.schema['file'].dataType.simpleString()}, {FACT}")
    types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())

    def facts_by(parser: type):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run = parser()
            for batch in batches:
                texts, at, rows = batch.column(1).to_pylist(), [], []
                for k, text in enumerate(texts):
                    for row in run.eval(text) or ():
                        at.append(k)
                        rows.append(row)
                    if len(rows) >= FACTS or k == len(texts) - 1 and rows:
                        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=schema.names)
                        at, rows = [], []

        return task

    found = None
    for media_type, parser in (PARSERS if parsers is None else parsers).items():
        facts = files.where(F.col("media_type") == media_type).select("file", F.col("text").cast("string")).mapInArrow(facts_by(parser), schema)
        found = facts if found is None else found.unionByName(facts)
    return found


def bracket_pairs(facts: DataFrame) -> DataFrame:
    """(file, bracket, start, stop, line): where each opening bracket is closed, null where nothing closes it.

    Brackets of a kind are numbered by nesting depth, a running sum; at one depth
    the next bracket after an opening one is its partner.  A closing bracket
    without a partner has a depth of its own and closes nothing.
    """
    kind = F.translate("name", "}])", "{[(")
    b = facts.where("kind = 'bracket'").select("file", "start", "line", kind.alias("bracket"), (F.col("name") == kind).alias("opens"))
    order = Window.partitionBy("file", "bracket").orderBy("start")
    step = F.when(F.col("opens"), 1).otherwise(-1)
    b = b.withColumn("depth", F.sum(step).over(order) + F.when(F.col("opens"), 0).otherwise(1))
    partner = F.lead(F.struct("start", "opens")).over(Window.partitionBy("file", "bracket", "depth").orderBy("start"))
    b = b.withColumn("partner", partner).where("opens")
    return b.select("file", "bracket", "start", F.when(~F.col("partner.opens"), F.col("partner.start")).alias("stop"), "line")


def declarations(facts: DataFrame) -> DataFrame:
    """(file, kind, name, qualified, parent, start, stop, line, end_line) of declarations whose block is closed.

    ``parent`` is the declaration with the fewest lines that holds one's lines; a
    function in a class or struct is a method.
    """
    folder = graph.work_folder(facts.sparkSession)
    pairs = graph.written(bracket_pairs(facts), f"{folder}/pairs").where("bracket = '{' and stop is not null")
    closing = facts.where("kind = 'bracket' and name = '}'").select("file", F.col("start").alias("stop"), F.col("line").alias("end_line"))
    blocks = pairs.join(closing, ["file", "stop"]).select("file", F.col("start").alias("brace"), "stop", "end_line")
    d = facts.where("kind = 'declaration'").select("file", "name", F.col("value").alias("kind"), "start", F.col("stop").alias("brace"), "line").join(blocks, ["file", "brace"])
    first = F.row_number().over(Window.partitionBy("file", "line", "end_line", "name").orderBy(F.col("kind").isin("class", "struct").cast("int").desc(), "start"))
    d = d.withColumn("n", first).where("n = 1").drop("n", "brace")
    d = graph.written(d, f"{folder}/declarations")
    inner = d.select("file", F.col("start").alias("id"), F.col("line").alias("start"), F.col("end_line").alias("end"))
    holders = d.where(F.col("kind").isin("struct", "class", "build_method")).select("file", F.col("start").alias("id"), F.col("line").alias("start"), F.col("end_line").alias("end"))
    up = intervals.nearest_enclosing(inner, holders, ["file"]).select("file", F.col("id").alias("start"), F.col("parent").alias("at"))
    above = d.select("file", F.col("start").alias("at"), F.col("name").alias("parent"), F.col("kind").alias("parent_kind"))
    j = d.join(up, ["file", "start"], "left").join(above, ["file", "at"], "left")
    in_type = F.col("parent_kind").isin("struct", "class")
    kind = F.when((F.col("kind") == "function") & in_type, "method").otherwise(F.col("kind"))
    j = j.withColumn("kind", kind)
    qualified = F.when((F.col("kind").isin("method", "build_method", "builder") & in_type) | ((F.col("kind") == "ui_block") & F.col("parent").isNotNull()), F.concat_ws(".", "parent", "name")).otherwise(F.col("name"))
    return j.select("file", "kind", "name", qualified.alias("qualified"), "parent", "start", "stop", "line", "end_line")


def canonical_calls(facts: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(file, start, line, call, canonical): calls through an imported name, outside the blocks where a local name hides it.

    A named import stands for its own name, a whole module for its prefix in
    ``prefixes`` (its own name where it has none).
    """
    calls = facts.where("kind = 'call'").select("file", F.struct("file", "start", "line", F.col("name").alias("call")).alias("call_id"), F.col("value").alias("alias"), F.col("start").alias("line"))
    module, name = F.substring_index("value", "#", 1), F.substring_index("value", "#", -1)
    whole = module
    for k, v in (prefixes or {}).items():
        whole = F.when(module == k, v).otherwise(whole)
    imports = facts.where("kind = 'import' and name <> ''").select("file", F.col("name").alias("alias"), F.when(name.isin("*", "default"), whole).otherwise(name).alias("canonical")).distinct()
    pairs = bracket_pairs(facts).where("bracket = '{' and stop is not null").select("file", F.col("start").alias("from"), F.col("stop").alias("to"))
    local = facts.where("kind = 'local'").select("file", F.col("name").alias("alias"), F.col("start").alias("at"))
    block = local.join(pairs, "file", "left").where(F.col("from").isNull() | F.col("at").between(F.col("from"), F.col("to")))
    inner = block.groupBy("file", "alias", "at").agg(F.max(F.struct("from", "to")).alias("b"))
    outer = local.join(inner, ["file", "alias", "at"], "left").select("file", "alias", F.coalesce("b.from", F.lit(0)).alias("start"), F.coalesce("b.to", F.lit(2**31 - 1)).alias("end"))
    bound = records.bound_calls(calls, imports, outer)
    rest = F.substring("call_id.call", F.length(F.substring_index("call_id.call", ".", 1)) + 1, F.length("call_id.call"))
    return bound.select("call_id.file", "call_id.start", "call_id.line", "call_id.call", F.concat("canonical", rest).alias("canonical"))
