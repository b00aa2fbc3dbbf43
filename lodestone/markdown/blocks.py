"""Markdown documents as a table of blocks.

One linear pass over the lines of each document gives a row for every block, with
the lines it covers and its enclosing blocks; all that follows (sections, atoms,
clauses) is windows, joins and groups over these rows.  The units of a document
(blocks outside any other, the items of its lists, runs of blank lines) carry their
source, and these sources put together are the document, character by character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r" {0,3}([-+*]|(\d{1,9})[.)])(?= |$)")
_BREAK = re.compile(r" {0,3}(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?= |$)")
_UNDERLINE = re.compile(r" {0,3}(=+|-+) *$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})")
_HTML = re.compile(r" {0,3}</?[A-Za-z][A-Za-z0-9-]*(?:[ />]|$)")
_COMMENT = re.compile(r" {0,3}<!--")
_DELIMITER = re.compile(r" {0,3}\|? *:?-+:? *(?:\| *:?-+:? *)*\|? *$")
_CELL = re.compile(r"(?<!\\)\|")

#: Blocks within blocks; what would be deeper is text.
MOST_NESTED = 100
#: Blocks after which a task hands them on, at the end of a document.
BATCH = 4_096
FIELDS = (
    "ordinal int, parent int, kind string, level int, start_line int, end_line int, unit boolean, quoted boolean, items array<int>, path array<string>, text string, cells array<string>, source string"
)


@dataclass(eq=False)
class Block:
    kind: str
    parent: Block | None
    start: int
    path: tuple[str, ...]
    end: int = 0
    level: int = 0
    indent: int = 0
    mark: str = ""
    lines: list[str] = field(default_factory=list)
    cells: list[str] | None = None

    def above(self) -> Iterator[Block]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent


def cells(line: str) -> list[str]:
    """The cells of a table's line; an escaped bar is part of its cell."""
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip() for c in _CELL.split(line)]


class Scan:
    """The blocks of one document; a line is looked at once for each block that holds it."""

    def __init__(self, text: str, front_matter: bool = True):
        self.lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        self.blocks: list[Block] = []
        self.open: list[Block] = []
        self.leaf: Block | None = None
        self.path: tuple[str, ...] = ()
        first = self._front_matter() if front_matter else 0
        for no, raw in enumerate(self.lines[first:], first + 1):
            self._line(no, raw.rstrip("\r\n").expandtabs(4))
        self._units()

    def _front_matter(self) -> int:
        """The last line of a first block between ---, or 0."""
        if self.lines and self.lines[0].strip() == "---":
            for no, raw in enumerate(self.lines[1:], 2):
                if raw.strip() in ("---", "..."):
                    self._new("front_matter", 1).end = no
                    return no
        return 0

    def _new(self, kind: str, no: int, **more: object) -> Block:
        block = Block(kind, self.open[-1] if self.open else None, no, self.path, no, **more)
        self.blocks.append(block)
        for b in block.above():
            b.end = no
        return block

    def _extend(self, no: int, line: str) -> None:
        self.leaf.lines.append(line)
        self.leaf.end = no
        for b in self.leaf.above():
            b.end = max(b.end, no)

    def _line(self, no: int, rest: str) -> None:
        kept = 0
        for block in self.open:
            if block.kind == "quote":
                mark = _QUOTE.match(rest)
                if not mark:
                    break
                rest = rest[mark.end() :]
                self._reach(block, no)
            elif block.kind == "item" and rest.strip():
                if len(rest) - len(rest.lstrip(" ")) < block.indent:
                    break
                rest = rest[block.indent :]
            kept += 1
        blank = not rest.strip()
        if kept < len(self.open):
            if self.leaf is not None and self.leaf.kind == "paragraph" and not blank and not self._starts(rest, self.open[kept - 1].kind == "list" if kept else False):
                self._extend(no, rest)
                return
            self.leaf = None
            del self.open[kept:]
        if self.leaf is not None and self.leaf.kind in ("fence", "comment", "html") and self._inside(no, rest, blank):
            return
        rest = self._containers(no, rest)
        if not rest.strip():
            if self.leaf is not None and self.leaf.kind == "code":
                self.leaf.lines.append("")
            else:
                self.leaf = None
            return
        self._content(no, rest)

    def _starts(self, rest: str, in_list: bool) -> bool:
        """Whether the line can't go on with a paragraph; within a list any marker is the next item."""
        item = _ITEM.match(rest)
        return bool((item and in_list) or _QUOTE.match(rest) or _BREAK.match(rest) or _HEADING.match(rest) or _FENCE.match(rest) or _COMMENT.match(rest) or (item and rest[item.end() :].strip() and item[2] in (None, "1")))

    def _inside(self, no: int, rest: str, blank: bool) -> bool:
        """Whether the line belongs to an open fence, comment or piece of HTML, which it may end."""
        leaf = self.leaf
        if leaf.kind == "fence":
            closing = rest.strip()
            if len(rest) - len(rest.lstrip(" ")) < 4 and len(closing) >= len(leaf.mark) and set(closing) == {leaf.mark[0]}:
                leaf.end = no
                for b in leaf.above():
                    b.end = no
                self.leaf = None
            else:
                strip = min(leaf.indent, len(rest) - len(rest.lstrip(" ")))
                self._extend(no, rest[strip:])
            return True
        if leaf.kind == "html" and blank:
            self.leaf = None
            return False
        self._extend(no, rest)
        if leaf.kind == "comment" and "-->" in rest:
            self.leaf = None
        return True

    def _containers(self, no: int, rest: str) -> str:
        """Opens quotes, lists and items that the line begins; gives what is left of it."""
        while rest and not rest[0].isalpha() and not rest.isspace():  # else it begins none
            if len(rest) - len(rest.lstrip(" ")) >= 4 or len(self.open) >= MOST_NESTED:
                break
            quote, item = _QUOTE.match(rest), _ITEM.match(rest)
            in_text = self.leaf is not None and self.leaf.kind == "paragraph"
            if quote:
                self._close_list()
                self.leaf = None
                self.open.append(self._new("quote", no))
                rest = rest[quote.end() :]
            elif item and not _BREAK.match(rest) and not (in_text and (not rest[item.end() :].strip() or item[2] not in (None, "1"))):
                self.leaf = None
                mark = item[1][-1]
                if not (self.open and self.open[-1].kind == "list" and self.open[-1].mark == mark):
                    self._close_list()
                    self.open.append(self._new("list", no, mark=mark, level=1 + sum(b.kind == "list" for b in self.open)))
                body = rest[item.end() :]
                space = len(body) - len(body.lstrip(" "))
                space = space if body.strip() and space <= 4 else 1
                self.open.append(self._new("item", no, indent=item.end() + space, level=self.open[-1].level))
                rest = body[space:]
            else:
                break
        if rest and not rest.isspace():
            self._close_list()
        return rest

    def _close_list(self) -> None:
        if self.open and self.open[-1].kind == "list":
            self.open.pop()

    def _content(self, no: int, rest: str) -> None:
        leaf = self.leaf
        if rest[0].isalpha() and (leaf is None or leaf.kind in ("paragraph", "code")):  # no mark of another kind
            if leaf is not None and leaf.kind == "paragraph":
                self._extend(no, rest)
            else:
                self.leaf = self._new("paragraph", no, lines=[rest])
            return
        indent = len(rest) - len(rest.lstrip(" "))
        heading, fence = _HEADING.match(rest), _FENCE.match(rest)
        underline = _UNDERLINE.match(rest)
        if leaf is not None and leaf.kind == "paragraph" and underline:
            leaf.kind, leaf.level, leaf.end = "heading", 1 if "=" in underline[1] else 2, no
            for b in leaf.above():
                b.end = no
            self._heading(leaf)
        elif leaf is not None and leaf.kind == "paragraph" and len(leaf.lines) == 1 and "|" in leaf.lines[0] + rest and _DELIMITER.match(rest) and len(cells(rest)) == len(cells(leaf.lines[0])):
            leaf.kind = "table"
            head = Block("row", leaf, leaf.start, self.path, leaf.start, cells=cells(leaf.lines.pop()))
            self.blocks.append(head)
            leaf.cells = head.cells
            self._reach(leaf, no)
        elif leaf is not None and leaf.kind == "code" and indent >= 4:
            self._extend(no, rest[4:])
        elif indent >= 4 and (leaf is None or leaf.kind != "paragraph"):
            self.leaf = self._new("code", no, lines=[rest[4:]])
        elif heading:
            title = rest[heading.end() :].strip()
            closed = title.rstrip("#")
            self._heading(self._new("heading", no, level=len(heading[1]), lines=[closed.rstrip() if not closed or closed.endswith(" ") else title]))
        elif fence:
            self.leaf = self._new("fence", no, indent=len(fence[1]), mark=fence[2])
        elif _BREAK.match(rest):
            self._new("break", no)
            self.leaf = None
        elif _COMMENT.match(rest):
            self.leaf = self._new("comment", no, lines=[rest])
            if "-->" in rest:
                self.leaf = None
        elif leaf is not None and leaf.kind == "table":
            self.blocks.append(Block("row", leaf, no, self.path, no, level=1, cells=(cells(rest) + [""] * len(leaf.cells))[: len(leaf.cells)]))
            self._reach(leaf, no)
        elif leaf is not None and leaf.kind == "paragraph":
            self._extend(no, rest)
        else:
            self.leaf = self._new("html" if _HTML.match(rest) else "paragraph", no, lines=[rest])

    def _reach(self, block: Block, no: int) -> None:
        block.end = no
        for b in block.above():
            b.end = no

    def _heading(self, block: Block) -> None:
        """A title goes to the slot of its level, or to the first free one if levels were skipped; headings in lists leave the path."""
        self.leaf = None
        if not any(b.kind == "item" for b in block.above()):
            title = " ".join(" ".join(block.lines).split())
            self.path = (*self.path[: block.level - 1], title)
        block.path = self.path

    def _units(self) -> None:
        """Adds runs of lines outside any unit, and puts blocks in the order of their lines."""
        covered = 0
        for block in [b for b in self.blocks if is_unit(b)]:
            if block.start > covered + 1:
                self.blocks.append(Block("blank", None, covered + 1, (), block.start - 1))
            covered = block.end
        if covered < len(self.lines):
            self.blocks.append(Block("blank", None, covered + 1, (), len(self.lines)))
        self.blocks.sort(key=lambda b: b.start)

    def rows(self) -> Iterator[tuple]:
        at = {id(b): i for i, b in enumerate(self.blocks)}
        for i, b in enumerate(self.blocks):
            above = list(b.above())
            items = [at[id(x)] for x in reversed(above) if x.kind == "item"]
            unit = is_unit(b)
            yield (
                i, at[id(b.parent)] if b.parent is not None else None, b.kind, b.level, b.start, b.end, unit, any(x.kind == "quote" for x in above), items, list(b.path),
                "\n".join(x.strip() if b.kind in ("paragraph", "heading") else x for x in b.lines), b.cells if b.kind == "row" else None, "".join(self.lines[b.start - 1 : b.end]) if unit else None,
            )


def is_unit(block: Block) -> bool:
    """Whether the block is one of those that share out the lines of a document."""
    if block.kind == "list":
        return False
    return block.parent is None or (block.kind == "item" and block.parent.parent is None)


def blocks(docs: DataFrame, id_col: str, text_col: str, front_matter: bool = True) -> DataFrame:
    """(id, ordinal, parent, kind, level, start_line, end_line, unit, quoted, items, path, text, cells, source) of each document's blocks.

    ``kind`` is heading, paragraph, fence, code, table, row, list, item, quote, html,
    comment, break, blank or front_matter; ``level`` that of a heading, the depth of a
    list, 0 for a table's head.  ``items`` are the enclosing list items, outermost
    first; ``path`` the headings above (its own for a heading).  An unfinished fence
    ends with its document.  A null or empty text has no blocks; a null id is an id.
    """
    schema = T._parse_datatype_string(f"id {docs.schema[id_col].dataType.simpleString()}, {FIELDS}")
    names = schema.names
    types = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.string())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, found = batch.column("id"), [], []
            for k, text in enumerate(batch.column("text")):
                found += Scan(text.as_py() or "", front_matter).rows()
                at += [k] * (len(found) - len(at))
                if found and (len(found) >= BATCH or k == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True))], names=names)
                    at, found = [], []

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(task, schema)
