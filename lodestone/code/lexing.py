"""Masks and token streams of source texts.

Each text is read once, by one pattern that takes comments, literals and words
whole; what it can't finish (a string that ends with its line, a comment without an
end) is an issue of the stream.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the token rules.
KEYWORDS = frozenset(
    """abstract as async await break case catch class const constructor continue declare default delete do else enum export extends false finally for from
    function get if implements import in instanceof interface let namespace new null of override private protected public readonly return set static struct
    super switch this throw true try type typeof undefined var void while with yield""".split()
)
OPERATORS = ">>>= **= &&= ||= ??= === !== >>> <<= >>= ... ?. ?? => == != <= >= ++ -- && || ** << >> += -= *= /= %= &= |= ^= ::".split()

_STRINGS = r"""(?:'(?:[^'\\]++|\\[\s\S])*+(?:'|\\?\Z)|"(?:[^"\\]++|\\[\s\S])*+(?:"|\\?\Z)|`(?:[^`\\]++|\\[\s\S])*+(?:`|\\?\Z))"""
_MASKED = regex.compile(rf"//[^\n]*+|/\*[\s\S]*?(?:\*/|\Z)|{_STRINGS}")
_INK = regex.compile(r"[^\n]")
_HOLE = regex.compile(r"(?<!\\)\$\{")
_SIMPLE_HOLE = regex.compile(r"(?<!\\)\$\{([^{}]*)\}")
TOKEN = "struct<content: array<string>, shape: array<string>, issues: array<string>>"


def mask(text: str) -> str:
    """The text with comments and strings blank; length and line feeds stay, and what isn't finished is blank to the end."""
    return _MASKED.sub(lambda m: _INK.sub(" ", m[0]), text)


def masked(text: Column) -> Column:
    """``mask`` of a column; null stays null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else mask(t))

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(text)


@functools.cache
def _tokens() -> regex.Pattern:
    digit = f"[{''.join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit())}]"
    digits = f"(?:{digit}|_)*+"
    operators = "|".join(map(regex.escape, sorted(OPERATORS, key=lambda o: (-len(o), o))))
    return regex.compile(
        r"(?P<space>\s++|//[^\n]*+\n?)"
        r"|(?P<comment>/\*(?:[\s\S]*?\*/|(?P<open_comment>[\s\S]*+)))"
        r"""|(?P<string>'(?:[^'\\\n\r]++|\\[\s\S])*+(?:(?P<a>')|[\n\r]|\\?\Z)|"(?:[^"\\\n\r]++|\\[\s\S])*+(?:(?P<b>")|[\n\r]|\\?\Z))"""
        r"|(?P<template>`(?P<body>(?:[^`\\]++|\\[\s\S])*+)(?:(?P<c>`)|\\?\Z))"
        rf"|(?P<number>0[xXbBoO]\w*+|{digit}{digits}(?:\.{digit}{digits})?(?:[eE][+-]?(?:{digit}|_)++)?n?)"
        r"|(?P<word>[\p{L}_$][\p{L}\p{M}\p{N}_$]*+)"
        rf"|(?P<operator>{operators})|(?P<other>[\s\S])"
    )


def lex(text: str) -> tuple[list[str], list[str], set[str]]:
    """(content tokens, shape tokens, issues) of a text in NFC; the shape has <id> for each word that isn't a keyword."""
    content: list[str] = []
    shape: list[str] = []
    issues: set[str] = set()

    def both(*tokens: str) -> None:
        content.extend(tokens)
        shape.extend(tokens)

    for m in _tokens().finditer(unicodedata.normalize("NFC", text)):
        kind = m.lastgroup if m.lastgroup in ("space", "number", "word", "operator", "other") else next(k for k in ("comment", "string", "template") if m[k] is not None)
        if kind == "comment" and m["open_comment"] is not None:
            both("<unterminated-comment>")
            issues.add("unterminated_block_comment")
        elif kind == "string":
            ended = m["a"] or m["b"]
            both("<string>" if ended else "<unterminated-string>")
            if not ended:
                issues.add("unterminated_string_literal")
        elif kind == "template":
            both("<template>" if m["c"] else "<unterminated-template>")
            if not m["c"]:
                issues.add("unterminated_template_literal")
                continue
            holes = _SIMPLE_HOLE.findall(m["body"])
            if len(holes) != len(_HOLE.findall(m["body"])):
                issues.add("complex_template_interpolation")
            for inner_content, inner_shape, inner_issues in map(lex, holes):
                content += ["<template-expression>", *inner_content, "</template-expression>"]
                shape += ["<template-expression>", *inner_shape, "</template-expression>"]
                issues |= inner_issues
        elif kind == "number":
            both("<number>")
        elif kind == "word":
            content.append(m[0])
            shape.append(m[0] if m[0] in KEYWORDS else "<id>")
        elif kind == "other" and (m[0] < " " or m[0] == "\x7f"):
            both(f"<control-{ord(m[0]):02x}>")
            issues.add("unexpected_control_character")
        elif kind in ("operator", "other"):
            both(m[0])
    return content, shape, issues


#: Characters whose tokens, some 20 bytes of memory each, a task holds before it hands them on.
PART = 1 << 18


def lexed(text: Column) -> Column:
    """struct(content, shape, issues) of ``lex``; a null text has no tokens and no issues.

    Tokens take many times their text, so a batch is answered in parts of ``PART`` characters or one text.
    """
    strings = pa.list_(pa.string())

    def answered(rows: list[tuple]) -> pa.StructArray:
        parts = [pa.array([r[0] for r in rows], strings), pa.array([r[1] for r in rows], strings), pa.array([sorted(r[2]) for r in rows], strings)]
        return pa.StructArray.from_arrays(parts, names=["content", "shape", "issues"])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.StructArray]:
        for batch in batches:
            rows, size = [], 0
            for value in batch:
                t = value.as_py()
                rows.append(lex(t) if t is not None else ([], [], set()))
                size += len(t or "")
                if size >= PART:
                    yield answered(rows)
                    rows, size = [], 0
            if rows or not len(batch):
                yield answered(rows)

    return F.arrow_udf(run, TOKEN, F.ArrowUDFType.SCALAR_ITER)(text)
