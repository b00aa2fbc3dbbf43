"""Markdown blocks, sections, atoms, clauses and places, by hand-made cases and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.markdown import annotations as A
from lodestone.markdown import blocks as B
from lodestone.markdown import clauses as C
from lodestone.markdown import sections as S
from lodestone.operators import positions as P

BITS = ["# h", "## must never do", "#### deep", "- a", "  - b must ", "1. x", "> q", "> Note: n", "```", "~~~", "| a | b |", "|---|---|", "    code", "text", "must hold", "So:", "参数：", "正例：", "反例", "", "", "  ", "***", "===", "---", "<!-- x", "-->", "<div>", "\t- t", "10) z", ">", "-", "text \r", "> > z", "\x0bvt"]


def texts(seed, n, bits=BITS, most=14):
    rng = random.Random(seed)
    return ["\n".join(rng.choices(bits, k=rng.randint(0, most))) + rng.choice(["", "\n"]) for _ in range(n)]


def test_units_share_out_every_line():
    for t in texts(1, 4000):
        rows = list(B.Scan(t).rows())
        assert "".join(r[-1] for r in rows if r[6]) == t
        for r in rows:
            assert r[4] <= r[5] and (r[2] != "blank" or not r[-1].strip())
            if r[1] is not None:
                assert rows[r[1]][4] <= r[4] and r[5] <= rows[r[1]][5]


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("a\n===\nb\n---\n", ["heading", "heading"]), ("a\n\n---\n", ["paragraph", "blank", "break"]), ("---\nx: 1\n---\ny\n", ["front_matter", "paragraph"]), ("---\nx\n", ["break", "paragraph"]),
        ("```\n# no\n", ["fence"]), ("````\n```\n````\n# h", ["fence", "heading"]), ("- a\n- b\n* c\n", ["item", "item", "item"]), ("1. a\n\n   b\n2. c\n", ["item", "item"]), ("a\n2. b\n", ["paragraph"]),
        ("> a\nb\n\nc", ["quote", "blank", "paragraph"]), ("|a|b|\n|-|-|\n|1|\n\nx", ["table", "blank", "paragraph"]), ("a|b\n|-|\n", ["paragraph"]), ("    code\n\n    more\ntext", ["code", "paragraph"]), ("<!-- a\n# b\n-->\n# c", ["comment", "heading"]),
        ("#no\n####### no\n# \n", ["paragraph", "heading"]), ("", []), ("\n \n", ["blank"]),
    ],
)
def test_kinds_of_units(text, kinds):
    assert [r[2] for r in B.Scan(text).rows() if r[6]] == kinds


def test_deep_and_long_texts_are_scanned_in_time():
    for t in ("> " * 20_000, "- " * 5_000, "#" * 100_000, "# " + " " * 200_000 + "x", "|" * 100_000 + "\n" + "|-" * 50_000, "\n".join("  " * i + "- x" for i in range(400))):
        assert "".join(r[-1] for r in B.Scan(t).rows() if r[6]) == t


def frame(spark, docs):
    return B.blocks(spark.createDataFrame(list(enumerate(docs)), "doc int, body string").repartition(3), "doc", "body")


def test_sections_against_a_stack(spark):
    docs = texts(3, 150, ["# a", "## b", "### c", "###### f", "text", "", "```", "> # q", "#", "---"], 12)
    got = S.sections(frame(spark, docs)).orderBy("id", "section").collect()
    for i, t in enumerate(docs):
        rows = list(B.Scan(t).rows())
        heads = [(r[4], r[3], r[10]) for r in rows if r[2] == "heading" and not r[7] and r[10].strip()]
        total = max((r[5] for r in rows), default=0)
        want, stack = [], []
        if not heads or any(r[2] != "blank" and r[4] < heads[0][0] for r in rows):
            want = [(None, (), None, 1, heads[0][0] - 1 if heads else total)] if rows else []
        for k, (line, level, title) in enumerate(heads):
            while stack and stack[-1][0] >= level:
                stack.pop()
            end = next((h[0] - 1 for h in heads[k + 1 :] if h[1] <= level), total)
            want.append((level, (*(s[2] for s in stack), title), stack[-1][1] if stack else None, line, end))
            stack.append((level, len(want) - 1, title))
        assert [(r["level"], tuple(r["heading_path"]), r["parent"], r["start_line"], r["subtree_end"]) for r in got if r["id"] == i] == want, t


def test_atoms_belong_to_their_sections(spark):
    docs = ["pre\n\n# a\n> [!NOTE]\n> x\n\n> y\n## b\n- i\n\n<!-- c -->\n", "# a\nx\n", "only\n"]
    got = {(r["id"], r["start_line"]): (r["kind"], r["section"], r["eligible"]) for r in S.atoms(frame(spark, docs)).collect()}
    assert got[0, 1] == ("paragraph", 0, True) and got[0, 3] == ("heading", None, False) and got[0, 4] == ("note", 1, True) and got[0, 7] == ("blockquote", 1, True)
    assert got[0, 9] == ("list_item", 2, True) and got[0, 11] == ("html_comment", None, False) and got[1, 2] == ("paragraph", 0, True) and got[2, 1] == ("paragraph", 0, True)


GUIDE = """# Guide

Callers must not block here.

> Note: see below.

**正例**

```js
ok()
```

反例：

```js
bad()
```

## API 12 起

The following holds:

- It must be named R-1.2.
  - nested should be kept

    ```
    x
    ```
- plain

参数：

| a | b |
|---|---|
| must | x |

### Must never be forgotten

text

| AC ID | 验收标准 |
|---|---|
| AC-1 | returns 3 |
| zz | must |

> lost note
"""


def test_clauses_of_a_guide(spark):
    read = C.read_clauses(frame(spark, [GUIDE, None, "", "plain\n"]))
    got = C.clauses(read).orderBy("clause").collect()
    assert [(r["rule_id"], r["rule_type"], r["text"], r["parent_context"], r["start_line"], r["end_line"], r["api_level"], r["previous"], r["next"]) for r in got] == [
        ("Guide:01", "constraint", "Callers must not block here.see below.", None, 3, 5, None, None, None),
        ("R-1.2", "constraint", "It must be named R-1.2.", "The following holds:", 23, 23, 12, None, 3),
        ("API 12 起:02", "constraint", "nested should be kept", "It must be named R-1.2.", 24, 24, 12, 2, None),
        ("Must never be forgotten:01", "constraint", "Must never be forgotten", None, 37, 37, 12, None, 5),
        ("AC-1", "behavior", "returns 3", "验收标准", 43, 43, 12, 4, None),
    ]
    assert [(e["kind"], e["text"]) for e in got[0]["examples"]] == [("positive", "ok()"), ("negative", "bad()")] and got[2]["examples"][0]["kind"] == "neutral"
    assert sorted((r["start_line"], r["issue"]) for r in C.diagnostics(read).collect()) == [(33, "skipped_metadata_table"), (44, "invalid_acceptance_row"), (46, "orphan_normative_note")]


def plain_clauses(text):
    """(first line, last line, notes, examples) of clauses outside lists and tables, by a walk over the blocks."""
    found, meta, label, owner = [], False, None, None
    for _, _, kind, _, start, end, _, quoted, items, path, body, _, _ in B.Scan(text).rows():
        flat, same = " ".join(body.split()), bool(found) and found[-1]["path"] == path
        if items or kind not in ("heading", "paragraph", "fence", "list", "table"):
            continue
        example = {"正例": "positive", "反例": "negative"}.get(flat[:2]) if kind == "paragraph" else None
        clear = kind == "heading" or (kind in ("list", "table") and not meta)
        if kind == "heading":
            meta = False
            if "must " in flat.lower() and len(flat) >= 8:
                found.append({"path": path, "start": start, "end": end, "notes": 0, "examples": []})
        elif kind == "fence":
            if same and (label or start <= found[-1]["end"] + 2):
                found[-1]["examples"].append((start, label or "neutral"))
            label = None
        elif example:
            meta = False
            good = same and (owner or start <= found[-1]["end"] + 3)
            label, owner = (example, True) if good else (None, False)
        elif flat == "参数：" and kind == "paragraph":
            meta, clear = True, True
        elif kind == "paragraph" and not meta and quoted:
            if same and start <= found[-1]["end"] + 2:
                found[-1]["notes"] += 1
                found[-1]["end"] = end
        elif kind == "paragraph" and not meta and "must " in flat and not flat.endswith((":", "：")):
            found.append({"path": path, "start": start, "end": end, "notes": 0, "examples": []})
            clear = True
        if clear:
            label, owner = None, kind == "heading" and bool(found) and found[-1]["start"] == start
    return [(c["start"], c["end"], c["notes"] > 0, c["examples"]) for c in found]


def test_clauses_against_a_walk(spark):
    docs = texts(7, 250, ["# h", "## must never do", "must hold", "must be so:", "> q", "> Note: n", "```\nx\n```", "正例：", "反例", "参数：", "text", "", "", "", "- item\n", "|a|b|\n|-|-|\n"], 14)
    docs = [t.replace("\n", "\n\n") if i % 2 else t for i, t in enumerate(docs)]
    got = C.clauses(C.read_clauses(frame(spark, docs))).orderBy("id", "clause").collect()
    for i, t in enumerate(docs):
        assert [(r["start_line"], r["end_line"], r["notes"] != "", [(e["start_line"], e["kind"]) for e in r["examples"]]) for r in got if r["id"] == i] == plain_clauses(t), t


def test_texts_of_clauses_stay_out_of_the_written_windows(spark, monkeypatch):
    """Windows carry no text of a clause, and only rows that belong to a clause or have an issue are written after them."""
    tables = {}
    monkeypatch.setattr(C.graph, "written", lambda df, path, write=C.graph.written: tables.setdefault(path.rsplit("/", 1)[1], write(df, path)))
    C.clauses(C.read_clauses(frame(spark, ["must hold\n\n> note\n\n" * 20]))).collect()
    assert {"id", "of", "is_attached"} < set(tables["attached"].columns) and tables["attached"].count() == 20
    assert tables["attached"].where("flat like 'must%'").isEmpty() and tables["annotated"].where("text is not null").isEmpty()


def test_blocks_of_several_documents_share_a_batch(spark, monkeypatch):
    docs = ["a\n\nb", None, "", "# c\n" * 9, "d", ""]
    whole = sorted(map(str, frame(spark, docs).collect()))
    monkeypatch.setattr(B, "BATCH", 3)
    assert sorted(map(str, frame(spark, docs).collect())) == whole


def test_places_against_encodings(spark):
    docs = ["a😀é\nb\n\n", "", None, "x" * 30, "é\n" * 5]
    texts = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    asked = [(i, u, at) for i in range(6) for u in ("point", "utf16", "utf8", "odd") for at in [*range(-1, 14), None]] + [(None, "point", 0)]
    got = P.positions(texts, spark.createDataFrame(asked, "id int, unit string, at long").repartition(3)).collect()
    assert len(got) == 5 * 4 * 16
    sizes = {"point": lambda s: len(s), "utf16": lambda s: len(s.encode("utf-16-le")) // 2, "utf8": lambda s: len(s.encode())}
    for r in got:
        text = docs[r["id"]] or ""
        at = next((k for k in range(len(text) + 1) if r["unit"] in sizes and sizes[r["unit"]](text[:k]) == r["at"]), None)
        head = None if at is None else text[:at]
        assert tuple(r)[3:] == ((None,) * 5 if at is None else (*(f(head) for f in sizes.values()), head.count("\n") + 1, at - head.rfind("\n"))), r


def test_places_of_one_text_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(P, "POINTS", 7)
    texts = spark.createDataFrame([(1, "ab\ncd" * 40)], "id int, text string")
    got = P.positions(texts, spark.range(201).select(F.lit(1).alias("id"), F.lit("point").alias("unit"), F.col("id").alias("at")))
    assert got.where("point = at and utf8 = at").count() == 201


def test_annotations(spark):
    clauses = spark.createDataFrame([(1, 1, "Call `load` or ui.save(x); @Entry", ["API"], None), (1, 2, "plain", ["Secret part"], "a Token:"), (2, 1, "xload(1)", [], None)], "id int, clause int, text string, heading_path array<string>, parent_context string")
    keywords = spark.createDataFrame([("token", "auth"), ("secret", "auth"), ("API", "iface"), ("", "none")], "keyword string, tag_id string")
    interfaces = spark.createDataFrame([("ui.load",), ("save",), ("Entry",), ("ui.save",)], "name string")
    dimensions = spark.createDataFrame([("safety", "auth", "Active"), ("old", "iface", "Deprecated")], "dimension_id string, tag_id string, status string")
    got = {(r["id"], r["clause"]): (list(r["tags"]), list(r["dimension_ids"]), list(r["interfaces"])) for r in A.annotate(clauses, keywords, interfaces, dimensions).collect()}
    assert got == {(1, 1): (["iface"], [], ["Entry", "save", "ui.load", "ui.save"]), (1, 2): (["auth"], ["safety"], []), (2, 1): ([], [], [])}


def test_passages(spark):
    text = "intro\n# Doc\n## Usage:\none\ntwo\n\n![x](y)\n### Detail\n- three\n> four\n\n**Notes**\n\nfive\n## Other\nsix\n# Next\nseven\n## usage\neight\n"
    got = S.passages(frame(spark, [text, None, "usage\n\nx"]), ["Usage"], ["Notes"]).orderBy("id", "passage").collect()
    assert [(r["id"], r["passage"], r["text"], list(r["heading_path"]), r["start_line"]) for r in got] == [
        (0, 1, "one two", ["Doc", "usage", "Usage:"], 4), (0, 2, "three", ["Doc", "usage", "Detail"], 9), (0, 3, "four", ["Doc", "usage", "Detail"], 10), (0, 4, "eight", ["Next", "usage"], 20), (2, 1, "x", ["usage"], 3),
    ]
