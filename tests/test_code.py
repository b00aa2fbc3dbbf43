"""Masks, token streams and facts of source texts."""

import random

from lodestone.code import facts as K
from lodestone.code import lexing as L
from lodestone.operators import owners
from lodestone.plans import code_queries as Q

SOURCE = """import Def, { a as b, c } from 'lib/x';
import * as ns from "lib/y";
import 'side';
// import { no } from 'comment';
@Entry
struct Page {
  @Builder row(x: number) { b.run("{"); }
  build() {
    Column() { c?.go(); ns.fn<number>(1) }
    let b = 1; b.hidden();
  }
  broken() {
"""


def plain_mask(text):
    """Character by character."""
    out, i, state = [], 0, ""
    while i < len(text):
        two, c = text[i : i + 2], text[i]
        width = 1
        if not state:
            blank = two in ("//", "/*") or c in "'\"`"
            state, width = (two, 2) if two in ("//", "/*") else (c if c in "'\"`" else "", 1)
        else:
            blank = True
            if state == "//":
                state = "" if c == "\n" else state
            elif state == "/*":
                width, state = (2, "") if two == "*/" else (1, state)
            elif c == "\\":
                width = 2
            elif c == state:
                state = ""
        out += [" " if blank and x != "\n" else x for x in text[i : i + width]]
        i += width
    return "".join(out)


def test_masks_against_a_walk():
    rng = random.Random(2)
    for _ in range(5000):
        t = "".join(rng.choices("ab/*'\"`\\\n {}", k=rng.randint(0, 25)))
        assert L.mask(t) == plain_mask(t), t


def test_streams_and_issues(spark):
    cases = {
        "const a = 'x\\'y' + 0x1F_n; // c\n/* d */": (["const", "a", "=", "<string>", "+", "<number>", ";"], []), "`a${x.y}b` ??= 1.5e-3n": (["<template>", "<template-expression>", "x", ".", "y", "</template-expression>", "??=", "<number>"], []),
        "it's open\nnext": (["it", "<unterminated-string>", "next"], ["unterminated_string_literal"]), "/* never": (["<unterminated-comment>"], ["unterminated_block_comment"]), "`open": (["<unterminated-template>"], ["unterminated_template_literal"]),
        "`${a{b}}`": (["<template>"], ["complex_template_interpolation"]), "\x01 é ²": (["<control-01>", "é", "<number>"], ["unexpected_control_character"]), "": ([], []), "a>>>=b...c": (["a", ">>>=", "b", "...", "c"], []),
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    for r in df.select("t", L.lexed(df["t"]).alias("x")).collect():
        content, issues = cases.get(r["t"], ([], []))
        assert r["x"]["content"] == content and r["x"]["issues"] == issues
        assert r["x"]["shape"] == [t if t in L.KEYWORDS or not (t[0].isalpha() or t[0] in "_$") else "<id>" for t in content]
    assert L.lex("it's" + " a line;" * 50_000)[0] == ["it", "<unterminated-string>"]


def test_facts_of_a_file(spark):
    files = spark.createDataFrame([("a.ts", "text/typescript", SOURCE), ("b.py", "text/x-python", SOURCE), ("c.ts", "text/typescript", None), ("d.ts", "text/typescript", "} { } } {")], "file string, media_type string, text string")
    facts = K.parsed(files).cache()
    assert {r["file"] for r in facts.collect()} == {"a.ts", "d.ts"}
    imports = {(r["name"], r["value"]) for r in facts.where("kind = 'import'").collect()}
    assert imports == {("Def", "lib/x#default"), ("b", "lib/x#a"), ("c", "lib/x#c"), ("ns", "lib/y#*"), ("", "side#")}
    assert {r["name"] for r in facts.where("kind = 'decorator'").collect()} == {"@Entry", "@Builder"}
    pairs = {(r["file"], r["start"]): r["stop"] for r in K.bracket_pairs(facts).where("bracket = '{'").collect()}
    assert {k[1]: v for k, v in pairs.items() if k[0] == "d.ts"} == {2: 4, 8: None}
    declared = {(r["kind"], r["qualified"], r["parent"], r["line"], r["end_line"]) for r in K.declarations(facts).collect()}
    assert declared == {("builder", "row", None, 7, 7), ("build_method", "build", None, 8, 11), ("ui_block", "build.Column", "build", 9, 9)}  # the struct never ends
    calls = {(r["call"], r["canonical"]) for r in K.canonical_calls(facts, {"lib/y": "why"}).collect()}
    assert calls == {("b.run", "a.run"), ("c.go", "c.go"), ("ns.fn", "why.fn")}  # b is hidden in build()


def test_methods_of_a_closed_type(spark):
    files = spark.createDataFrame([("a.ts", "text/typescript", SOURCE.replace("  broken() {\n", "}\n"))], "file string, media_type string, text string")
    declared = {(r["kind"], r["qualified"], r["parent"]) for r in K.declarations(K.parsed(files)).collect()}
    assert declared == {("struct", "Page", None), ("builder", "Page.row", "Page"), ("build_method", "Page.build", "Page"), ("ui_block", "build.Column", "build")}


def test_owner_roles_and_their_doubts(spark):
    declarations = [("f", f"t{i}", kind, f"T{i}", None, q) for i, (kind, q) in enumerate([("struct", "exact"), ("struct", "exact"), ("class", "exact"), ("struct", "recovered"), ("struct", "exact"), ("struct", "exact"), ("struct", "exact"), ("struct", "exact"), ("struct", None)])]
    declarations += [("f", f"m{i}", "method", f"T{t}.m{i}", p, q) for i, (t, p, q) in enumerate([(0, "t0", "exact"), (0, "t0", "recovered"), (0, "t0", "exact"), (0, "t0", "exact"), (1, "t1", "exact"), (9, None, "exact"), (9, "gone", "exact")])]
    declarations += [("f", "twice", "struct", "X", None, "exact")] * 2
    occurrences = [("f", "decorator", n, o, q) for n, o, q in [("@Component", "t0", "exact"), ("@Other", "t0", "guess"), ("@ComponentV2", "t1", "exact"), ("@Entry", "t1", "exact"), ("@Component", "t4", "exact"), ("@CustomDialog", "t4", "exact"), ("@CustomDialog", "t5", "exact"), ("@Component", "t6", "exact"), ("@ComponentV2", "t6", "exact"), ("@Component", "t7", "guess"), ("@Component", "t8", "exact")]]
    occurrences += [("f", "symbol", n, o, q) for n, o, q in [("T0.m0", "m0", "exact"), ("T0.m1", "m1", "exact"), ("T0.m3", "m3", "exact"), ("T0.m3", "m3", "exact"), ("T1.m4", "m4", "exact"), ("T1.m4", "m0", "exact")]]
    units = [(u, "f", k, o) for u, k, o in [("a", "struct", "t0"), ("b", "method", "m4"), ("c", "class", "t2"), ("d", "struct", "t3"), ("e", "struct", "t4"), ("g", "struct", "t5"), ("h", "struct", "t6"), ("i", "struct", "t7"), ("j", "struct", "twice"), ("k", "struct", None), ("l", "method", "m5"), ("m", "method", "m6"), ("n", "ui_block", "t0"), ("o", "class", "t0"), ("p", "struct", "t8"), ("q", "struct", "t1")]]
    frames = [spark.createDataFrame(r, s) for r, s in ((units, "unit_id string, file string, unit_kind string, owner_id string"), (declarations, "file string, declaration_id string, kind string, qualified string, parent_id string, quality string"), (occurrences, "file string, kind string, name string, owner_id string, quality string"))]
    evidence, diagnostics = owners.owner_roles(*frames)
    assert {(r["unit_id"], r["symbol"], r["owner_role"]) for r in evidence.collect()} == {("a", "T0.m0", "component"), ("b", "T1.m4", "component"), ("b", "T1.m4", "page"), ("q", "T1.m4", "component"), ("q", "T1.m4", "page")}
    assert {tuple(r) for r in diagnostics.collect()} == {
        ("a", "recovered"), ("a", "symbol_unresolved"), ("a", "symbol_ambiguous"), ("c", "role_unresolved"), ("d", "recovered"), ("e", "role_ambiguous"), ("g", "role_unresolved"), ("h", "role_ambiguous"), ("i", "recovered"),
        ("j", "unit_unresolved"), ("k", "unit_unresolved"), ("l", "enclosing_owner_unresolved"), ("m", "enclosing_owner_unresolved"), ("o", "unit_unresolved"), ("p", "recovered"),
    }


def test_tokens_of_a_batch_are_handed_on_in_parts(monkeypatch):
    """Python holds the tokens of a part of a batch, whatever the batch; null, empty and long texts keep their rows."""
    import pyarrow as pa

    sizes, kept = [], pa.StructArray.from_arrays

    class Seen:
        @staticmethod
        def from_arrays(parts, names):
            sizes.append(len(parts[0]))
            return kept(parts, names=names)

    texts = [None, "", "let a = 1;", "x " * 40, "y", "'open", None]
    monkeypatch.setattr(L, "PART", 20)
    monkeypatch.setattr(L.pa, "StructArray", Seen)
    column = {}
    monkeypatch.setattr(L.F, "arrow_udf", lambda run, *_: lambda text: column.setdefault("run", run))
    run = L.lexed(None)
    found = [r for part in run(iter([pa.array(texts)])) for r in part.to_pylist()]
    assert max(sizes) < len(texts) and sum(sizes) == len(texts)
    want = [L.lex(t) if t is not None else ([], [], set()) for t in texts]
    assert [(r["content"], r["shape"], set(r["issues"])) for r in found] == want


def test_streams_are_hashed_in_parts(monkeypatch):
    import pyarrow as pa

    from lodestone.operators import near_duplicate as N

    monkeypatch.setattr(N, "PART", 8)
    batch = pa.array([["a"] * 5, None, [], ["b"] * 20, ["a", "b", "c"], ["c"] * 9])
    parts = list(N.token_parts(batch))
    assert len(parts) > 2 and [x for p in parts for x in p.to_pylist()] == batch.to_pylist()
    assert [x for p in parts for x in N.shingle_hashes(p, 3).to_pylist()] == N.shingle_hashes(batch, 3).to_pylist()
    assert [x for p in N.token_parts(batch.slice(0, 0)) for x in p.to_pylist()] == []


def test_facts_come_in_parts_and_each_text_is_parsed_once(spark, monkeypatch, tmp_path):
    """Parts of a batch lose no fact and keep their file; a query reads each text once, whatever it makes of the facts."""
    monkeypatch.setattr(K, "FACTS", 5)
    texts = [(i, "text/typescript", "class A {\n" + f"  m{i}(a) {{ a.b . c(1); x\n. d(2) }}\n" * (i % 4) + "}\n") for i in range(40)] + [(40, "text/typescript", ""), (41, "text/typescript", None)]
    facts = K.parsed(spark.createDataFrame(texts, "file int, media_type string, text string").coalesce(1))
    got = sorted(tuple(r) for r in facts.collect() if r["value"] is not None)
    assert got == sorted((f, *x) for f, _, t in texts for x in K.ScriptFacts().eval(t) if x[2] is not None)
    assert {r["name"] for r in facts.where("kind = 'call'").collect() if not r["name"].startswith("m")} == {"a.b.c", "x.d"}

    seen = tmp_path / "seen"

    class Counting(K.ScriptFacts):
        def eval(self, text):
            with open(seen, "a") as f:
                f.write("x\n")
            yield from super().eval(text)

    monkeypatch.setattr(K, "PARSERS", {"text/typescript": Counting})
    spark.createDataFrame([(i, 7 * i, "1-X") for i in range(9)], "o_custkey int, o_orderkey int, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert Q.code_declarations(spark, str(tmp_path)).count() == 18
    assert len(seen.read_text().split()) == 9
