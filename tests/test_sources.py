"""Adapters, write-once tables, keyword automata and blocks of vectors, at their boundaries."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import intervals, near_duplicate, records, retrieval, tagging
from lodestone.sources import adapters
from lodestone.sources.store import SnapshotConflict, write_once

from .test_operators import values


def test_adapters(spark):
    rows = [
        ("s", "zh-cn/a.md", "﻿# Top #\r\n## Sub\rtext".encode()), ("s", "b.md", b"## no title\n> # Quoted\n"), ("s", "c.txt", b"# x"), ("s", "d.md", b"\xff\xfe"), ("s", "e.md", b"a\x00b"), ("s", "../f.md", b"x"), ("s", "/g.md", b"x"),
        ("s", "h.md", b""), ("s", "i.md", None), ("other", "a.md", b"# y"), ("s", "j.md", b"text\n===\n"), ("s", "k.md", b"```\n# no\n```\n"),
    ]
    files = spark.createDataFrame(rows, "source_id string, path string, content binary").repartition(3)
    a = adapters.TextAdapter("s", "v1", "en", (("zh-cn/", "zh-CN"), ("zh", "zh")))
    got = {r["path"]: r for r in adapters.normalized(files, [a]).collect()}
    assert len(got) == 11 and got["zh-cn/a.md"]["document_id"] == "s:zh-cn/a.md"
    assert [(p, got[p]["title"], got[p]["body"], list(got[p]["diagnostics"])) for p in ("zh-cn/a.md", "b.md", "c.txt", "d.md", "e.md", "../f.md", "/g.md", "h.md", "j.md", "k.md")] == [
        ("zh-cn/a.md", "Top", "# Top #\n## Sub\ntext", []), ("b.md", "Quoted", "## no title\n> # Quoted\n", []), ("c.txt", "c.txt", "# x", []), ("d.md", "d.md", None, ["not_utf8"]), ("e.md", "e.md", None, ["nul"]),
        ("../f.md", "f.md", None, ["unsafe_path"]), ("/g.md", "g.md", None, ["unsafe_path"]), ("h.md", "h.md", "", ["missing_h1_title"]), ("j.md", "text", "text\n===\n", []), ("k.md", "k.md", "```\n# no\n```\n", ["missing_h1_title"]),
    ]
    assert got["zh-cn/a.md"]["language"] == "zh-CN" and got["b.md"]["language"] == "en" and got["zh-cn/a.md"]["n_headings"] == 2
    with pytest.raises(ValueError):
        adapters.normalized(files, [a, a])
    assert adapters.normalized(files, []).count() == 0


def test_write_once(spark, tmp_path):
    df = spark.range(5)
    assert write_once(df, f"file://{tmp_path}/t").count() == 5 and write_once(df.orderBy(F.desc("id")), f"file://{tmp_path}/t").count() == 5
    with pytest.raises(SnapshotConflict):
        write_once(spark.range(6), f"file://{tmp_path}/t")
    spark.range(1).write.parquet(f"file://{tmp_path}/u/versions/index_version=only/entries")  # left by a run that broke off
    assert write_once(df, f"file://{tmp_path}/u").count() == 5


def test_caps_are_errors(spark):
    assert records.require_at_most(spark.range(3), 3, "rows").count() == 3
    with pytest.raises(ValueError, match="more than 2 rows"):
        records.require_at_most(spark.range(3), 2, "rows")


def test_keywords_by_one_automaton(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "A license, LICENSED @ home"), (2, ""), (3, None), (4, "nothing")], "doc_id int, text string")
    rules = spark.createDataFrame([("License", "legal"), ("licensed", "legal"), ("licensed", "more"), ("@", "mail"), ("", "all"), (None, "none"), ("İx", "odd")], "keyword string, target string")
    want = [(1, "legal"), (1, "mail"), (1, "more")]
    assert values(tagging.keyword_tags(texts, rules), "doc_id", "target") == want
    assert tagging.keyword_tags(texts, rules.limit(0)).count() == 0
    monkeypatch.setattr(retrieval, "MOST_KEYWORDS", 1)
    assert values(tagging.keyword_tags(texts, rules), "doc_id", "target") == want
    contexts = spark.createDataFrame([(1, "use load and Load")], "unit_id int, context string")
    words = spark.createDataFrame([(7, "Load"), (8, "load"), (9, "oad a")], "rule_id int, value string")
    assert values(retrieval.keyword_matches(contexts, words), "rule_id", "value") == [(7, "Load"), (8, "load"), (9, "oad a")]


def test_similarities_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(5)]
    q = [(i, vector()) for i in range(23)] + [(100, [0.0] * 5), (101, None), (102, [1.0]), (103, [1.0, None, 0.0, 0.0, 0.0])]
    x = [(i, vector()) for i in range(40)] + [(200, [0.0] * 5), (201, None), (202, [1.0] * 6)]
    frames = spark.createDataFrame(q, "unit_id int, vector array<double>"), spark.createDataFrame(x, "rule_id long, vector array<float>").repartition(3)
    length = lambda v: math.sqrt(sum(a * a for a in v))
    want = {(i, j): (0.0 if not length(a) * length(b) else sum(s * t for s, t in zip(a, b, strict=True)) / length(a) / length(b)) for i, a in q if a and None not in a and len(a) == 5 for j, b in x if b and len(b) == 5}
    for block in (16_384, 7):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        got = {(r["unit_id"], r["rule_id"]): r["similarity"] for r in retrieval.similarities(*frames).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 for k, v in want.items())
        near = {(r["unit_id"], r["rule_id"]) for r in retrieval.similarities(*frames, minimum=0.5).collect()}
        assert near == {k for k, v in got.items() if v >= 0.5}
    assert retrieval.similarities(frames[0].limit(0), frames[1]).count() == 0


def test_shingles_and_contamination(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices("abcde", k=rng.randint(0, 40)))) for i in range(60)] + [(60, None), (61, "")]
    docs, bench = spark.createDataFrame(texts, "doc_id int, text string").repartition(4), spark.createDataFrame([(t,) for _, t in texts[:3]] + [("a b c d",)], "text string")
    runs = lambda t: {tuple((t or "").split()[i : i + 4]) for i in range(len((t or "").split()) - 3)}
    got = docs.select("doc_id", near_duplicate.shingles(near_duplicate.tokens(F.col("text")), 4).alias("s")).collect()
    assert {r["doc_id"]: len(r["s"]) for r in got} == {i: len(runs(t)) for i, t in texts}
    whole = {}
    for r in got:  # equal runs have equal hashes, in any row
        for h in r["s"]:
            whole.setdefault(h, set()).add(r["doc_id"])
    every = set().union(*(runs(t) for _, t in texts))
    assert len(whole) == len(every) and sum(map(len, whole.values())) == sum(len(runs(t)) for _, t in texts)
    known = set().union(runs("a b c d"), *(runs(t) for _, t in texts[:3]))
    want = [(i, len(runs(t) & known)) for i, t in texts if runs(t) & known]
    assert values(near_duplicate.contaminated(docs, bench, 4), "doc_id", "n_shared") == want
    assert values(near_duplicate.contaminated(docs, bench, 4, most=1), "doc_id", "n_shared") == want
    assert near_duplicate.contaminated(docs, bench.limit(0), 4).count() == 0


def test_overlaps_count_an_atom_once(spark):
    side = lambda rows: spark.createDataFrame(rows, "id string, atom int")
    got = intervals.overlaps(side([("a", 1), ("a", 1), ("a", 2), ("b", 3)]), side([("x", 1), ("x", 1), ("x", 2), ("y", 2)])).collect()
    assert sorted((r["left_id"], r["right_id"], list(r["atoms"])) for r in got) == [("a", "x", [1, 2]), ("a", "y", [2])]
