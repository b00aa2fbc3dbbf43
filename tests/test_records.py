"""Missing votes, dangling edges, one-sided keys and the other cases that whole tables don't show."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import consensus, graph, near_duplicate, records


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_missing_vote_and_unknown_endpoint(spark):
    votes = spark.createDataFrame([("first", 1, "accept"), ("second", 1, "accept"), ("first", 2, "accept")], "round_name string, rule_id long, decision string")
    assert values(consensus.consensus(votes), "rule_id", "status") == [(1, "accepted"), (2, "unresolved")]
    edges = spark.createDataFrame([(1, 2, "x"), (1, 9, "x"), (2, 2, "x")], "src long, dst long, kind string")
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    assert values(graph.relation_problems(edges, nodes, ()), "src", "dst", "problem") == [(1, 9, "unknown_endpoint"), (2, 2, "self_edge")]


def test_sides_and_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "n"), (3, None), (5, "z")], "k int, v string")
    assert values(records.sides(a, b, ["k"], "v"), "k", "source_role") == [(1, "kept"), (2, "changed"), (3, "kept"), (4, "removed"), (5, "added")]
    assert values(records.set_mismatch(a, b, ["k"]), "k", "problem") == [(4, "not_expected"), (5, "not_declared")]
    assert records.set_mismatch(a, a, ["k", "v"]).count() == 0
    assert records.require_at_most(a, 4, "rows") is a
    with pytest.raises(ValueError):
        records.require_at_most(a, 3, "rows")


def test_shadows_and_policy(spark):
    calls = spark.createDataFrame([(1, "f", "a", 5), (2, "f", "a", 50), (3, "f", "b", 5), (4, None, "a", 5)], "call_id int, file string, alias string, line int")
    imports = spark.createDataFrame([("f", "a", "m.a")], "file string, alias string, canonical string")
    shadows = spark.createDataFrame([("f", "a", 1, 10), ("g", "a", 1, 99)], "file string, alias string, start int, end int")
    assert values(records.bound_calls(calls, imports, shadows), "call_id", "canonical") == [(2, "m.a")]
    policy = spark.createDataFrame([("f", "a"), ("f", "a")], "file string, alias string")
    assert values(records.export_decisions(calls, policy, ["file", "alias"]), "call_id", "allowed") == [(1, True), (2, True), (3, False), (4, False)]


def test_similar_pairs_keep_every_pair_that_is_not_clear(spark):
    import random

    rng = random.Random(3)
    base = [rng.randrange(10**6) for _ in range(60)]
    sets = [(i, sorted({*rng.sample(base, rng.randint(10, 60)), *(rng.randrange(10**6) for _ in range(rng.randint(0, 30)))})) for i in range(40)]
    df = spark.createDataFrame(sets, "id long, set array<long>")
    got = {(r["probe_id"], r["ref_id"]): r["shared"] for r in near_duplicate.decide(near_duplicate.similar_pairs(df)).where("decision <> 'clear'").collect()}
    all_pairs = near_duplicate.shared_counts(df, df).where("probe_id < ref_id")
    want = {(r["probe_id"], r["ref_id"]): r["shared"] for r in near_duplicate.decide(all_pairs).where("decision <> 'clear'").collect()}
    assert got == want and len(want) > 20


def test_screening_signals(spark):
    """Equal short streams, a long run beside few shared shingles, shape alone, too short, empty and null streams, copies and issues."""
    words = [f"w{i}" for i in range(400)]
    numbers = [str(i) for i in range(300)]
    half = [w for k in range(40) for w in (words[k], ",")]
    reference = [["a", "b", "c"], words[:100], [*half, *numbers[:40]], []]
    probes = [
        (1, ["a", "b", "c"], False), (2, ["a", "b", "d"], False), (3, [*words[:70], *words[200:240]], False), (4, [*words[:20], *words[200:270]], False), (11, [*words[:20], *words[200:280]], False),
        (5, [w for k in range(300, 340) for w in (words[k], ",")] + numbers[100:140], False), (6, [], False), (7, None, False), (8, words[:100], True), (9, words[:100], False), (9, words[:100], False),
        (10, ["a"] * 200, False),
    ]
    p = spark.createDataFrame(probes, "id long, tokens array<string>, issue boolean")
    r = spark.createDataFrame([(x,) for x in reference], "tokens array<string>")
    got = values(near_duplicate.screen(p, r), "id", "decision")
    want = {1: "duplicate", 2: "abstain", 3: "duplicate", 4: "clear", 11: "gray", 5: "gray", 6: "abstain", 7: "abstain", 8: "abstain", 9: "duplicate", 10: "abstain"}
    assert got == sorted((i, want[i]) for i, _, _ in probes)
    assert near_duplicate.screen(p.limit(0), r).count() == 0
    assert {d for _, d in values(near_duplicate.screen(p, r.limit(0)), "id", "decision")} == {"abstain", "clear"}


def test_run_with_repeated_shingles_is_found(spark):
    """A stream of one repeated word has a single shingle; its long run with another stream still counts."""
    p = spark.createDataFrame([(1, ["x"] * 80)], "id long, tokens array<string>")
    r = spark.createDataFrame([(["y"] * 30 + ["x"] * 70,)], "tokens array<string>")
    assert values(near_duplicate.screen(p, r), "decision") == [("duplicate",)]


def test_long_intervals_take_few_bins(spark):
    from lodestone.operators import intervals

    spans = [(1, 0, 10**12), (2, 5, 5), (3, -700, 63), (4, 9, 3), (5, 64, 200)]
    points = [(x,) for x in (-701, -700, 0, 5, 63, 64, 200, 201, 10**12, 10**12 + 1)]
    i = spark.createDataFrame([("f", *s) for s in spans], "f string, id int, start long, end long")
    p = spark.createDataFrame([("f", *x) for x in points], "f string, line long")
    got = values(intervals.containing(p, i, ["f"], "line"), "line", "id")
    assert got == sorted((x, s[0]) for (x,) in points for s in spans if s[1] <= x <= s[2])


def test_excerpts_and_observation(spark):
    lines = spark.createDataFrame([("d", n, f"t{n}") for n in range(1, 6)], "doc string, line int, text string")
    clauses = spark.createDataFrame([("d", "a", 1, 1), ("d", "b", 3, 4), ("d", "z", 50, 51)], "doc string, clause_id string, start int, end int")
    assert values(records.excerpts(lines, clauses, ["doc"], 1, 1), "clause_id", "start", "end", "excerpt") == [("a", 1, 2, "t1\nt2"), ("b", 2, 5, "t2\nt3\nt4\nt5")]
    truth = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (3, "x")], "case int, value string")
    seen = spark.createDataFrame([(1, "y"), (1, "z"), (2, "q"), (9, "x")], "case int, value string")
    got = {r["case"]: (r["found"], r["missing"], r["extra"]) for r in records.observed(truth, seen, "case").collect()}
    assert got == {1: (True, ["x"], ["z"]), 2: (True, [], ["q"]), 3: (False, ["x"], [])}


def test_unknown_applicability_ranks_after(spark):
    from lodestone.operators import retrieval

    schema = "unit_id int, rule_id int, rank int, score long, decision string, authority int"
    e = spark.createDataFrame([(1, 7, 1, 5, "unknown", 9), (2, 7, 1, 5, "unknown", 9), (2, 8, 1, 5, "applicable", 1), (2, 9, 1, 5, "applicable", 2)], schema)
    v = spark.createDataFrame([], "unit_id int, rule_id int, rank int, similarity double, decision string, authority int")
    assert values(retrieval.reciprocal_rank_fusion(e, v), "unit_id", "rank", "rule_id") == [(1, 1, 7), (2, 1, 9), (2, 2, 8), (2, 3, 7)]


def test_projection_is_verified_only_without_seal_problems(spark, tmp_path):
    from lodestone.sources import store as S

    store = S.SnapshotStore(spark, str(tmp_path))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    parts = {
        "atoms": frame([("a",), ("b",)], "atom_id string"), "bindings": frame([("x",)], "binding_id string"),
        "binding_atoms": frame([("x", "a")], "binding_id string, atom_id string"), "unclassified": frame([], "atom_id string"),
    }
    with pytest.raises(S.SnapshotConflict, match="not_classified: b"):
        S.publish_projection(store, parts)
    parts["unclassified"] = frame([("b",)], "atom_id string")
    version = S.publish_projection(store, parts)
    assert S.publish_projection(store, parts) == version
    assert [tuple(r) for r in S.load_projection(store, version)["binding_atoms"].collect()] == [("x", "a")]


def test_span_problems_and_media_types(spark):
    spans = spark.createDataFrame(
        [(1, 1, 2, "L1-L2"), (1, 2, 9, "L2-L9"), (1, 2, 1, "L2-L1"), (1, None, 1, "L1-L1"), (1, 1, 1, None), (2, 1, 1, "L1-L1"), (3, 1, 1, "L1-L1"), (None, 1, 1, "L1-L1")], "doc int, start int, end int, anchor string"
    )
    documents = spark.createDataFrame([(1, 3), (2, None)], "doc int, n_lines int")
    got = records.span_problems(spans, documents, ["doc"]).collect()
    want = [None, "out_of_range", "no_lines", "no_lines", "other_anchor", "out_of_range", "unknown_document", "unknown_document"]
    assert sorted(str(r["problem"]) for r in got) == sorted(map(str, want))
    typed = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "media_type string, n int")
    by_type = {"a": lambda df: df.select("n"), "b": lambda df: df.select((F.col("n") * 10).alias("n"))}
    assert sorted(r["n"] for r in records.extracted(typed, by_type).collect()) == [1, 3, 20]
    for other in ("c", None):
        with pytest.raises(ValueError, match="unsupported"):
            records.extracted(spark.createDataFrame([(other, 1)], "media_type string, n int"), by_type)


def test_rendered_documents(spark):
    titles = spark.createDataFrame([(1, "A & *b*"), (2, None)], "doc int, title string")
    entries = spark.createDataFrame([(1, "y", 2, "two|"), (1, "y", 1, None), (1, "x", 1, "<i>"), (1, "z", 1, "unknown"), (3, "x", 1, "no title")], "doc int, category string, ordinal int, title string")
    got = dict(map(tuple, records.rendered(titles, entries, "doc", {"x": "X", "y": "Y", "w": "W"}).collect()))
    assert got == {1: "# A &amp; \\*b\\*\n\n### X\n\n- &lt;i&gt;\n\n### Y\n\n- \n- two\\|\n", 2: "# \n"}


def test_screening_stores_only_what_a_reference_has(spark, monkeypatch):
    """Open pairs of an id that has other texts too, a null id and a repeated stream; lists of working tables hold no token of a probe and none of its other shingles."""
    words = [f"w{i}" for i in range(5000)]
    r = spark.createDataFrame([(words[:100],)], "tokens array<string>")
    probes = [(1, words[1000:4000]), (2, [*words[:70], *words[200:240]]), (2, words[300:340]), (None, [*words[:70], *words[200:240]]), (3, [*words[:66], *words[400:900]])]
    p = spark.createDataFrame(probes, "id long, tokens array<string>")
    tables = {}
    written = graph.written
    monkeypatch.setattr(graph, "written", lambda df, path: tables.setdefault(path.split("/")[-1], written(df, path)))
    got = sorted(map(str, near_duplicate.screen(p, r).collect()))
    want = [(1, 2994, "clear"), (2, 104, "duplicate"), (2, 34, "clear"), (3, 560, "duplicate"), (None, 104, "duplicate")]
    assert got == [f"Row(id={i}, n_shingles={n}, decision='{d}')" for i, n, d in want]
    assert "tokens" not in tables["probes"].columns
    held = tables["probes"].select(F.sum(F.size("content.met") + F.size("shape.met"))).first()[0]
    assert held <= sum(len(set(t) & set(words[:100])) for _, t in probes) + len(probes)
    monkeypatch.undo()
    assert sorted(map(str, near_duplicate.screen(p, r, most=0).collect())) == got
