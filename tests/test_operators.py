"""Hand-made cases for rules at their boundaries."""

import itertools
import random
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import stats
from lodestone.functions import text as X
from lodestone.operators import applicability, consensus, graph, intervals, metrics, near_duplicate, planning, retrieval, tagging
from lodestone.sources import readers
from lodestone.sources.store import SnapshotConflict, SnapshotStore, checksum


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def greedy(hits, wanted, budget, limit):
    """The choice by plain loops over ranked (rank, tokens, dimensions)."""
    chosen, spent = [], 0

    def add(h):
        nonlocal spent
        if h[0] in chosen or len(chosen) >= limit or spent + h[1] > budget:
            return False
        chosen.append(h[0])
        spent += h[1]
        return True

    for d in wanted:
        for h in hits:
            if d in h[2] and h[0] not in chosen and add(h):
                break
    for h in hits:
        add(h)
    return sorted(chosen)


def test_budget_selection_against_loops(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for u in range(25):
        hits = [(r, rng.randint(1, 60), rng.sample("abcd", rng.randint(0, 2))) for r in range(1, rng.randint(2, 20))]
        wanted, budget = sorted(rng.sample("abcd", 2)), rng.randint(20, 200)
        expected[u] = greedy(hits, wanted, budget, 5)
        rows += [(u, f"r{r}", r, t, d, wanted, budget) for r, t, d in hits]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "unit_id int, rule_id string, rank int, tokens int, dimensions array<string>, wanted array<string>, budget int")
    got = retrieval.budget_selection(df, limit=5).where("status = 'selected'").collect()
    for u in expected:
        assert sorted(r["rank"] for r in got if r["unit_id"] == u) == expected[u]
        assert [r["position"] for r in sorted((r for r in got if r["unit_id"] == u), key=lambda r: r["rank"])] == list(range(1, len(expected[u]) + 1))


def test_budget_met_exactly(spark):
    df = spark.createDataFrame([(1, "a", 1, 60, [], [], 100), (1, "b", 2, 50, [], [], 100), (1, "c", 3, 40, [], [], 100)], "unit_id int, rule_id string, rank int, tokens int, dimensions array<string>, wanted array<string>, budget int")
    assert values(retrieval.budget_selection(df), "rule_id", "status") == [("a", "selected"), ("b", "token_budget"), ("c", "selected")]


def test_first_fit(spark):
    df = spark.createDataFrame([(1, i, i, t, 10) for i, t in enumerate([6, 5, 4, 11, 5, 1])], "group_id int, item_id int, seq int, tokens int, capacity int")
    assert values(planning.first_fit_bins(df), "item_id", "bin") == [(0, 0), (1, 1), (2, 0), (3, -1), (4, 1), (5, 2)]


def test_ties_are_broken_by_authority_then_id(spark):
    df = spark.createDataFrame([(1, "b", 2, 90, 40), (1, "a", 2, 90, 40), (1, "c", 2, 90, 80), (1, "d", 3, 90, 10)], "unit_id int, rule_id string, n_matches long, score long, authority int")
    assert [r["rule_id"] for r in retrieval.exact_ranking(df).orderBy("rank").collect()] == ["d", "c", "a", "b"]


def test_cosine_of_zero_and_the_minimum(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "unit_id int, vector array<float>")
    i = spark.createDataFrame([("zero", [0.0, 0.0]), ("edge", [0.3, 0.9539392014169457]), ("low", [0.29, 0.957])], "rule_id string, vector array<double>")
    pairs = retrieval.similarities(q, i)
    assert dict(values(pairs, "rule_id", "similarity"))["zero"] == 0.0
    assert [r["rule_id"] for r in retrieval.vector_ranking(pairs).collect()] == ["edge"]


def test_aliases_with_two_names_stay(spark):
    s = spark.createDataFrame([(1, "api", "a"), (1, "api", "b"), (1, "tag", "a"), (1, "api", "c")], "unit_id int, kind string, value string")
    a = spark.createDataFrame([("a", "A"), ("b", "B1"), ("b", "B2"), ("a", "A")], "alias string, canonical string")
    assert values(retrieval.resolve_aliases(s, a), "kind", "value") == [("api", "A"), ("api", "b"), ("api", "c"), ("tag", "a")]


def test_hint_tags_and_keywords(spark):
    e = spark.createDataFrame([(1, "x")], "unit_id int, value string")
    r = spark.createDataFrame([(1, "x"), (1, "y")], "unit_id int, value string")
    assert values(retrieval.hint_only(e, r), "value") == [("y",)]
    k = spark.createDataFrame([(1, ""), (2, "ABC")], "rule_id int, value string")
    c = spark.createDataFrame([(7, "xxabcxx")], "unit_id int, context string")
    assert values(retrieval.keyword_matches(c, k), "rule_id") == [(2,)]


def test_excluded_outweighs_unknown(spark):
    schema = "min_level int, max_level int, releases array<string>, modes array<string>, permissions array<string>, capabilities array<string>, t_level int, t_release string, t_mode string, t_permissions array<string>, t_capabilities array<string>"
    rows = [(5, None, ["r"], None, None, None, 4, None, None, None, None), (5, 9, None, [], ["p"], ["c"], None, None, None, [], None), (None, None, None, None, None, None, None, None, None, None, None), (1, 9, ["r"], ["m"], ["p"], ["c"], 9, "r", "m", ["p", "q"], ["c"])]
    got = applicability.evaluate(spark.createDataFrame(rows, schema)).select("decision", "reasons").collect()
    assert [(r[0], list(r[1])) for r in got] == [
        ("excluded", ["api_level_below_minimum"]), ("excluded", ["permission_missing"]), ("applicable", []), ("applicable", []),
    ]


def test_pool_fusion_rounds_each_share(spark):
    rows = [(1, p, "x", 3, 1.0) for p in retrieval.POOLS]
    got = {r["arm"]: r["rrf_score"] for r in retrieval.pool_fusion(spark.createDataFrame(rows, "unit_id int, pool string, rule_id string, pool_rank int, path_score double")).collect()}
    share = lambda w: round(w / 63, 8)
    assert got["hybrid"] == round(sum(share(w) for _, w in retrieval.POOLS.values()), 8)
    assert got["static_vector"] == round(sum(share(w) for p, (_, w) in retrieval.POOLS.items() if p != "ai_inferred"), 8)


def test_coverage_and_diagnostics(spark):
    df = spark.createDataFrame([(1, ["a"], ["a", "b"]), (1, ["c"], ["a", "b"])], "unit_id int, dimensions array<string>, wanted array<string>")
    assert values(retrieval.coverage(df), "covered", "uncovered") == [(["a"], ["b"])]
    d = spark.createDataFrame([(1, True, False, True)], "unit_id int, blocked boolean, unknown boolean, empty boolean")
    assert values(retrieval.diagnostics(d), "codes") == [(["no_evidence", "retrieval_blocked"],)]


def test_embed_uses_one_provider_a_task(spark):
    got = retrieval.embed(spark.createDataFrame([("ab",), (None,)], "text string"), lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert values(got, "vector") == [([0.0, 1.0],), ([2.0, 1.0],)]


def test_zero_denominators(spark):
    one = spark.range(1).select(
        stats.ratio(F.lit(0), F.lit(0)).alias("a"), stats.ratio_or_zero(F.lit(0), F.lit(0)).alias("b"), stats.ratio_or_perfect(F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("c"),
        stats.ratio_or_perfect(F.lit(0), F.lit(2), F.lit(0), F.lit(0)).alias("d"), stats.ppm(F.lit(0.0000125)).alias("e"), stats.kappa(F.lit(4), F.lit(4), F.lit(16)).alias("f"),
    )
    assert tuple(one.first()) == (None, 0.0, 1.0, 0.0, 12, None)


def test_ranking_metrics_of_misses(spark):
    ranked = spark.createDataFrame([("x", 1, "a", 1), ("x", 1, "b", 2), ("x", 2, "a", 1)], "arm string, unit_id int, rule_id string, rank int")
    truth = spark.createDataFrame([(1, "b"), (3, "z")], "unit_id int, rule_id string")
    got = {(r["unit_id"], r["k"]): (r["recall"], r["precision"], r["reciprocal_rank"]) for r in metrics.ranking_metrics(ranked, truth, (1, 3)).collect()}
    assert got[1, 1] == (0.0, 0.0, 0.5) and got[1, 3] == (1.0, 0.5, 0.5)
    assert got[2, 1] == (None, 0.0, None) and got[3, 3] == (0.0, None, 0.0)


def test_consensus_cases(spark):
    rows = [("first", 1, "accept"), ("second", 1, "accept"), ("first", 2, "reject"), ("second", 2, "reject"), ("first", 3, "accept"), ("second", 3, "accept_with_corrections"), ("first", 4, "accept"), ("second", 4, "reject"), ("first", 5, "accept")]
    got = dict(values(consensus.consensus(spark.createDataFrame(rows, "round_name string, rule_id int, decision string")), "rule_id", "status"))
    assert got == {1: "accepted", 2: "rejected", 3: "correction_draft", 4: "unresolved", 5: "unresolved"}


def test_conflicting_payloads(spark):
    one, bad = consensus.unique_by(spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "k string, p string"), "k", "p")
    assert values(one, "k") == [("a",)] and values(bad, "k") == [("b",)]


def test_innermost_keeps_equal_intervals(spark):
    p = spark.createDataFrame([(1, 5), (1, 50), (1, 200)], "f int, line int")
    i = spark.createDataFrame([(1, "o", 1, 100), (1, "a", 4, 6), (1, "b", 4, 6), (1, "c", 5, 60)], "f int, id string, start int, end int")
    got = intervals.innermost(intervals.containing(p, i, ["f"], "line", width=16), ["f", "line"])
    assert values(got, "line", "id") == [(5, "a"), (5, "b"), (5, "c"), (50, "c")]


def test_components_chain_and_closure_with_a_cycle(spark):
    v = spark.range(40)
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 30) if i != 20] + [(35, 35)], "src long, dst long")
    got = dict(values(graph.connected_components(v, e), "id", "component"))
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(21, 31)} == {21} and got[35] == 35
    c = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent int, child int")
    assert values(graph.descendants(spark.createDataFrame([(1,), (4,)], "id int"), c), "root", "id") == [(1, 1), (1, 2), (1, 3), (1, 4), (4, 4)]


def test_evidence_edges(spark):
    e = spark.createDataFrame([("strong", "exact", "calls"), ("weak", "exact", "calls"), ("strong", "guess", "calls"), ("strong", "exact", "same_file")], "strength string, quality string, relation_type string")
    assert graph.evidence_edges(e).count() == 1


def test_near_duplicate_boundaries(spark):
    pairs = spark.createDataFrame([(1, 32, 40, 40), (2, 31, 40, 40), (3, 16, 26, 26), (4, 15, 20, 20), (5, 32, 39, 39)], "id int, shared int, n_probe int, n_ref int")
    got = dict(values(near_duplicate.decide(pairs), "id", "decision"))
    assert got == {1: "duplicate", 2: "gray", 3: "gray", 4: "clear", 5: "duplicate"}


def test_longest_run_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
        runs = [n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if any(a[i : i + n] == b[j : j + n] for j in range(len(b) - n + 1))]
        assert near_duplicate.longest_run(a, b) == max(runs, default=0)


def test_axis_decisions(spark):
    probes = spark.createDataFrame([(1, True, False, 99), (2, False, False, 10), (3, False, True, 99), (4, False, False, 99), (5, False, False, 5)], "probe_id int, issue boolean, incomplete boolean, n_shingles int")
    found = spark.createDataFrame([(1, "duplicate"), (5, "gray")], "probe_id int, decision string")
    assert dict(values(near_duplicate.axis_decision(found, probes), "probe_id", "decision")) == {1: "abstain", 2: "abstain", 3: "abstain", 4: "clear", 5: "gray"}


def test_text_functions(spark):
    df = spark.createDataFrame([("a😀é",), ("",)], "t string")
    assert values(df.select(X.knowledge_tokens(F.col("t")).alias("k"), X.utf16_length(F.col("t")).alias("u")), "k", "u") == [(1, 0), (3, 4)]
    pieces = spark.createDataFrame([("One! Two。三\nfour; x!y",)], "t string").select(X.sentence_pieces(F.col("t")).alias("p")).first()["p"]
    assert "".join(pieces) == "One! Two。三\nfour; x!y" and pieces[:3] == ["One! ", "Two。", "三\n"]
    assert X.glob_regex("a/**/b?.*") == r"^a/(?:.*/)?b[^/]\.[^/]*$"
    ids = [spark.createDataFrame([(1, None)], "b int, a string").select(X.canonical_identity("x", {"b": F.col("b"), "a": F.col("a")}).alias("i")).first()["i"]]
    import hashlib

    assert ids == ["x:sha256:" + hashlib.sha256(b'{"a":null,"b":1}').hexdigest()]


@pytest.mark.parametrize("n,k", list(itertools.product(range(0, 12), (1, 5))))
def test_evenly_chosen(spark, n, k):
    got = spark.range(1).select(retrieval.evenly_chosen(F.lit(n), F.lit(k)).alias("p")).first()["p"]
    assert got == (list(range(n)) if n <= k else [round(i * (n - 1) / max(k - 1, 1)) for i in range(k)])


def test_tag_triggers(spark):
    facts = spark.createDataFrame([(1, "unit_exact", "symbol", "a.b.load"), (1, "file_hint", "symbol", "load"), (2, "unit_exact", "path", "src/x.ets")], "unit_id int, scope string, kind string, value string")
    rules = spark.createDataFrame([("t1", "Active", "leaf", "symbol", "load"), ("t2", "Draft", "suffix", "path", ".ets"), ("t3", "Active", "exact", "symbol", "load")], "tag_id string, status string, trigger string, on_kind string, value string")
    got = {r["unit_id"]: (list(r["exact_tags"]), list(r["routing_tags"]), list(r["shadow_tags"])) for r in tagging.unit_tags(tagging.match_tags(facts, rules)).collect()}
    assert got == {1: (["t1"], ["t1", "t3"], []), 2: ([], [], ["t2"])}


def _fails(call):
    try:
        call()
    except SnapshotConflict:
        return True
    return False


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    a, b = spark.range(5).withColumn("x", F.col("id") * 2), spark.range(6).withColumn("x", F.col("id") * 2)
    v = store.publish(a)
    assert store.publish(a.repartition(3)) == v and store.load(v).count() == 5
    with pytest.raises(SnapshotConflict):
        store.publish(b, version=v)
    w = store.publish(b)
    store.switch_alias("live", v)
    store.switch_alias("live", w)
    assert store.resolve_alias("live") == w and store.load_alias("live").count() == 6 and store.resolve_alias("other") is None
    with pytest.raises(SnapshotConflict):
        store.switch_alias("live", "nothing")
    with pytest.raises(SnapshotConflict):
        store.switch_alias("live", v, origin="trial")
    with pytest.raises(SnapshotConflict, match="points to"):
        store.switch_alias("live", v, expected=v)
    assert store.switch_alias("live", v, expected=w) == 3 and store.resolve_alias("live") == v
    (tmp_path / "store/aliases").joinpath(store._folder("live").rsplit("/", 1)[1], "000000000004.json").write_text("")  # a writer that died
    assert store.resolve_alias("live") == v and store.switch_alias("live", w, expected=v) == 5
    with ThreadPoolExecutor(4) as pool:  # each of several writers gets a number of its own
        turns = list(pool.map(lambda k: store.switch_alias("busy", (v, w)[k % 2]), range(8)))
    assert sorted(turns) == list(range(1, 9)) and store.resolve_alias("busy") == (v, w)[turns.index(8) % 2]
    with ThreadPoolExecutor(4) as pool:  # of those that expect the same version, one wins
        won = list(pool.map(lambda k: not _fails(lambda: store.switch_alias("live", v, expected=w)), range(4)))
    assert sum(won) == 1
    assert checksum(a) != checksum(a.withColumn("x", F.col("x") + 1)) and checksum(a.union(a)) != checksum(a) and checksum(a.limit(0))[0] == 0
    store.load(v).limit(1).write.mode("append").parquet(f"file://{tmp_path}/store/versions/index_version={w}/entries")
    with pytest.raises(SnapshotConflict):
        store.load(w)


def test_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("text")
    (tmp_path / "d/b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "d/c.md").write_text("x" * 50)
    (tmp_path / "d/e.bin").write_text("no")
    got = readers.texts(readers.file_tree(spark, str(tmp_path)), ["**/*.md"], ["**/z*"], 20)
    assert values(got.fillna("-"), "path", "text", "issue") == [("d/a.md", "text", "-"), ("d/b.md", "-", "not_utf8"), ("d/c.md", "-", "too_large")]
    found, problems = readers.discovery(spark.createDataFrame([("d/a.md",), ("d/q.md",), ("d/e.bin",)], "path string"), readers.file_tree(spark, str(tmp_path)), ["**/*.md"], [])
    assert values(found, "path") == [("d/a.md",)] and values(problems, "path", "reason") == [("d/e.bin", "not_allowed"), ("d/q.md", "missing")]
    lines = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":1,"a":2,"b":"x"}',), ('{"a":1,"b":"x","c":0}',), ('{"a":1}',), ("{",), (None,)], "value string")
    records = readers.strict_records(lines, "a int, b string")
    assert [r["problem"] for r in records.collect()] == [None, "duplicate_key", "unknown_key", "missing_key", "not_json", "not_json"]
    cases = {
        '[["a",1],["b","x"]]': "not_object", "3": "not_object", '{"a":NaN,"b":"x"}': "not_json", '{"a":1.5,"b":"x"}': "wrong_type", '{"a":true,"b":"x"}': "wrong_type", '{"a":"1","b":"x"}': "wrong_type",
        '{"a":1,"b":2}': "wrong_type", '{"a":2147483648,"b":"x"}': "wrong_type", '{"a":null,"b":"x"}': None, '{"a":1,"b":{"x":1,"x":2}}': "wrong_type", '{"a":-2147483648,"b":""}': None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "value string")
    assert {r["value"]: r["problem"] for r in readers.strict_records(df, "a int, b string").collect()} == cases
    nested = {'{"o":{"x":1,"x":2},"l":[1]}': "duplicate_key", '{"o":{"x":1},"l":[1,"a"]}': "wrong_type", '{"o":{"y":1},"l":[]}': "unknown_key", '{"o":{},"l":[]}': "missing_key", '{"o":{"x":1e3},"l":[1,null]}': None, '{"o":{"x":1e999},"l":[]}': "wrong_type", '{"o":[1],"l":[]}': "wrong_type", '{"o":null,"l":{}}': "wrong_type"}
    df = spark.createDataFrame([(k,) for k in nested], "value string")
    got = readers.strict_records(df, "o struct<x: double>, l array<long>").collect()
    assert {r["value"]: r["problem"] for r in got} == nested and {r["record"]["o"]["x"] for r in got if r["problem"] is None} == {1000.0}
    h = readers.hunks(spark.createDataFrame([("3:4",), ("x",)], "hunk string"))
    assert [(r["start"], r["count"]) for r in h.collect()] == [(3, 4), (None, None)]


def plain_pieces(text, most):
    """Sentence pieces by walking over the characters, then cut to a bound."""
    pieces, start, i = [], 0, 0
    while i < len(text):
        c, j = text[i], i + 1
        while j < len(text) and text[j] in X.CLOSING:
            j += 1
        ends = c == "\n" or c in "。！？；" or (c in "!?;" and (j == len(text) or text[j].isspace()))
        if not ends:
            i += 1
            continue
        i = i + 1 if c == "\n" else j
        while i < len(text) and text[i].isspace():
            i += 1
        pieces.append(text[start:i])
        start = i
    pieces.append(text[start:])
    out = []
    for p in filter(None, pieces):
        while len(p) > most:
            cut = next((k for k in range(most, most // 2, -1) if p[k - 1] in X.SOFT), most)
            out.append(p[:cut])
            p = p[cut:]
        out.append(p)
    return out


def test_sentence_pieces_against_a_loop(spark):
    rng = random.Random(5)
    texts = ["a;b &amp; c?d=1", "One! Two。三\nfour; x!y", "he said “no!” then) 》left!》 x", "", "!", "x。\n)y", "a!!  b", "w " * 700, "x" * 2000, "a;" * 500 + " b"]
    texts += ["".join(rng.choices(list("ab!?;。；\n 　 ,)》\"'"), k=rng.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", X.sentence_pieces(F.col("t")).alias("p"), X.bounded_pieces(X.sentence_pieces(F.col("t")), 10).alias("b"), X.bounded_pieces(X.sentence_pieces(F.col("t"))).alias("l")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["p"] == plain_pieces(t, 10**9) and got[i]["b"] == plain_pieces(t, 10) and got[i]["l"] == plain_pieces(t, 800), t
        assert "".join(got[i]["b"]) == t


def test_first_fit_against_a_scan():
    rng = random.Random(8)
    for _ in range(300):
        capacity, bins = rng.randint(1, 30), []
        tree = planning.FirstFit(capacity)
        for _ in range(rng.randint(0, 60)):
            size = rng.randint(0, 32)
            at = next((i for i, u in enumerate(bins) if u + size <= capacity), len(bins)) if size <= capacity else None
            if at is not None:
                bins += [0] * (at == len(bins))
                bins[at] += size
            assert tree.put(size) == at


def plain_plan(groups, questions, candidates, budget):
    """One question after the other, one candidate after the other."""
    decisions, bundles = set(), set()
    for g, primary, blocked in groups:
        for _, q in [x for x in questions if x[0] == g]:
            spent, missing, helpful, degraded = 0, False, [], False
            for c, _, tokens, need, relation, quality in sorted([x[2:] for x in candidates if x[:2] == (g, q)], key=lambda x: (x[1], x[0])):
                bad = "distractor_rejected" if need == "distractor" or relation in planning.NOT_EVIDENCE else "relation_degraded" if quality != "exact" else "context_blocked" if blocked else "budget_exceeded" if primary > budget else None
                degraded |= bad == "relation_degraded"
                if not bad and need == "required" and primary + spent + tokens > budget:
                    bad = "budget_exceeded"
                if bad:
                    missing |= need == "required"
                    decisions.add((g, q, c, "omitted", bad, None))
                elif need == "required":
                    spent += tokens
                    decisions.add((g, q, c, "selected", "required_context", None))
                else:
                    helpful.append((c, tokens))
            used = [0]
            for c, tokens in helpful:
                at = None if missing or tokens > budget - primary - spent else next((i for i, u in enumerate(used) if u + tokens <= budget - primary - spent), len(used))
                decisions.add((g, q, c, "omitted", "context_blocked" if missing else "budget_exceeded", None) if at is None else (g, q, c, "selected", "helpful_context", at))
                if at is not None:
                    used += [0] * (at == len(used))
                    used[at] += tokens
            poor = missing or blocked or primary > budget
            issues = ",".join(n for n, on in (("context_insufficient", poor), ("primary_exceeds_budget", primary > budget), ("relation_degraded", degraded)) if on)
            bundles |= {(g, q, i, spent + u, primary + spent + u, not poor, issues) for i, u in enumerate(used)}
    return decisions, bundles


def test_context_plan_against_a_loop(spark):
    rng = random.Random(4)
    groups = [(g, rng.choice([0, 40, 100, 101, 20]), g % 7 == 3) for g in range(25)]
    questions = [(g, q) for g in range(25) for q in ("a", "b")] + [(99, "a")]
    candidates = [
        (rng.randrange(27), rng.choice("ab"), c, rng.randrange(5), rng.choice([0, 5, 30, 31, 60, 120]), rng.choice(["required", "helpful", "helpful", "helpful", "distractor"]), rng.choice(["call", "call", "call", "same_host"]), rng.choice(["exact"] * 9 + ["partial", None]))
        for c in range(400)
    ]
    frames = [spark.createDataFrame(r, s).repartition(3) for r, s in ((groups, "group_id int, primary_tokens int, blocked boolean"), (questions, "group_id int, question_id string"), (candidates, "group_id int, question_id string, candidate_id int, seq int, tokens int, necessity string, relation_type string, quality string"))]
    decisions, bundles = planning.context_plan(*frames, 100)
    want = plain_plan(groups, questions, candidates, 100)
    assert {tuple(r) for r in decisions.collect()} == want[0] and decisions.count() == len(want[0])
    assert {tuple(r) for r in bundles.collect()} == want[1] and bundles.count() == len(want[1])


@pytest.mark.parametrize("seed", range(3))
def test_distinct_picks_against_a_loop(spark, seed):
    rng = random.Random(seed)
    members = [(f"f{rng.randrange(30)}", f"m{rng.randrange(25):02d}") for _ in range(120)] + [(None, "m01"), ("f1", None)]
    sets = {}
    for f, m in members:
        if f and m:
            sets.setdefault(f, set()).add(m)
    used, want = set(), {}
    for f in sorted(sets, key=lambda x: (len(sets[x]), x)):
        free = sorted(sets[f] - used)
        if free:
            want[f] = free[0]
            used.add(free[0])
    got = planning.distinct_picks(spark.createDataFrame(members, "family string, member string"), graph.work_folder(spark))
    assert dict(values(got, "family", "pick")) == want
    assert planning.distinct_picks(spark.createDataFrame([], "family string, member string"), graph.work_folder(spark)).count() == 0


def test_folds_keep_a_key_together_behind_a_join_that_turns_into_a_broadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "100000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.range(0, 4000, 1, 4).select((F.col("id") % 50).alias("g"), F.col("id").alias("seq"))
        right = spark.range(200_000).where("id < 50").groupBy(F.col("id").alias("g")).agg(F.count("*").alias("n"))
        joined = left.join(right, "g", "left")

        def step():
            seen = []
            return lambda row: seen.append(row["seq"]) or len(seen) - 1

        found = planning.folded(joined, ["g"], ["seq"], step, "at").collect()
        assert len(found) == 4000 and all(r["at"] == r["seq"] // 50 for r in found)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nearest_records_of_a_task_are_enough(spark, monkeypatch):
    """Ties, NaN, zero vectors and a unit's own id: the same first records as from all pairs, and no more than a task's share."""
    monkeypatch.setattr(retrieval, "PRODUCTS", 50)  # many small products, and buffers that are cut often
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(300)] + [(300, [float("nan")] * 3), (301, [0.0] * 3)]
    index = spark.createDataFrame(rows, "rule_id long, vector array<double>").repartition(3)
    queries = index.where("rule_id % 20 = 0").select(F.col("rule_id").alias("unit_id"), "vector")
    order = [F.desc("similarity"), F.asc("rule_id")]
    for minimum in (None, 0.3):
        every = retrieval.similarities(queries, index, minimum).where("unit_id <> rule_id")
        few = retrieval.similarities(queries, index, minimum, 7)
        assert few.where("unit_id = rule_id").isEmpty() and few.count() <= 16 * 7 * 3
        assert sorted(map(str, retrieval.ranked(few, order, 7).collect())) == sorted(map(str, retrieval.ranked(every, order, 7).collect()))


def test_judged_metrics_need_no_list_of_the_truth(spark):
    ranked = spark.createDataFrame([("a", 1, 10, 1), ("a", 1, 11, 2), ("a", 2, 10, 9), ("b", 1, 12, 1)], "arm string, unit_id int, rule_id int, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 13), (2, 10), (3, 10)], "unit_id int, rule_id int")
    hit = F.when(F.expr("(unit_id, rule_id) in ((1, 11), (2, 10))"), True)
    n = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "unit_id int, relevant long")
    assert sorted(map(str, metrics.ranking_metrics(ranked, truth).collect())) == sorted(map(str, metrics.judged_metrics(ranked.withColumn("hit", hit), n).collect()))


def test_only_records_that_can_be_first_are_paired(spark, tmp_path):
    """200 records of one label: the first five of each unit come from six records of each last digit."""
    from lodestone.plans import retrieval_queries as Q

    spark.range(200).selectExpr("id AS vec_id", "array(1.0F, 0.0F) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    few, every = Q._labelled(spark, tmp_path, Q.DIGIT, limit=5), Q._labelled(spark, tmp_path)
    assert every.count() == 4 * 199 and few.count() <= 4 * 60
    assert sorted(map(str, retrieval.exact_ranking(few, 5).collect())) == sorted(map(str, retrieval.exact_ranking(every, 5).collect()))


def test_units_of_one_label_stay_in_several_tasks(spark, tmp_path):
    from lodestone.plans import retrieval_queries as Q

    spark.range(0, 400, 1, 4).selectExpr("id AS vec_id", "array(1.0F, 0.0F) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        few = Q._labelled(spark, tmp_path, Q.DIGIT, limit=5)
        assert few.select(F.spark_partition_id().alias("task")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_integrity_is_checked_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    """Repeated keys on both sides, and as many tasks as rows need, however few bytes they are."""
    from lodestone import session
    from lodestone.plans import structure_queries as Q

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    spark.sql("SELECT id % 100 AS o_orderkey, id % 7 AS o_custkey FROM range(150)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 50 + id % 60 AS l_orderkey FROM range(730)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS c_custkey FROM range(1, 10)").write.parquet(f"{tmp_path}/customer.parquet")
    found = Q.integrity_anti_joins(spark, tmp_path)
    want = [(k % 100, "order_without_items") for k in range(150) if k % 100 < 50] + [(k, "item_without_order") for k in range(100, 110)]
    want += [(k % 100, "order_without_customer") for k in range(0, 150, 7)] + [(k, "customer_without_orders") for k in (7, 8, 9)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert ", 8), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_units_of_one_file_are_dealt_to_tasks_that_suit_their_pairs(spark, tmp_path, monkeypatch):
    """400 vectors of one file and one label: 8 units that meet 60 records each, so 480 pairs, with themselves."""
    from lodestone import session
    from lodestone.plans import retrieval_queries as Q

    spark.range(0, 400, 1, 1).selectExpr("id AS vec_id", "array(1.0F, 0.0F) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    task = F.spark_partition_id().alias("task")
    assert Q._labelled(spark, tmp_path, Q.DIGIT, limit=5).select(task).distinct().count() > 1
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    few = Q._labelled(spark, tmp_path, Q.DIGIT, limit=5)
    assert few.rdd.getNumPartitions() == 8 * 60 // 20
    assert few.select("unit_id", task).distinct().count() == 8
    every = Q._labelled(spark, tmp_path)
    assert sorted(map(str, retrieval.exact_ranking(few, 5).collect())) == sorted(map(str, retrieval.exact_ranking(every, 5).collect()))


def test_few_signals_and_few_intervals_go_to_their_many_records_and_points(spark):
    """One key that nearly all rows have must not be one task: the small side is broadcast, whatever Spark thinks of its size."""
    from lodestone.plans import structure_queries as Q

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        units = spark.createDataFrame([(1, "tag", "x0"), (2, "tag", "x0")], "unit_id int, kind string, value string")
        records = spark.range(1000).select(F.col("id").alias("rule_id"), F.lit("tag").alias("kind"), F.concat(F.lit("x"), (F.col("id") % 1).cast("string")).alias("value"))
        found = retrieval.signal_matches(units, records)
        assert found.count() == 2000
        for df in (found, Q.innermost_interval(spark, "/root/testdata/sf0.001")):
            assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shingles_of_texts_are_those_of_their_words():
    """Words end at blanks, tabs, line ends and at their text; long and foreign ones too, in slices of a column."""
    texts = ["", "a b c", " a\tb\r\nc  ", "a b c a b c", "ab c", "é" * 9 + " 12345678 123456789 " + "x" * 300 + " y", "x" * 300 + " y z", "123456781234567812345678 a b", "y", "z " * 40]
    column = pa.array([None, *texts])
    words = [t.split() for t in texts]
    hashes, sizes = near_duplicate.word_hashes(column.slice(1))
    assert sizes.tolist() == [len(w) for w in words]
    every = [x for w in words for x in w]
    assert len(set(zip(every, hashes.tolist(), strict=True))) == len(set(every)) == len(set(hashes.tolist()))
    for width in (1, 3, 7):
        runs = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in words]
        found = near_duplicate.text_shingles(column.slice(1), width).to_pylist()
        assert [len(f) for f in found] == [len(r) for r in runs]
        for i in range(len(texts)):
            for j in range(i):
                assert len(set(found[i]) & set(found[j])) == len(runs[i] & runs[j])
    assert near_duplicate.text_shingles(column.slice(0, 2), 3).to_pylist() == [[], []]


def test_sets_are_counted_once_and_elements_dealt_once(spark):
    """Pairs of a planted corpus are all found; the plan intersects each pair once and deals the elements once."""
    rows = [(i, list(range(i // 3 * 100, i // 3 * 100 + 40 + i % 3 * 5)) + list(range(-20, 0))) for i in range(12)]
    found = near_duplicate.decide(near_duplicate.similar_pairs(spark.createDataFrame(rows, "id int, set array<bigint>"))).where("decision <> 'clear'")
    want = {(i, j) for i in range(12) for j in range(i + 1, 12) if 5 * (s := len(set(rows[i][1]) & set(rows[j][1]))) >= 3 * min(len(rows[i][1]), len(rows[j][1])) and s >= 16}
    got = {(r["probe_id"], r["ref_id"]): r for r in found.collect()}
    assert set(got) == want
    assert all(r["shared"] == len(set(rows[i][1]) & set(rows[j][1])) and (r["n_probe"], r["n_ref"]) == (len(rows[i][1]), len(rows[j][1])) for (i, j), r in got.items())
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["cosine_topk", "min_similarity_filter", "rrf_fusion", "weighted_pool_rrf", "retrieval_with_failures", "ranking_metrics_at_k", "arm_rollup", "embedding_candidate"])
def test_rows_without_an_embedding_are_units_and_records(spark, tmp_path, name):
    """As the SQL has them: with a similarity of 0, and in the exact ranking of their label."""
    from lodestone.plans import catalog

    from .oracle import TABLES, compare

    for t in set(TABLES) - {"embeddings"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    vector = "transform(sequence(1, 64), k -> cast(sin((id + 1) * k) AS float))"
    spark.range(150).selectExpr("id AS vec_id", f"if(id % 7 IN (1, 2), null, {vector}) AS embedding", "cast(id % 4 AS int) AS label").coalesce(1).write.parquet(f"{tmp_path}/e")
    (tmp_path / "embeddings.parquet").symlink_to(next((tmp_path / "e").glob("*.parquet")))
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path))
    assert name != "ranking_metrics_at_k" or catalog.QUERIES[name](spark, str(tmp_path)).where("unit_id = 50").count() == 8


def test_a_table_without_embeddings_has_similarities_of_0(spark, tmp_path):
    from lodestone.plans import retrieval_queries as Q

    spark.range(60).selectExpr("id AS vec_id", "cast(null AS array<float>) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {(r["unit_id"], r["similarity"]) for r in Q.cosine_topk(spark, tmp_path).collect()} == {(0, 0.0), (50, 0.0)}
