"""Exact, near and substring dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import exact_dedup, near_dedup, substring_dedup
from lodestone.llm.components import components
from lodestone.llm.scratch import Scratch

from .cases import documents, empty, key


def test_fingerprints_compose():
    rng = random.Random(2)
    raw = bytes(rng.randrange(256) for _ in range(1000))
    whole = exact_dedup.chunk_value(raw, 0)
    for size in (1, 7, 64, 999, 1000):
        parts = [(raw[i : i + size], len(raw) - min(len(raw), i + size)) for i in range(0, len(raw), size)]
        total = [sum(exact_dedup.chunk_value(c, n)[k] for c, n in parts) % p for k, p in enumerate(exact_dedup.PRIMES)]
        assert tuple(total) == whole


@pytest.mark.parametrize("chunk", [16, exact_dedup.CHUNK_BYTES])
def test_exact_against_brute_force(spark, chunk):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[t] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs, chunk_bytes=chunk).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted(groups)


def test_exact_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "fingerprints", _colliding(exact_dedup.fingerprints))
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "cc"), (5, "bb"), (6, "aa")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {1: (6, 3, False), 3: (6, 3, False), 6: (6, 3, True), 2: (5, 2, False), 5: (5, 2, True), 4: (4, 1, True)}
    docs = spark.createDataFrame([(None, "aa"), (None, "bb"), (3, "aa"), (None, "bb"), (None, "aa")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"]) for r in exact_dedup.exact_duplicates(docs).collect())
    assert got == [(0, 0, 2), (0, 0, 2), (0, 3, 3), (0, 3, 3), (3, 3, 3)]


def test_exact_of_one_id_many_times(spark):
    """Rows that repeat an id are joined by their text as well: as many rows out as in."""
    docs = spark.createDataFrame([(7, f"text {i % 50}") for i in range(2000)], "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs)
    assert got.count() == 2000 and {r["group_size"] for r in got.collect()} == {40}
    clashing = docs.selectExpr("*", "1 as digest", "2 as who", "3 as gone")
    assert exact_dedup.drop_exact_duplicates(clashing).columns == clashing.columns and exact_dedup.drop_exact_duplicates(clashing).count() == 50
    assert near_dedup.drop_near_duplicates(clashing).columns == clashing.columns


def _colliding(real):
    from pyspark.sql import functions as F

    return lambda docs, chunk_bytes: real(docs, chunk_bytes).withColumns({x: F.lit(1).cast("long") for x in "abc"})


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty(spark)).count() == 0


def near_brute_force(rows, width, num, den):
    """component by row index, over ASCII-lowered byte words."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset() if not w or i is None else frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]))
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                linked = sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both)
                if (linked or (rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] == sets[b])) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label, sets


@pytest.mark.parametrize("seed,width,num,den,blocks", [(1, 3, 85, 100, 4096), (4, 5, 4, 5, 4)])
def test_near_against_brute_force(spark, monkeypatch, seed, width, num, den, blocks):
    monkeypatch.setattr(near_dedup, "PART_NODES", blocks)
    docs = documents(spark, seed, unique=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    label, sets = near_brute_force(rows, width, num, den)
    want = []
    for (i, t), c, s in zip(rows, label, sets, strict=True):
        want.append((i, len(s), c, i == c))
    got = [tuple(r) for r in near_dedup.near_duplicates(docs, width, num, den).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_near_group_without_a_centre(spark, monkeypatch):
    """A chain of texts, each linked with its neighbours only, in many parts: no link is lost."""
    monkeypatch.setattr(near_dedup, "PART_NODES", 8)
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    monkeypatch.setattr(near_dedup, "CHUNK_NODES", 5)
    words = [f"v{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[5 * i : 5 * i + 100])) for i in range(60)] + [(100 + i, " ".join(words[5 * i : 5 * i + 100])) for i in range(0, 60, 7)], "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    label, _ = near_brute_force(rows, 3, 85, 100)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 3, 85, 100).collect()}
    assert got == {i: c for (i, _), c in zip(rows, label, strict=True)}


def test_near_edges(spark):
    docs = documents(spark)
    got = near_dedup.near_duplicates(docs)
    assert got.count() == docs.count()
    assert got.where("doc_id is null and component_id is not null").count() == 0
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    assert near_dedup.drop_near_duplicates(empty(spark)).count() == 0


def test_threshold_misses_little():
    t = near_dedup.least_collisions(0.85)
    p = sum(float(np.prod([(64 - i) / (i + 1) for i in range(k)])) * 0.85**k * 0.15 ** (64 - k) for k in range(t))
    assert p <= 1e-6 and t >= 36


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(30)]
    shared = near_dedup.SharedElements(sets, most=7)
    both = shared.with_all(np.arange(30))
    for i in range(30):
        assert (shared.with_all(np.array([i]))[0] == both[i])[np.arange(30) != i].all()
        for j in range(i):
            assert both[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_merged_is_the_closure_of_the_relation(monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK_NODES", 3)
    rng = np.random.default_rng(5)
    for share in (0.0, 0.02, 0.05, 0.1, 0.5, 1.0):
        linked = rng.random((40, 40)) < share
        linked |= linked.T
        label, want = near_dedup.merged(40, lambda a, b, m=linked: m[np.ix_(a, b)]), np.arange(40)
        for _ in range(40):
            for i in range(40):
                want[linked[i]] = want[i] = min(want[i], want[linked[i]].min(initial=want[i]))
        assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(40) for j in range(40))


def test_hot_sets(spark, monkeypatch):
    """Sets of many equal rows are labelled by a broadcast, null and empty ones without a join."""
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 3)
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(i, long) for i in range(10, 20)] + [(5, long + " y"), (30, "a b c d e"), (31, "a b c d e"), (32, None), (33, ""), (None, long)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 5 for i in range(10, 20)} | {5: 5, 30: 30, 31: 30, 32: 32, 33: 33, None: None}


def test_star_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df, Scratch(spark, "t"), "c").collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def windows_brute_force(rows, window):
    seen, out = set(), []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            if run in seen:
                gone[k : k + window] = [True] * window
            seen.add(run)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 3), (3, 2)])
def test_substrings_against_brute_force(spark, seed, hot):
    docs = documents(spark, seed, n=90, unique=True)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = [tuple(r) for r in substring_dedup.dedup_substrings(docs, hot=hot).collect()]
    assert sorted(got) == sorted(windows_brute_force(rows, 20))


def test_substrings_of_repeated_rows(spark):
    docs = documents(spark)
    all_rows = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    rows = sorted(all_rows, key=key)
    want = [x for row, x in zip(rows, windows_brute_force(rows, 20), strict=True) for _ in range(all_rows[row])]
    got = [tuple(r) for r in substring_dedup.dedup_substrings(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0
    with_text = substring_dedup.dedup_substrings(docs, with_text=True).collect()
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in with_text)


def test_automaton_against_brute_force():
    rng = random.Random(9)
    for _ in range(40):
        sam, added = substring_dedup.SuffixAutomaton(), []
        for _ in range(rng.randint(1, 4)):
            seq = [rng.randrange(3) for _ in range(rng.randint(0, 12))]
            sam.add(seq)
            added.append(seq)
        probe = [rng.randrange(3) for _ in range(15)]
        runs = {tuple(s[i:j]) for s in added for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        want = [max((n for n in range(1, e + 2) if tuple(probe[e + 1 - n : e + 1]) in runs), default=0) for e in range(len(probe))]
        assert sam.matches(probe) == want


def test_reference_spans(spark):
    ref = " ".join(f"r{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a b {ref} c", "x"), (2, " ".join(f"r{i}" for i in range(19)), "y"), (3, None, "z")], "doc_id long, text string, kept string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_reference_spans(docs, [ref, "", None]).collect()}
    assert got == {1: "a b c", 2: " ".join(f"r{i}" for i in range(19)), 3: None}
    with pytest.raises(ValueError):
        substring_dedup.remove_reference_spans(docs, ["w " * (substring_dedup.REFERENCE_WORDS + 1)])
