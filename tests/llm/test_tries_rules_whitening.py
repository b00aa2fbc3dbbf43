"""op11, op12 and op13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import prefix_trie, quality_rules, queries, whitening
from lodestone.llm import words as W
from tests.oracle import compare

from .cases import documents, empty

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth long, digest string, conv string, n int"


# Prefix trie


def brute_trie(rows):
    """Members of every prefix, and sums over whole subtrees, from the sequences themselves."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    own = {c: [(r, t) for _, _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - int(math.fmod(c, 100))
        built[c] = own.get(head, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * (len(k[-1][1]) if k else 0)
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest())
        for k, m in nodes.items()
    )


def trie_rows(df):
    return sorted(tuple(r) for r in prefix_trie.trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def turns_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], TURNS).repartition(parts)


def conversations(seed, n=40):
    rng = random.Random(seed)
    ids = rng.sample(range(-150, 450), n) + [0, 100, 200, -100]
    rows = [(c, t, rng.choice("ua"), rng.choice(["", "hi", "é😀", "a b"])) for c in dict.fromkeys(ids) for t in range(rng.randint(1, 9))]
    rows += [(7, None, None, None), (7, None, "u", None), (8, 3, "u", "hi"), (8, 3, "u", "hi"), (8, 3, "a", "hi"), (None, 1, "u", "lost"), (None, None, None, None), (900, None, None, None), ((1 << 60) + 1, 1, "u", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_sequences(spark, seed):
    rows = conversations(seed)
    assert trie_rows(turns_of(spark, rows)) == brute_trie(rows)


def test_trie_of_long_conversations_in_small_segments(spark, monkeypatch):
    """Chains, sums along paths and lists of ids that cross segments and chunks; copies of a long conversation."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    long = [(c, t, "u", f"t{t if t < cut else (t, c)}") for c, cut in ((300, 99), (400, 99), (500, 17), (600, 8), (700, 99)) for t in range(30 + c // 350)]
    same = [(c, 0, "u", "hello") for c in range(1000, 1040)]
    rows = long + same + conversations(9, 20)
    assert trie_rows(turns_of(spark, rows, 7)) == brute_trie(rows)


def test_trie_edges(spark):
    assert trie_rows(turns_of(spark, [])) == [] and trie_rows(turns_of(spark, [(None, 1, "u", "x")])) == []
    assert trie_rows(turns_of(spark, [(5, 1, "u", "x")])) == brute_trie([(5, 1, "u", "x")])
    head = prefix_trie.trie(turns_of(spark, [(3, 1, "u", "ab"), (4, 1, "u", "ab")])).where("depth = 0").first()
    assert head["parent_conv_id"] is None and head["n_convs"] == 2


def test_trie_query(spark):
    compare(spark, queries.QUERIES["op11_prefix_trie"], queries.ORACLES["op11_prefix_trie"], SF)


# Quality rules


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), failed


def brute_scores(rows, trusted, buckets):
    """Counts of n-grams one by one; (score, kept by it) of each text."""
    word = {}

    def grams(text):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        hs = [word.setdefault(w, W.hash_words([w.encode()])[0]) for w in ws]
        found = [int(h[0]) for h in hs] + [int(W.runs(np.concatenate(p), 2)[0]) for p in zip(hs, hs[1:], strict=False)]
        return [g % buckets for g in found]

    raw, good = Counter(), Counter()
    for i, text in rows:
        g = grams(text)
        raw.update(g)
        if i in trusted:
            good.update(g)
    n, t = sum(raw.values()), sum(good.values())
    a = quality_rules.PRIOR * t / buckets
    out = []
    for _, text in rows:
        g = grams(text)
        worth = [round(math.log((good[x] + a) / (raw[x] * t / n + a)) * 1e6) if t else 0 for x in g]
        out.append((sum(worth) / max(1, len(g)) / 1e6, sum(worth) >= round(quality_rules.THRESHOLD * 1e6) * len(g)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_quality_rules_against_plain_counts(spark, seed):
    docs = documents(spark, seed)
    ids = sorted({r["doc_id"] for r in docs.collect() if r["doc_id"] is not None})
    known = [(i, int(i % 3 > 0)) for i in ids[::2]] + [(ids[1], 1), (ids[1], 0), (None, 1), (10**9, 1), (ids[3], None), (ids[0], 0)]
    labels = spark.createDataFrame([(*r, "clash", True) for r in known], "doc_id long, quality int, text string, trusted boolean")
    trusted = {i for i, _ in known if i is not None and {q for j, q in known if j == i and q is not None} == {1}}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter()
    for (i, text), (score, good) in zip(rows, brute_scores(rows, trusted, quality_rules.LEAST_BUCKETS), strict=True):
        base = brute_rules(text)
        want[(i, *base, not base[-1] and good, round(score, 6))] += 1
    got = Counter((*tuple(r)[:-1], round(r["score"], 6)) for r in quality_rules.judge(docs, labels).collect())
    assert got == want


def test_repeated_words_are_settled_on_words():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 40))]
        assert quality_rules.repeated_words(words) == brute_rules(b" ".join(words).decode())[4]
    assert quality_rules.repeated_words([b"x"] * 50_000) == 50_000


def test_quality_rules_edges(spark):
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert quality_rules.judge(empty(spark), labels).count() == 0
    docs = documents(spark)
    nothing = quality_rules.judge(docs, labels.limit(0)).collect()
    assert len(nothing) == docs.count() and all(r["kept"] != r["base_failed"] and r["score"] == 0 for r in nothing)


def test_quality_rules_part_labelled_texts(spark):
    """Labels of half of the rows teach; the others' labels agree with the verdict."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = labels.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 1)
    got = quality_rules.judge(docs, labels.join(out, "doc_id", "left_anti")).join(out, "doc_id").toPandas()
    assert got[got["quality"] == 1]["kept"].mean() > 0.95 and got[got["quality"] == 0]["kept"].mean() < 0.05
    clean = got[(got["quality"] == 1) & ~got["base_failed"]]
    assert clean["kept"].mean() > 0.99


# Whitening


def brute_whitening(vectors):
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=float)
    n, mean = len(fit), fit.mean(0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(len(mean), -1))
    order = np.argsort(-values)[:4]
    sums = [int(s) for s in fit.sum(0)]
    rows = [(i, k + 1, n, sum((n * a - b) ** 2 for a, b in zip(v, sums, strict=True)), float((np.array(v) - mean) @ axes[:, j] / math.sqrt(values[j])), values[j] / values.sum()) for i, v in x for k, j in enumerate(order)]
    return rows


def vectors_of(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, component string").repartition(parts)


@pytest.mark.parametrize("dims", [2, 6])
def test_whitening_against_numpy(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(i, [float(v) for v in rng.normal(size=dims) * np.arange(1, dims + 1)]) for i in range(80)]
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, rows[4][1]), ((1 << 60) + 1, rows[5][1])] + [(200 + i, rows[0][1]) for i in range(60)]
    odd = [(300, None), (301, []), (302, [1.0] * (dims - 1) + [None]), (303, [float("nan")] * dims), (304, [float("inf")] + [0.0] * (dims - 1)), (305, [1.0] * (dims + 1))]
    got = whitening.whiten(vectors_of(spark, rows + odd)).collect()
    want = brute_whitening(rows)
    assert len(got) == len(want) == len(rows) * min(4, dims)
    sign = {}
    by = lambda r: (r[0] is not None, r[0] or 0, r[1], abs(r[4]))
    for g, w in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert tuple(g)[:4] == w[:4] and math.isclose(g["explained"], w[5], rel_tol=1e-9)
        turned = sign.setdefault(w[1], 1 if g["whitened"] * w[4] > 0 else -1)
        assert abs(g["whitened"] * turned - w[4]) < 1e-8
    assert {g["identity_error"] for g in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_summaries_merge_in_any_order():
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, (300, 5)) + 10**9
    parts = [whitening.summary(x[a:b]) for a, b in ((0, 1), (1, 1), (1, 90), (90, 300))]
    left, right = None, None
    for part in parts:
        left = part if left is None else whitening.merge(left, part)
    for part in reversed(parts):
        right = part if right is None else whitening.merge(part, right)
    for n, sums, mean, scatter in (left, right):
        assert n == 300 and sums == x.sum(0).tolist() and np.allclose(mean, x.mean(0), rtol=1e-14)
        assert np.allclose(scatter / 300, np.cov((x - 10**9).T, bias=True), rtol=1e-9, atol=1e-3)


def test_whitening_edges(spark):
    assert whitening.whiten(vectors_of(spark, [(1, None)])).count() == 0 and whitening.whiten(vectors_of(spark, [])).count() == 0
    one = whitening.whiten(vectors_of(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert [tuple(r)[1:] for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)] * 2
    flat = whitening.whiten(vectors_of(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in flat) and flat[0]["identity_error"] < 1e-9
    huge = whitening.whiten(vectors_of(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])])).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge)
    near = whitening.whiten(vectors_of(spark, [(1, [1e6, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])])).collect()
    sums = (256 * 10**6 + 256, 256)
    assert {(r["vec_id"], r["deviation"]) for r in near} == {(i, sum((3 * a - b) ** 2 for a, b in zip(x, sums, strict=True))) for i, x in ((1, (256 * 10**6, 0)), (2, (0, 256)), (3, (256, 0)))}
