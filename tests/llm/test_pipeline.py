"""Stages one by one against what they say, and the whole pipeline."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from lodestone.llm import exact_dedup, mixing, near_dedup, quality

from .cases import documents, empty

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
        texts, earlier = {(r["doc_id"], r["text"]) for r in docs.collect()}, {(r["doc_id"], r["text"]) for r in before.collect()}
        assert texts <= earlier
        if name == "exact_dedup":
            assert texts == {(max(i for i, u in earlier if u == t), t) for _, t in earlier}
        if name == "near_dedup":
            kept = {r["doc_id"] for r in near_dedup.near_duplicates(before).where("kept").collect()}
            assert {i for i, _ in texts} == kept
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    first = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert len(good - first) <= 0.02 * len(good)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"]
    assert got.count() > 0 and got.where("not round_trip").count() == 0
    assert exact_dedup.exact_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").count() <= 200


def test_mixing_learns_from_the_whole_table(spark, monkeypatch):
    """The rows that reach the mixing stage are scored as they are among the whole table."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = docs.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)
    seen = []
    posteriors = mixing.posteriors
    monkeypatch.setattr(mixing, "posteriors", lambda *a: seen.append(posteriors(*a)) or seen[-1])
    assert corpus_pipeline.mix_domains(spark, good, SF).columns == docs.columns
    whole = {r["doc_id"]: r["posterior"] for r in posteriors(docs, labels).select("row.doc_id", "posterior").collect()}
    got = seen[0].select("row.doc_id", "posterior").collect()
    assert got and all(r["posterior"] == whole[r["doc_id"]] for r in got)


def shingled(text):
    """Five-word shingles of a text in lower case (A-Z alone); a shorter text is one shingle."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dedup_stage_against_all_pairs(spark):
    docs = corpus_pipeline.drop_copies(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).cache()
    sets = {r["doc_id"]: shingled(r["text"]) for r in docs.collect()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert kept == {i for i in sets if top(i) == i} and len(kept) < len(sets)


def test_quality_stage_against_the_scores(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in quality.quality_scores(docs, labels).collect() if r["score"] >= 0.5}
    assert {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, SF).collect()} == good


def test_mixing_stage_against_its_rates(spark):
    """Every row is there as often as its rate says, up to one, and expected tokens of a domain are what is asked for."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    weighted = mixing.posteriors(docs, labels).select("row.doc_id", "tokens", "posterior").toPandas()
    p, t = np.stack(weighted["posterior"]), weighted["tokens"].to_numpy()
    frame = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p, strict=True)], "tokens long, posterior array<double>").cache()
    steps, _ = mixing.fit_rates(frame, raised={"q1t0": 1.25})
    rate = dict(zip(weighted["doc_id"], np.maximum(0, 1 + p @ steps), strict=True))
    copies = Counter(r["doc_id"] for r in corpus_pipeline.mix_domains(spark, docs, SF).collect())
    assert all(abs(copies[i] - r) < 1 for i, r in rate.items()) and set(copies) <= set(rate)
    mass = (p * t[:, None]).sum(0)
    got = (p * (t * np.array([rate[i] for i in weighted["doc_id"]]))[:, None]).sum(0)
    assert np.allclose(got, mass * np.array([1.25, 1, 1, 1]), rtol=5e-3, atol=1e-4 * mass.sum())


def test_token_stage_decodes_piece_by_piece(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").unionByName(spark.createDataFrame([(10**6, " ünder 😀 \ta  b", "en", "s", 1), (10**6 + 1, None, None, None, None), (10**6 + 2, "", "", "", 0)], spark.read.parquet(f"{SF}/documents.parquet").schema))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in corpus_pipeline.to_token_ids(spark, docs, SF).collect():
        raw = b""
        for i in r["ids"]:
            piece = pieces.id_to_piece(i)
            raw += bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()
        text = texts[r["doc_id"]]
        assert raw.decode() == (" " + text if text else "") or raw.decode() == text
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["n_tokens"] == len(r["ids"])


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, columns with clashing names; no labels at all; no rows at all."""
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == table.columns, name
            n = out.count()
            assert (n <= table.count() or name == "mixing") and (n > 0) == (not table.isEmpty()), name
        assert corpus_pipeline.to_token_ids(spark, table, str(tmp_path)).count() == table.count()
    assert corpus_pipeline.keep_good(spark, docs, str(tmp_path)).count() == docs.count()  # without labels everything scores 0.5 and stays
