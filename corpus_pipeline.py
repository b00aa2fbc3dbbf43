"""A pipeline over ``documents``: quality, exact dedup, near-dedup, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and returns a DataFrame that ``run`` writes as Parquet and reads again for
the next.  All stages but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exact_dedup, mixing, near_dedup, quality, unigram
from lodestone.llm.scratch import Scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.5 and more."""
    return quality.keep_quality(docs, _labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by shingles of five words and a similarity of 0.8 the one with the smallest doc_id."""
    return near_dedup.drop_near_duplicates(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document by its rate; good and clean text is raised, nothing else is meant to fall.

    The whole table teaches: of what the first stage keeps, hardly a row has the other quality.
    """
    return mixing.mix(docs, _labels(spark, sf_dir), raised={"q1t0": 1.25}, taught_by=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, round_trip) of each row."""
    return unigram.tokenize(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("token_ids", to_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs


#: A trained classifier and a tokenizer can't be stated in SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
