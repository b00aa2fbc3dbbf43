"""Exact dedup by composable polynomial fingerprints.

A text is cut into chunks of bytes.  Chunks are fingerprinted in parallel, each
as the polynomial ``sum(byte * 256**place)`` modulo three primes; a chunk's value
times ``256**(bytes after it)`` is its share in the fingerprint of the whole, so
a plain distributed sum composes the chunks of a huge document.  Rows with equal
fingerprint and length are then compared chunk by chunk with one representative
of their group; rows that differ from it (a collision) are grouped by their text.

Null texts count as empty; empty texts are equal to each other.  Rows that
repeat a doc_id are rows of their own; a null doc_id is smaller than any number,
and a group of nothing but null ids keeps null.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, checked_broadcast, free_name, narrow, small_batches

CHUNK_BYTES = 64 * 1024
#: The largest primes under 2**44, 2**43 and 2**42: shares of 2**18 chunks add up within a long.
PRIMES = (2**44 - 17, 2**43 - 57, 2**42 - 11)
#: Rows of a group that are compared with one copy of its representative.
SALT_ROWS = 512
#: Members of groups that are broadcast, at most, of about 150 bytes each; more are shuffled.
MEMBERS = 500_000

_MODULUS = PRIMES[0] * PRIMES[1] * PRIMES[2]


def chunk_value(chunk: bytes, after: int) -> tuple[int, int, int]:
    """The chunk's share of a fingerprint when ``after`` bytes follow it."""
    value = int.from_bytes(chunk, "big") % _MODULUS
    return tuple(value % p * pow(256, after, p) % p for p in PRIMES)


@F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in "abc"]))
def _shares(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for chunks, after in batches:
        yield pd.DataFrame([chunk_value(c, n) for c, n in zip(chunks, after, strict=True)], columns=["a", "b", "c"], dtype="int64")


def _chunks(raw: F.Column, size: F.Column, chunk_bytes: int) -> F.Column:
    last = F.greatest(F.lit(0), F.floor((size - 1) / chunk_bytes)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * chunk_bytes + 1, F.lit(chunk_bytes)))


def fingerprints(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, size, a, b, c, text_sha256), a row for each row of (doc_id, text)."""
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    rows = raw.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.length("raw").cast("long").alias("size"),
        F.sha2("raw", 256).alias("text_sha256"), _chunks(F.col("raw"), F.length("raw"), chunk_bytes).alias("chunks"),
    )
    one = rows.select("row", "doc_id", "size", "text_sha256", F.posexplode("chunks").alias("k", "chunk"))
    after = F.col("size") - F.col("k") * F.lit(chunk_bytes) - F.length("chunk")
    shared = one.select("row", "doc_id", "size", "text_sha256", _shares("chunk", after).alias("s"))
    whole = shared.groupBy("row", "doc_id", "size", "text_sha256").agg(*(F.sum(f"s.{x}").alias(x) for x in "abc"))
    return whole.select("doc_id", "size", "text_sha256", *((F.col(x) % F.lit(p)).alias(x) for x, p in zip("abc", PRIMES, strict=True)))


def _who() -> F.Column:
    """One key for (doc_id, text_sha256) that a null id has as well."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), "text_sha256")


def _with_raw(docs: DataFrame) -> DataFrame:
    raw = docs.withColumn("raw", F.coalesce("text", F.lit("")).cast("binary")).withColumn("text_sha256", F.sha2("raw", 256))
    return raw.select(_who().alias("who"), "text_sha256", "raw")


def _unequal(docs: DataFrame, members: DataFrame, chunk_bytes: int) -> DataFrame:
    """(who) of members that differ in some chunk from their group's representative, the row that ``is_rep``."""
    key = ["size", "a", "b", "c"]
    texts = _with_raw(docs).join(checked_broadcast(members, MEMBERS), "who").where(F.length("raw") == F.col("size"))
    pieces = texts.select("who", "is_rep", "salts", *key, F.posexplode(_chunks(F.col("raw"), F.length("raw"), chunk_bytes)).alias("k", "chunk"))
    mine = pieces.select(*key, "k", F.pmod(F.xxhash64("who"), F.col("salts")).alias("salt"), "who", "chunk")
    theirs = pieces.where("is_rep").groupBy(*key, "k").agg(F.first("chunk").alias("kept_chunk"), F.first("salts").alias("salts"))
    theirs = theirs.select(*key, "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "kept_chunk")
    compared = mine.join(theirs, [*key, "k", "salt"])
    return compared.where(F.col("chunk") != F.col("kept_chunk")).select("who").distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; the largest id of equal texts stays."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "exact")
    docs = narrow(docs, id_col, text_col)
    key = ["size", "a", "b", "c"]
    marks = scratch.table(fingerprints(docs, chunk_bytes), "marks")
    groups = marks.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max(_who()).alias("rep"))
    groups = scratch.table(groups.where("group_size > 1").withColumn("salts", F.ceil(F.col("group_size") / SALT_ROWS)), "groups")
    members = marks.join(groups, key).where(F.col("size") > 0).select(_who().alias("who"), (_who() == F.col("rep")).alias("is_rep"), "salts", *key).distinct()
    unequal = scratch.table(_unequal(docs, scratch.table(members, "members"), chunk_bytes), "unequal")
    if unequal.isEmpty():
        found = marks.join(groups.drop("salts", "rep"), key, "left")
    else:
        # A collision: rows that differ from their representative are grouped by the text itself.
        apart = _with_raw(docs).join(checked_broadcast(unequal), "who")
        texts = apart.groupBy("raw").agg(F.first("text_sha256").alias("text_sha256")).select("text_sha256")
        marked = marks.withColumn("who", _who())
        differ = marked.join(unequal, "who").join(texts, "text_sha256", "left_semi")
        own = differ.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        same = marked.join(unequal, "who", "left_anti").drop("who")
        sizes = same.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        found = same.join(sizes, key).unionByName(differ.join(own, "text_sha256").select(*same.columns, "keep_id", "group_size"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the largest doc_id, once."""
    digest = free_name(docs, "digest")
    stay = exact_duplicates(docs).where("kept").select(_who().alias("who")).distinct()
    who = F.concat_ws(":", docs["doc_id"].cast("long").cast("string"), F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256))
    marked = docs.withColumn(digest, who)
    kept = marked.join(stay, marked[digest] == stay["who"], "left_semi")
    return kept.dropDuplicates([digest]).drop(digest)
