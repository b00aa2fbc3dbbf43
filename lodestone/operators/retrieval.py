"""Evidence retrieval for batches of units: signals, vectors, fusion, budgets.

Units (queries) and records (evidence) are rows; every operator works on all
units at once.  Signals are long tables ``(owner, kind, value)``, so the overlap
of two sets is an equi-join on (kind, value).  All orders end in the record's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import rows_of, small_side

# Weights of a match by kind, and of the two bonuses.
WEIGHTS = {"rule_id": 100, "api": 50, "component": 40, "decorator": 40, "tag": 30, "hint_tag": 10, "keyword": 5}
DIMENSION_WEIGHT, APPLICABLE_WEIGHT = 2, 3
# Priorities of authorities.
AUTHORITY = {
    "internal_baselined": 100, "official_language_spec": 90, "official_security_notice": 90, "feature_spec": 80, "official_documentation": 70,
    "official_api_definition": 60, "implementation_rule_reference": 40, "test_evidence": 10,
}
# Limits and constants of ranking.
EXACT_LIMIT, VECTOR_LIMIT, RESULT_LIMIT, RRF_K, MIN_SIMILARITY = 50, 30, 8, 60, 0.30
# Candidate limit and fusion weight of each pool, in pool order.
POOLS = {"formal_exact": (50, 1.0), "file_hint": (50, 0.5), "text_keyword": (50, 0.25), "ai_inferred": (50, 0.25), "semantic_vector": (30, 1.0)}
ARMS = {"static_vector": ("formal_exact", "file_hint", "text_keyword", "semantic_vector"), "hybrid": tuple(POOLS)}


def weights_table(spark, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    return rows_of(spark, list(weights.items()), "kind string, weight int")


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """(alias, canonical) of the aliases that name exactly one canonical value."""
    counted = aliases.groupBy("alias").agg(F.count_distinct("canonical").alias("n"), F.min("canonical").alias("canonical"))
    return counted.where("n = 1").select("alias", "canonical")


def resolve_aliases(signals: DataFrame, aliases: DataFrame, kind: str = "api") -> DataFrame:
    """``signals`` whose values of ``kind`` are replaced by their canonical name where that is unambiguous."""
    known = unique_aliases(aliases)
    joined = signals.join(small_side(known), (signals["value"] == known["alias"]) & (signals["kind"] == kind), "left")
    return joined.select(*(signals[c] for c in signals.columns if c != "value"), F.coalesce("canonical", signals["value"]).alias("value"))


def signal_matches(unit_signals: DataFrame, record_signals: DataFrame) -> DataFrame:
    """(unit_id, rule_id, kind, value), distinct: signals that a unit and a record share.

    A signal that very many records have is one key: where the units' signals are few,
    they go to the records, which stay where they are.
    """
    units = unit_signals.select("unit_id", "kind", "value").distinct()
    records = record_signals.select("rule_id", "kind", "value").distinct()
    return records.join(small_side(units), ["kind", "value"]).select("unit_id", "rule_id", "kind", "value")


def hint_only(exact_tags: DataFrame, routing_tags: DataFrame) -> DataFrame:
    """(unit_id, value) of routing tags that aren't exact tags of the unit."""
    return routing_tags.join(exact_tags, ["unit_id", "value"], "left_anti")


#: Keywords of one automaton, about 100 bytes each; a larger table is searched keyword by keyword.
MOST_KEYWORDS = 500_000


def found_keywords(texts: DataFrame, keywords: DataFrame, text: str, keyword: str) -> DataFrame:
    """``texts`` with ``keyword``, a row for each distinct keyword, in lower case, that the lower-cased text holds; empty ones hold nowhere.

    The distinct keywords are an automaton that each task builds once; a text is read
    once for all of them, whatever their number.
    """
    words = keywords.select(F.lower(keyword).alias(keyword)).where(f"{keyword} <> ''").distinct()
    known = [r[0] for r in words.limit(MOST_KEYWORDS + 1).collect()]
    if len(known) > MOST_KEYWORDS:
        return texts.join(words, F.lower(text).contains(F.col(keyword)))
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in shared.value:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            yield pa.array([sorted({w for _, w in automaton.iter(t)}) if t and shared.value else [] for t in batch.to_pylist()], pa.list_(pa.string()))

    hits = F.arrow_udf(search, "array<string>", F.ArrowUDFType.SCALAR_ITER)
    return texts.select("*", F.explode(hits(F.lower(text))).alias(keyword))


def keyword_matches(contexts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(unit_id, rule_id, kind, value): keywords (rule_id, value) found in the lower-cased context (unit_id, context)."""
    hits = found_keywords(contexts.select("unit_id", "context"), keywords, "context", "value").select("unit_id", F.col("value").alias("low"))
    return hits.join(keywords.withColumn("low", F.lower("value")), "low").select("unit_id", "rule_id", F.lit("keyword").alias("kind"), "value")


def weighted_scores(matches: DataFrame, weights: DataFrame) -> DataFrame:
    """(unit_id, rule_id, n_matches, score) from distinct matches."""
    weighed = matches.join(small_side(weights), "kind")
    return weighed.groupBy("unit_id", "rule_id").agg(F.count("*").alias("n_matches"), F.sum("weight").cast("long").alias("score"))


def with_bonuses(scores: DataFrame, overlaps: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds the dimension overlap (unit_id, rule_id, overlap) and the bonus for applicable records; excluded ones go."""
    joined = scores.join(overlaps, ["unit_id", "rule_id"], "left").join(decisions, ["unit_id", "rule_id"], "left")
    joined = joined.withColumn("overlap", F.coalesce("overlap", F.lit(0))).withColumn("decision", F.coalesce("decision", F.lit("applicable")))
    bonus = DIMENSION_WEIGHT * F.col("overlap") + F.when(F.col("decision") == "applicable", APPLICABLE_WEIGHT).otherwise(0)
    return joined.where("decision <> 'excluded'").withColumn("score", F.col("score") + bonus)


def ranked(hits: DataFrame, order: list[Column], limit: int | None = None, keys: tuple[str, ...] = ("unit_id",), name: str = "rank") -> DataFrame:
    """Row numbers from 1 by ``keys`` in a total order, cut at ``limit``."""
    numbered = hits.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered if limit is None else numbered.where(F.col(name) <= limit)


def exact_ranking(scores: DataFrame, limit: int = EXACT_LIMIT) -> DataFrame:
    """Ranks by score, number of matches and authority, each from high to low, then rule_id."""
    authority = F.desc("authority") if "authority" in scores.columns else F.lit(0)
    return ranked(scores, [F.desc("score"), F.desc("n_matches"), authority, F.asc("rule_id")], limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, rounded to 8 places; 0 if a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms), 8)


#: Query vectors that are compared in one pass over the index.
QUERY_BLOCK = 16_384


def similarities(queries: DataFrame, index: DataFrame, minimum: float | None = None, nearest: int | None = None) -> DataFrame:
    """(unit_id, rule_id, similarity) of pairs of (unit_id, vector) and (rule_id, vector), all or those of at least ``minimum``.

    With ``nearest`` no unit meets the record of its own id, and each task gives only the
    pairs that can be among the unit's that many first by similarity, then rule_id: all
    of its own first ones.  So what is shuffled grows with units and tasks, not with pairs.

    Queries are dealt to blocks by their id; each block is broadcast as one matrix, and
    the index passes by it in Arrow batches, a matrix product each: the index is
    neither moved nor sorted, and a task holds one block and one batch.  Vectors that
    are null, hold a null or have another length than the first query by id are left
    out; a zero vector has a similarity of 0.
    """
    spark = queries.sparkSession
    q = queries.select("unit_id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    i = index.select("rule_id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    sizes = q.agg(F.count("*").alias("n"), F.min_by(F.size("vector"), "unit_id").alias("dims")).first()
    schema = f"unit_id {q.schema['unit_id'].dataType.simpleString()}, rule_id {i.schema['rule_id'].dataType.simpleString()}, similarity double"
    found, blocks = spark.createDataFrame([], schema), max(1, -(-sizes["n"] // QUERY_BLOCK))
    dims = sizes["dims"] or 0
    q, i = q.where(F.size("vector") == dims), i.where(F.size("vector") == dims)
    for block in range(blocks if sizes["n"] else 0):
        part = q.where(F.pmod(F.xxhash64("unit_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        found = found.unionByName(_block_pairs(spark, part, i, dims, minimum, schema, nearest))
    return found


#: Products of a block with rows of the index that a task holds at once, 8 bytes each and some copies.
PRODUCTS = 2_000_000


class Nearest:
    """The first ``most`` records of each unit by similarity from high to low (NaN first, as Spark sorts it), then id."""

    def __init__(self, units: int, most: int, ids: pa.DataType):
        self.units, self.most = units, most
        self.floor = np.full(units, -np.inf)
        schema = pa.schema([("unit", pa.int64()), ("key", pa.float64()), ("rule_id", ids)])
        self.kept, self.held = [schema.empty_table()], 0

    def add(self, cosine: np.ndarray, allowed: np.ndarray, ids: pa.Array) -> None:
        """``cosine`` has a row for each record and a column for each unit."""
        key = np.where(np.isnan(cosine), np.inf, cosine)
        row, unit = np.nonzero(allowed & (key >= self.floor))
        self.kept.append(pa.table({"unit": unit.astype(np.int64), "key": key[row, unit], "rule_id": ids.take(pa.array(row))}))
        self.held += len(row)
        if self.held > max(4 * self.units * self.most, PRODUCTS):
            self.cut()

    def cut(self) -> pa.Table:
        rows = pa.concat_tables(self.kept).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("unit", "ascending"), ("key", "descending"), ("rule_id", "ascending")]))
        unit = rows.column("unit").to_numpy()
        place = np.arange(len(unit)) - np.searchsorted(unit, unit)
        last = place == self.most - 1
        self.floor[unit[last]] = rows.column("key").to_numpy()[last]
        rows = rows.filter(pa.array(place < self.most))
        self.kept, self.held = [rows], len(rows)
        return rows


def _block_pairs(spark: SparkSession, part: pa.Table, index: DataFrame, dims: int, minimum: float | None, schema: str, nearest: int | None) -> DataFrame:
    def matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        return rows, np.sqrt((rows * rows).sum(1))

    units = part.column("unit_id").combine_chunks() if isinstance(part.column("unit_id"), pa.ChunkedArray) else part.column("unit_id")
    vectors = part.column("vector").combine_chunks() if isinstance(part.column("vector"), pa.ChunkedArray) else part.column("vector")
    shared = spark.sparkContext.broadcast((units, *matrix(vectors)))
    step = min(512, max(1, PRODUCTS // max(1, len(units))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, lengths = shared.value
        first = None
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                rows, norms = matrix(some.column("vector"))
                both = np.outer(norms, lengths)
                cosine = np.where(both == 0, 0.0, rows @ queries.T / np.where(both == 0, 1.0, both)).round(8)
                allowed = np.full(cosine.shape, True) if minimum is None else cosine >= minimum
                if nearest is None:
                    row, unit = np.nonzero(allowed)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(unit)), some.column("rule_id").take(pa.array(row)), pa.array(cosine[row, unit])], names=["unit_id", "rule_id", "similarity"])
                    continue
                if some.column("rule_id").type == ids.type:
                    number = lambda x: pc.index_in(x, pc.unique(ids)).fill_null(-1).to_numpy(zero_copy_only=False)
                    allowed &= number(some.column("rule_id"))[:, None] != number(ids)
                first = first or Nearest(len(ids), nearest, some.schema.field("rule_id").type)
                first.add(cosine, allowed, some.column("rule_id"))
        if first is not None:
            rows = first.cut()
            key = rows.column("key").to_numpy()
            columns = [ids.take(rows.column("unit").combine_chunks()), rows.column("rule_id").combine_chunks(), pa.array(np.where(np.isposinf(key), np.nan, key))]
            yield from pa.table(columns, names=["unit_id", "rule_id", "similarity"]).to_batches(10_000)

    return index.mapInArrow(task, schema)


def vector_ranking(pairs: DataFrame, minimum: float = MIN_SIMILARITY, limit: int = VECTOR_LIMIT) -> DataFrame:
    """The most similar records of each unit, none below ``minimum``; ties by ``overlap`` and ``authority`` where there, then rule_id."""
    ties = [F.desc(F.coalesce(c, F.lit(0))) for c in ("overlap", "authority") if c in pairs.columns]
    return ranked(pairs.where(F.col("similarity") >= minimum), [F.desc("similarity"), *ties, F.asc("rule_id")], limit)


def reciprocal_rank_fusion(exact: DataFrame, vector: DataFrame, k: int = RRF_K) -> DataFrame:
    """(unit_id, rule_id, exact_rank, exact_score, vector_rank, similarity, rrf_score, rank): a full outer join of two rankings.

    ``decision``, ``authority`` and ``overlap`` are carried where both rankings have
    them; records of unknown applicability come after others, then by authority.
    """
    both_have = [c for c in ("decision", "authority", "overlap") if c in exact.columns and c in vector.columns]
    e = exact.select("unit_id", "rule_id", F.col("rank").alias("exact_rank"), F.col("score").alias("exact_score"), *(F.col(c).alias(f"__e_{c}") for c in both_have))
    v = vector.select("unit_id", "rule_id", F.col("rank").alias("vector_rank"), "similarity", *(F.col(c).alias(f"__v_{c}") for c in both_have))
    both = e.join(v, ["unit_id", "rule_id"], "full_outer")
    for c in both_have:
        merged = F.coalesce if c == "decision" else F.greatest
        both = both.withColumn(c, merged(f"__e_{c}", f"__v_{c}")).drop(f"__e_{c}", f"__v_{c}")
    part = [F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0)) for c in ("exact_rank", "vector_rank")]
    fused = both.withColumn("rrf_score", F.round(part[0] + part[1], 8))
    order = [F.desc("rrf_score"), F.col("exact_rank").isNull(), F.desc(F.coalesce("exact_score", F.lit(0))), F.desc(F.coalesce("similarity", F.lit(-1.0)))]
    if "decision" in both_have:
        order.append(F.coalesce(F.col("decision") == "unknown", F.lit(False)).asc())
    if "authority" in both_have:
        order.append(F.desc(F.coalesce("authority", F.lit(0))))
    return ranked(fused, [*order, F.asc("rule_id")])


def pool_fusion(hits: DataFrame, arms: dict[str, tuple[str, ...]] = ARMS, pools: dict[str, tuple[int, float]] = POOLS, k: int = RRF_K) -> DataFrame:
    """Weighted fusion of pool rankings (unit_id, pool, rule_id, pool_rank, path_score) for every arm in one pass.

    Each contribution is rounded before the sum.  (arm, unit_id, rule_id, rrf_score, n_pools, rank).
    """
    spark = hits.sparkSession
    members = rows_of(spark, [(arm, pool, *pools[pool]) for arm, names in arms.items() for pool in names], "arm string, pool string, pool_limit int, pool_weight double")
    joined = hits.join(F.broadcast(members), "pool").where("pool_rank <= pool_limit")
    share = F.round(F.col("pool_weight") / (F.lit(k) + F.col("pool_rank")), 8)
    paths = [F.max(F.when(F.col("pool") == p, F.col("path_score"))).alias(f"__{p}") for p in pools]
    fused = joined.groupBy("arm", "unit_id", "rule_id").agg(F.round(F.sum(share), 8).alias("rrf_score"), F.count("*").alias("n_pools"), *paths)
    by_path = [F.desc(F.coalesce(f"__{p}", F.lit(-1.0))) for p in ("formal_exact", "semantic_vector", "file_hint", "text_keyword", "ai_inferred")]
    order = [F.desc("rrf_score"), F.col("__formal_exact").isNull(), *by_path, F.asc("rule_id")]
    return ranked(fused, order, keys=("arm", "unit_id")).drop(*(f"__{p}" for p in pools))


def pool_ranking(hits: DataFrame, pools: dict[str, tuple[int, float]] = POOLS) -> DataFrame:
    """``pool_rank`` by unit and pool, cut at each pool's limit."""
    limits = F.coalesce(*(F.when(F.col("pool") == p, n) for p, (n, _) in pools.items()))
    order = [F.desc("path_score"), F.asc("rule_id")]
    return ranked(hits, order, keys=("unit_id", "pool"), name="pool_rank").where(F.col("pool_rank") <= limits)


def budget_selection(hits: DataFrame, limit: int = RESULT_LIMIT, groups: tuple[str, ...] = ("unit_id",)) -> DataFrame:
    """Diversified choice under a budget: (keys, rule_id, rank, tokens, status, position).

    ``hits`` has rank, tokens, dimensions array<string>, and per unit wanted
    array<string> and budget.  First each wanted dimension takes its best hit that
    fits, then the ranking is filled; what is chosen stands in rank order.  The
    choice depends on what came before, so a unit's candidates (at most the sum of
    the candidate limits) are one group in pandas.  Status tells why a hit isn't
    selected: token_budget or result_limit.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        budget = int(pdf["budget"].iloc[0])
        tokens, dims = pdf["tokens"].tolist(), [set(d) for d in pdf["dimensions"]]
        status, spent, taken = ["result_limit"] * len(pdf), 0, 0

        def take(i: int) -> bool:
            nonlocal spent, taken
            if status[i] == "selected" or taken >= limit:
                return False
            if spent + tokens[i] > budget:
                status[i] = "token_budget"
                return False
            status[i], spent, taken = "selected", spent + tokens[i], taken + 1
            return True

        for wanted in pdf["wanted"].iloc[0]:
            any(take(i) for i in range(len(pdf)) if wanted in dims[i])
        for i in range(len(pdf)):
            take(i)
        pdf["status"] = status
        chosen = pdf["status"] == "selected"
        pdf["position"] = chosen.cumsum().where(chosen, 0).astype("int32")
        return pdf[out]

    fields = [f for f in hits.schema if f.name in (*groups, "rule_id", "rank", "tokens")]
    out = [*(f.name for f in fields), "status", "position"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", status string, position int"
    return hits.groupBy(*groups).applyInPandas(choose, schema)


def coverage(selected: DataFrame) -> DataFrame:
    """(unit_id, covered, uncovered): the wanted dimensions that the selected hits have, and the others, sorted."""
    found = selected.groupBy("unit_id").agg(F.array_distinct(F.flatten(F.collect_list("dimensions"))).alias("found"), F.first("wanted").alias("wanted"))
    return found.select(
        "unit_id", F.array_sort(F.array_intersect("wanted", "found")).alias("covered"), F.array_sort(F.array_except("wanted", "found")).alias("uncovered")
    )


def diagnostics(units: DataFrame) -> DataFrame:
    """(unit_id, codes): sorted codes from boolean columns blocked, unknown, over_budget, empty, degraded."""
    codes = {"blocked": "retrieval_blocked", "unknown": "applicability_unknown", "over_budget": "token_budget_exhausted", "empty": "no_evidence", "degraded": "parser_degraded"}
    present = [F.when(F.col(c), F.lit(code)) for c, code in codes.items() if c in units.columns]
    return units.select("unit_id", F.array_sort(F.array_distinct(F.filter(F.array(*present), lambda x: x.isNotNull()))).alias("codes"))


def even_split(total: Column, position: Column, parts: Column) -> Column:
    """The share of part ``position`` (from 1): the remainder goes one each to the first parts."""
    return (F.floor(total / parts) + (position - 1 < total % parts).cast("long")).cast("long")


def evenly_chosen(n: Column, k: Column) -> Column:
    """``k`` positions (from 0) spread over ``n`` items, both ends included; all if there are no more than ``k``."""
    spread = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("int"))
    everything = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, everything).otherwise(spread)


def embed(texts: DataFrame, provider, text_col: str = "text", out_col: str = "vector") -> DataFrame:
    """Adds float32 vectors from ``provider() -> (list[str] -> list[list[float]])``, made once a task and called by batch."""

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = provider()
        for batch in batches:
            yield pd.Series(list(encode(batch.fillna("").tolist())))

    return texts.withColumn(out_col, F.pandas_udf(vectors, "array<float>", F.PandasUDFType.SCALAR_ITER)(text_col))
