"""Every query with a DuckDB SQL gives the same rows at the smallest scale; the others give rows at all."""

import pytest

from lodestone.plans import catalog

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    if name in catalog.ORACLES:
        compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_input_order_does_not_matter(spark, tmp_path):
    """Shuffled and repartitioned inputs give the same rows."""
    for t in ("embeddings", "part", "documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(7).sortWithinPartitions(*["embedding" if t == "embeddings" else "p_name" if t == "part" else "doc_id"]).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("hybrid_retrieval", "weighted_pool_rrf", "weighted_signal_score", "confusion_by_groups", "shingle_jaccard_pairs"):
        a = catalog.QUERIES[name](spark, SF)
        b = catalog.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
