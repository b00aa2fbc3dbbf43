"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestone.plans import catalog  # noqa: E402
from lodestone.session import local_session  # noqa: E402

HEADLINE = [
    "hybrid_retrieval", "weighted_pool_rrf", "weighted_signal_score", "cosine_topk", "prefix_suffix_leaf_tags", "applicability_3valued", "keyword_theta_join", "confusion_by_groups", "ranking_metrics_at_k", "cohens_kappa",
    "multiset_match", "consensus_status", "evaluation_selection", "line_islands", "innermost_interval", "line_coverage_check", "connected_components", "integrity_anti_joins", "sentence_fragments", "token_estimate",
    "normalized_body_dupes", "shingle_jaccard_pairs", "benchmark_contamination", "budget_select",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cores=int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["token_estimate"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the session warms up
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
