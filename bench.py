"""Time the headline queries: one JSON line on stdout.

Every query starts with an empty workspace, so none profits from tables that another one built. One untimed retrieval
warms the JVM up.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rankloom.catalog.queries import REGISTRY  # noqa: E402
from rankloom.session import Workspace, local_session  # noqa: E402

HEADLINE = [
    "split_pairs",
    "row_ids",
    "idx_postings",
    "idx_term_stats",
    "library_term_stats",
    "bm25_topk",
    "tfidf_scores",
    "library_topk",
    "neg_bm25",
    "neg_random",
    "training_bm25",
    "training_random",
    "split_by_query",
    "training_plan",
    "plan_targets",
    "history",
    "grid_smoothing",
    "r10_at_1",
    "vocab",
    "pair_encoding",
    "ranker_fit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, app="rankloom-bench")
    REGISTRY["bm25_topk"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spent: dict[str, float] = {}
    for name in wanted:
        with Workspace.use(spark):
            begun = time.time()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent[name] = round(time.time() - begun, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
