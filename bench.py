"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query runs once to warm up the
session and once for the clock; the result is written to the no-op sink, so all of it is computed.
"""

from __future__ import annotations

import json
import os
import time

from exselect.plans.catalog import QUERIES
from exselect.session import local_session

HEADLINE = [
    "dot_top_most_influential", "dot_matrix_summary", "cosine_top_most_influential",
    "curvature_top_most_helpful", "bm25_reference_top_most_influential", "bm25_reference_top_least_influential",
    "facility_location_most_influential", "divine_most_influential", "aide_picks", "grid_selection_sizes",
    "coder_scores_of_pairs", "explained_share_least_squares", "grid_score_records", "divergences_as_published",
    "assistant_labels_by_offset", "term_statistics", "selection_against_random", "rank_correlation_overall",
    "gain_ratio_to_naive", "gain_area_over_k", "histogram_2d", "task_score_matrix",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, "bench")
    took = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
