"""Wall time of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`python bench.py all` times every registered query instead.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import sys
import tempfile
import time

from termloom.catalog.registry import builders
from termloom.session import build_session

HEADLINE = [
    "C1_invalid_reason",
    "D2_keep_best",
    "D3_merge_duplicates",
    "E4_cache_stats",
    "E6_metric_merge",
    "E9_request_batches",
    "F1_text_vectors",
    "F1_document_vectors",
    "G2_coarse_fit",
    "H1_density_labels",
    "I4_merged_ids",
    "J2_reassign_outliers",
    "K5_validation",
    "L4_cluster_metrics",
    "L8_cluster_report",
    "M2_intent_decision",
    "M5_cluster_vote",
    "N1_theme_of_documents",
    "N7_fallback_labels",
    "P4_opportunity_matrix",
    "Q4_phase_progress",
    "keyword_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    steps = tempfile.mkdtemp(prefix="termloom-")
    atexit.register(shutil.rmtree, steps, ignore_errors=True)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.checkpoint.dir": steps,
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = builders()
    names = list(known) if sys.argv[1:] == ["all"] else sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
