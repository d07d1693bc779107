"""Seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, as one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from ticketlake.plans import QUERIES
from ticketlake.session import local_session, release

HEADLINES = [
    "clean_tickets",
    "dedup_description",
    "describe_all",
    "missing_values",
    "boxplot_hours_by_priority",
    "hist_desc_length",
    "tickets_per_month",
    "split_stratified",
    "vocabulary",
    "tfidf_weights",
    "embed_default",
    "build_index",
    "index_upsert",
    "knn_exact",
    "knn_cells",
    "knn_where",
    "retrieve",
    "rerank_bm25",
    "resolve_batch",
    "judge_samples",
    "retrieval_summary",
    "clf_report",
    "classify_fit_eval",
    "stream_counts",
    "stream_retrieve",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "ticketlake-bench")
    names = sys.argv[1:] or HEADLINES
    QUERIES["count_category"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM paths
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    release(spark)
    sf = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf.group(1)) if sf else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
