"""Time the headline queries on one data folder; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "split_class_distribution",
    "audit_length_statistics",
    "audit_content_signals",
    "audit_duplicate_groups",
    "duplicate_components",
    "split_counts",
    "fold_class_counts",
    "fold_membership_digests",
    "scalar_metrics",
    "ranking_areas_by_type",
    "hash_ranked_sample",
    "chunk_audit",
    "word_vocabulary",
    "word_tfidf_validation",
    "char_vocabulary",
)


def main() -> None:
    from tracefold.queries import load
    from tracefold.session import build_session, release_scratch

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    # One throw-away run starts the JVM's code paths and the Python workers.
    queries["eligible_text_rows"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    release_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
