"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postsift.plans import registry  # noqa: E402
from postsift.session import SCAN_TASKS_CONF, build_session  # noqa: E402

HEADLINE = (
    "run_top500", "dedup_exact", "filter_pass", "score_total", "jobs_top500", "feed_normalize", "tabular_normalize",
    "forum_extract", "social_extract", "profile_extract", "page_fields", "page_links", "parse_salary", "skill_demand",
    "upsert_metadata", "patch_update", "anti_new", "grid_sort", "kpi_analytics", "stage_counts", "source_rollup",
    "first_n_per_source", "similar_pairs", "dedup_semantic_blocks", "enrich_topn", "events_6h_counts", "stream_ingest",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    registry.load()
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", SCAN_TASKS_CONF: cpus},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the session before the clock
    times: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        # the noop sink computes every row and column, and brings nothing to the driver
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")), "spark": spark.version, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
