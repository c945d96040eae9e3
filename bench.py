"""Time the headline queries warm, the median of three runs each, and print one JSON line.

BENCH_SF_DIR (tables) and BENCH_CPUS (local cores) come from the environment.
"""

from __future__ import annotations

import json
import os
import statistics
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: A query of each kind: extraction, bucketing, statistics, comparison, filters, graph measures, communities.
HEADLINE = ("multigraph", "edges_weekly", "tag_cooccurrence", "node_map", "tag_entropy", "nmi_ari_vi", "pair_filtered", "jaccard_topk", "echo_funnel", "top_tags", "ei_index", "degree_filter", "pagerank_k", "leiden_cpm", "ctfidf_terms")


def main() -> None:
    from starling.queries import QUERIES
    from starling.session import local_session

    spark = local_session("bench", cores=CPUS, partitions=int(CPUS) if CPUS.isdigit() else 8)
    QUERIES["edges_retweet"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # the JVM warms up
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
