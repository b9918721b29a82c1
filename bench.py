"""Seconds for each query: one JSON line. Results are written to Spark's no-op sink. Of headline queries, whose sum is the value, the
best of two runs counts; the others run once and are listed. BENCH_ALL=0 leaves these out."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "zset_rank zset_top10 zset_rangebyscore zset_union_sum zset_inter_max zset_diff set_union set_inter set_diff list_range_head list_rem string_append string_incrby string_getset "
    "hash_len_live hash_ttl keys_glob keys_hot keys_big sort_by_get stream_range stream_revrange stream_info group_read group_pending ts_aggregate ts_buckets bit_count bit_op_and "
    "hll_count geo_radius geo_polygon vector_cosine vector_batch vector_fusion crdt_gcounter crdt_orset crdt_lww pubsub_deliver anomaly_latency latency_report"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    from keyloom.plans import registry

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    others = [n for n in registry.queries() if n not in HEADLINE] if os.environ.get("BENCH_ALL", "1") != "0" else []
    for name in [*HEADLINE, *others]:
        f = registry.queries()[name]
        best = None
        for _ in range(2 if name in HEADLINE else 1):
            start = time.perf_counter()
            f(spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - start)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": took, "sf": sf.rpartition("/")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
