"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from statekit.operators import scans
from statekit.plans import REGISTRY
from statekit.session import local_session
from statekit.sources import tables as t

HEADLINE = [
    "keyed_count", "running_count", "owner_counts", "latest_state", "state_at_checkpoint",
    "read_your_writes", "asof_read", "merge_sum", "merge_set", "fenced_writes", "record_rmw",
    "record_tags", "point_lookup", "replay_dedupe", "rescale_rows", "rescale_verify", "tier_gap",
    "tier_watermark", "compacted_state", "orphans", "metric_catalog", "hit_ratio", "latency_quantiles",
    "throughput_report", "barrier_snapshot", "asof_orders", "asof_time", "clone_chain", "incremental_merge",
    "stream_count", "stream_fold", "stream_tiering", "stream_dedupe", "stream_checkpoints", "stream_enrich", "query_state",
    "state_change_feed",
]


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def lookups(spark, sf_dir) -> dict[str, float]:
    """Keys per second: one key per query against one join for all keys."""
    state = t.state(spark, sf_dir).drop("db_id").persist()
    state.count()
    single = min(timed(lambda: scans.get_one(state, str(k))) for k in range(5))
    keys = t.table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS key")
    n = keys.count()
    joined = min(timed(lambda: scans.get(keys, state)) for _ in range(3))
    state.unpersist()
    return {"single_keys_per_s": round(1 / single, 2), "joined_keys_per_s": round(n / joined, 1)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    REGISTRY["keyed_count"].run(spark, sf_dir).count()  # starts the workers and warms the JVM
    for name in names:
        repeats = 1 if name.startswith("stream") else 2
        seconds[name] = round(min(timed(lambda: REGISTRY[name].run(spark, sf_dir)) for _ in range(repeats)), 3)
    out = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    if not sys.argv[1:]:
        out["lookups"] = lookups(spark, sf_dir)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
