"""Sets and seen intervals as stream state, stored tables that stay in place, mergeable sketches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from statekit.operators import log, sketches
from statekit.sources import colocated
from statekit.streaming import ordered, runs, state

OPS = "db_id string, key string, op string, element string, seq long"


def ops(seed, n):
    rng = random.Random(seed)
    kinds = ["put", "merge", "merge", "merge", "merge", "delete", "get"]
    return [("d", rng.choice(["a", "b", None]), rng.choice(kinds), rng.choice(["x", "y", "z", "w", None]), s) for s in range(n)]


def fed(spark, tmp_path, batches, shape, schema, name="s", mode="update", partitions=2):
    """Run rows through a query, one file a batch, in the order given."""
    src, out, ckpt = (f"{tmp_path}/{name}-{x}" for x in ("src", "out", "ckpt"))
    own = runs.stream_session(spark, partitions)
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        runs.drain(runs.start(shape(runs.replayable(own, src, spark.createDataFrame([], schema).schema)), ckpt, runs.batch_writer(out), mode))
    return out, ckpt


@pytest.mark.parametrize("order", ["forward", "backward"])
def test_live_set_in_any_order(spark, tmp_path, order):
    rows = ops(3, 120)
    batches = [rows[i : i + 40] for i in range(0, 120, 40)]
    batches = batches + [rows[20:60]] if order == "forward" else batches[::-1]
    shape = lambda s: state.live_set(state.set_operands(s, F.col("element")))
    out, ckpt = fed(spark, tmp_path, batches, shape, OPS)
    got = {(r.key, r.entry.element) for r in runs.collection(spark, ckpt, "elements").collect()}
    changes = spark.createDataFrame(rows, OPS)
    want = {(r.key, r.element) for r in log.fold_set(changes, F.col("element")).collect() if r.element is not None}
    assert got == want and got
    if order == "forward":  # what came and went adds up to what is there
        steps = spark.read.parquet(out).groupBy("key", "element").agg(F.sum(F.when(F.col("live"), 1).otherwise(-1)).alias("n")).where("n > 0")
        assert {(r.key, r.element) for r in steps.collect()} == want


def test_elements_expire_by_themselves(spark, tmp_path):
    src, out, ckpt, own = f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/ckpt", runs.stream_session(spark, 1)
    shape = lambda s: state.live_set(state.set_operands(s, F.col("element")), ttl_ms=4000)
    for batch in ([("d", "a", "merge", "x", 1)], [("d", "a", "merge", "y", 2)], [("d", "a", "merge", "x", 3)]):
        spark.createDataFrame(batch, OPS).coalesce(1).write.mode("append").parquet(src)
        runs.drain(runs.start(shape(runs.replayable(own, src, spark.createDataFrame([], OPS).schema)), ckpt, runs.batch_writer(out)))
        time.sleep(4.5)
    # x had gone when it came again, so it is reported twice.
    assert sorted((r.element, r.live) for r in spark.read.parquet(out).collect()) == [("x", True), ("x", True), ("y", True)]


SEEN = "db_id string, seq long, note string, big long"


def test_seen_once_whatever_the_distance(spark, tmp_path):
    rng = random.Random(5)
    batches = [[(rng.choice(["d", "e"]), rng.randint(0, 300), f"{b}", rng.choice([None, 2**62 + b])) for _ in range(80)] for b in range(5)]
    batches[2] += [("d", None, "x", None), ("d", None, "x", 7)]
    shape = lambda s: state.seen_once(s, ["db_id", "seq", "note", "big"], 64)
    out, ckpt = fed(spark, tmp_path, batches, shape, SEEN, mode="append")
    rows = spark.read.parquet(out).collect()
    got = [(r.db_id, r.seq) for r in rows]
    assert {(r.db_id, r.seq, r.note, r.big) for r in rows} <= {x for b in batches for x in b}
    seen = {(d, s) for b in batches for d, s, *_ in b if s is not None}
    assert sorted(x for x in got if x[1] is not None) == sorted(seen) and got.count(("d", None)) == 2
    spans = runs.collection(spark, ckpt, "spans").collect()
    held = {(r.db_id, s) for r in spans for s in range(r.entry.lo, r.at.hi + 1)}
    starts = {(d, s) for d, s in seen if (d, s - 1) not in seen or s % 64 == 0}
    assert held == seen and len(spans) == len(starts)


def test_a_whole_shard_is_one_row(spark, tmp_path):
    numbers = list(range(256))
    random.Random(1).shuffle(numbers)
    batches = [[("d", s, "", 1) for s in numbers[i : i + 64]] for i in range(0, 256, 64)]
    _, ckpt = fed(spark, tmp_path, batches, lambda s: state.seen_once(s, ["seq"], 128), SEEN, mode="append")
    assert sorted((r.entry.lo, r.at.hi) for r in runs.collection(spark, ckpt, "spans").collect()) == [(0, 127), (128, 255)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_only_the_batch_moves(spark):
    held = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("key"), F.col("id").alias("value"))
    asked = spark.createDataFrame([("7",), ("7",), ("x",), (None,)], "key string")
    with colocated.stored(held, ["key"], 8) as name:
        rows = colocated.lookup(asked, spark.table(name), ["key"])
        assert exchanges(rows) == 1 and exchanges(spark.table(name).groupBy("key").agg(F.max("value"))) == 0
        assert sorted((r.key, r.value) for r in rows.where("key IS NOT NULL").collect()) == [("7", 7), ("7", 7), ("x", None)]
        with colocated.stored(held.withColumnRenamed("value", "other"), ["key"], 8) as second:
            assert exchanges(colocated.lookup(spark.table(name), spark.table(second), ["key"])) == 0
    assert not spark.catalog.tableExists(name) and not spark.catalog.tableExists(second)


def test_stored_table_in_a_stream(spark, tmp_path):
    log_ = ordered.arrange(spark.range(100).select(F.col("id").alias("seq"), F.pmod("id", F.lit(9)).cast("string").alias("key")), f"{tmp_path}/log", "seq", 3)
    own = runs.stream_session(spark, 2)
    with colocated.stored(spark.range(5).select(F.col("id").cast("string").alias("key"), (F.col("id") * 2).alias("value")), ["key"], 4) as name:
        begin = lambda: runs.start(colocated.lookup(ordered.stream(own, log_), own.table(name), ["key"]), f"{tmp_path}/ckpt", runs.batch_writer(f"{tmp_path}/out"), "append", to_end=False)
        ordered.drained(begin)
    got = {r.seq: r.value for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {i: (i % 9) * 2 if i % 9 < 5 else None for i in range(100)}


def test_sketches_merge_in_any_order(spark):
    df = spark.range(30_000).select(F.pmod("id", F.lit(3)).alias("g"), F.pmod("id", F.lit(50)).alias("part"), F.col("id").cast("double").alias("v"))
    parts = sketches.sketch(df, ["g", "part"], "v", 400)
    whole = sketches.quantiles(sketches.merge(sketches.merge(parts.withColumn("half", F.col("part") < 11), ["g", "half"]), ["g"]), {"p10": 0.1, "p90": 0.9})
    got = sketches.ranks(df, whole, "g", "v", ["p10", "p90"]).collect()
    error = 3 * sketches.rank_error(400)
    assert len(got) == 3
    for r in got:
        assert r.n == 10_000 and r.p10_below <= 0.1 + error and r.p10_upto >= 0.1 - error and r.p90_below <= 0.9 + error and r.p90_upto >= 0.9 - error
    assert {r.n for r in whole.select(sketches.rows().alias("n")).collect()} == {10_000}


def test_a_shard_of_many_gaps_is_one_row(spark, tmp_path):
    """Every second position, twice over: as many intervals as positions, but a row of state a shard."""
    batches = [[("d", s, "", 1) for s in range(0, 2000, 2)]] * 2
    out, ckpt = fed(spark, tmp_path, batches, lambda s: state.seen_once(s, ["seq"], 1024), SEEN, mode="append")
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == list(range(0, 2000, 2))
    assert runs.collection(spark, ckpt, "spans").count() == 1000
    assert spark.read.format("statestore").option("stateVarName", "spans").option("flattenCollectionTypes", "true").load(ckpt).count() == 2


def test_sets_share_buckets(spark, tmp_path):
    """400 keys in 4 groups: every key has its own set, and the positions of their puts take a row of state a group."""
    first = [("d", f"k{i}", "put", "x", 2 * i) for i in range(400)] + [("d", f"k{i}", "merge", "y", 2 * i + 1) for i in range(400)]
    shape = lambda s: state.live_set(state.set_operands(s, F.col("element")), buckets=4)
    _, ckpt = fed(spark, tmp_path, [first, [("d", "k7", "delete", None, 1000), ("d", "k8", "put", "z", 1001)]], shape, OPS)
    got = {(r.key, r.entry.element) for r in runs.collection(spark, ckpt, "elements").collect()}
    assert got == {(f"k{i}", e) for i in range(400) if i not in (7, 8) for e in "xy"} | {("k8", "z")}
    assert spark.read.format("statestore").option("stateVarName", "base").load(ckpt).count() <= 4
