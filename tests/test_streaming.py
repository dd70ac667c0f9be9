"""Streaming behaviour that the registered queries do not show."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from statekit.plans import REGISTRY
from statekit.streaming import runs, state
from tests.test_golden import TRACE


def staged(df, path, seq, parts):
    for lo, hi in runs.cuts(df, seq, parts):
        runs.stage(df, path, seq, lo, hi)


def one_file_each(spark, path, rows, schema):
    """Each row as its own source file, in order."""
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def test_recovery_counts_each_record_once(spark, tmp_path):
    own = runs.stream_session(spark, 2)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = spark.range(60).select((F.concat(F.lit("key-"), (F.col("id") % 6).cast("string"))).alias("key"), F.col("id").alias("seq"))
    staged(df, src, "seq", 6)
    tries = []
    write = runs.failing_after(runs.batch_writer(out), 3)

    def begin():
        tries.append(1)
        stream = runs.replayable(own, src, df.schema, per_batch=1)
        return runs.start(state.counter(stream), str(tmp_path / "ckpt"), write)

    runs.with_restarts(begin)
    assert len(tries) == 2
    got = runs.newest_batch(spark, out, ["key"], ["n"]).collect()
    assert {x.key: x.n for x in got} == {f"key-{i}": 10 for i in range(6)}
    meta = runs.state_metadata(spark, str(tmp_path / "ckpt")).first()
    assert meta.numPartitions == 2


def test_fail_fast_names_the_cause(spark, tmp_path):
    own = runs.stream_session(spark, 1)
    src = str(tmp_path / "src")
    df = spark.range(10).select(F.col("id").cast("string").alias("key"), F.col("id").alias("seq"))
    staged(df, src, "seq", 1)

    def broken(batch, number):
        raise RuntimeError("disk on fire")

    with pytest.raises(StreamingQueryException, match="disk on fire"):
        runs.with_restarts(lambda: runs.start(runs.replayable(own, src, df.schema), str(tmp_path / "c"), broken, "append"), restarts=0)


def test_tier_trace_on_a_stream(spark, tmp_path):
    """One event per file, so that the watermark moves between the events."""
    own = runs.stream_session(spark, 2)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    shift = 1_000_000
    # Two far later events of another key let the last timers fire.
    rows = [(k, ms + shift) for k, ms in TRACE] + [("end", shift + 50_000), ("end", shift + 60_000)]
    one_file_each(spark, src, rows, "key string, ms long")
    stream = runs.replayable(own, src, spark.createDataFrame([], "key string, ms long").schema, per_batch=1)
    touches = stream.select("key", F.timestamp_millis("ms").alias("ts"))
    runs.drain(runs.start(state.tiers(state.combine(touches), 100), str(tmp_path / "ckpt"), runs.batch_writer(out)))
    trail = spark.read.parquet(out).where("key <> 'end'").collect()
    counts = {}
    for x in trail:
        counts[x.key] = max(counts.get(x.key, 0), x.n)
    assert counts == {"hot": 14, "A": 3, "B": 3}
    at = sorted((x.what, x.key, x.at_ms - shift) for x in trail if x.what != "touch")
    assert at == [
        ("demote", "A", 130), ("demote", "A", 630), ("demote", "B", 140), ("demote", "B", 640),
        ("demote", "hot", 840), ("promote", "A", 530), ("promote", "B", 540),
    ]
    cold = runs.state_of(spark, str(tmp_path / "ckpt"), variable="cold")
    assert {x.key.key: x.value.n for x in cold.collect()} == {"hot": 14, "A": 3, "B": 3}


def test_late_events_are_dropped_behind_the_watermark(spark, tmp_path):
    own = runs.stream_session(spark, 1)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    # Lateness is judged by the watermark of the batch before, so the late event comes two batches after.
    late_third = [("a", s * 1000) for s in (1000, 2000, 2100, 1000, 3000)]
    one_file_each(spark, src, late_third, "key string, ms long")
    stream = runs.replayable(own, src, spark.createDataFrame([], "key string, ms long").schema, per_batch=1)
    clocked = runs.event_time(stream.select("key", F.timestamp_millis("ms").alias("ts")))
    counts = clocked.groupBy(F.window("ts", "10 seconds")).agg(F.count(F.lit(1)).alias("n"))
    progress = runs.Progress(own)
    q = runs.drain(runs.start(counts, str(tmp_path / "ckpt"), runs.batch_writer(out)))
    with pytest.raises(ValueError):
        runs.no_late_rows(progress.of(q))
    late = runs.progress_metrics(spark, progress.of(q)).where("name = 'late_rows'").agg(F.sum("value")).first()[0]
    assert late == 1.0


def test_simple_sinks(spark, tmp_path):
    src = str(tmp_path / "src")
    df = spark.range(10).select(F.col("id").cast("string").alias("key"), F.col("id").alias("seq"))
    staged(df, src, "seq", 2)
    stream = runs.replayable(spark, src, df.schema)
    runs.drain(runs.simple_sink(stream, "memory", str(tmp_path / "m"), "kept"))
    assert spark.table("kept").count() == 10
    runs.drain(runs.simple_sink(runs.replayable(spark, src, df.schema), "noop", str(tmp_path / "n")))
    with pytest.raises(ValueError):
        runs.simple_sink(stream, "socket", str(tmp_path / "s"))


def test_batched_lookup(spark):
    def double(pdf):
        return pdf.assign(value=pdf["id"] * 2)

    got = state.enrich_batches(spark.range(100), double, "id long, value long")
    assert got.where("value <> id * 2").isEmpty() and got.count() == 100


def test_combine_shrinks_a_hot_key(spark):
    df = spark.range(5000).select(F.lit("hot").alias("key"), F.timestamp_millis(F.col("id")).alias("ts"))
    rows = state.combine(df).collect()
    assert sum(x.n for x in rows) == 5000 and len(rows) <= 8


def events_in(spark, path, files, stretch=1):
    """The events dealt by hash into so many files, with event times stretched."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) * stretch - (stretch - 1) * 1_700_000_000_000_000)
    e.withColumn("ts", at.cast("timestamp_ntz")).repartition(files, F.xxhash64("event_id")).write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["stream_fold", "stream_tiering", "stream_dedupe", "stream_checkpoints"])
def test_result_does_not_depend_on_the_files(spark, tmp_path, name):
    rows = lambda d: sorted(map(str, REGISTRY[name].run(spark, d).collect()))
    want = rows("/root/testdata/sf0.001")
    assert want and rows(events_in(spark, tmp_path / "8", 8)) == want


def test_dedupe_over_years(spark, tmp_path):
    d = events_in(spark, tmp_path, 4, stretch=40)
    assert REGISTRY["stream_dedupe"].run(spark, d).count() == spark.read.parquet(f"{d}/events.parquet").count()


def test_progress_keeps_every_report(spark, tmp_path):
    own = runs.stream_session(spark, 1)
    own.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    rows = [(str(i), i) for i in range(5)]
    one_file_each(spark, str(tmp_path / "src"), rows, "key string, seq long")
    progress = runs.Progress(own)
    stream = runs.replayable(own, str(tmp_path / "src"), spark.createDataFrame([], "key string, seq long").schema, per_batch=1)
    q = runs.drain(runs.start(state.counter(stream), str(tmp_path / "c"), runs.batch_writer(str(tmp_path / "o"))))
    got = runs.progress_metrics(spark, progress.of(q)).where("name = 'input_rows'").agg(F.sum("value")).first()[0]
    assert got == 5


def test_null_keys_are_combined(spark):
    df = spark.range(100).select(F.when(F.col("id") % 2 == 0, "k").alias("key"), F.timestamp_millis(F.col("id")).alias("ts"))
    rows = state.combine(df).groupBy("key").agg(F.sum("n").alias("n")).collect()
    assert {x.key: x.n for x in rows} == {"k": 50, None: 50}


@pytest.mark.parametrize("name", ["stream_rescale", "stream_rescale_savepoint"])
def test_thirds_are_cut_once(spark, monkeypatch, name):
    """Quantiles that come out otherwise each time neither lose nor double a record."""
    d, plain, calls = "/root/testdata/sf0.001", runs.row_cuts, []

    def wobbling(*args):
        calls.append(1)
        (lo, a), (_, b), (_, hi) = plain(*args)
        return [(lo, a + 7 * len(calls)), (a + 7 * len(calls), b - 5 * len(calls)), (b - 5 * len(calls), hi)]

    monkeypatch.setattr(runs, "row_cuts", wobbling)
    got = {r.key: r.n for r in REGISTRY[name].run(spark, d).collect()}
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").cast("string").alias("key")).count().collect()
    assert got == {r.key: r["count"] for r in rows}


def test_tiers_move_keys_by_buckets(spark, tmp_path):
    """3,000 keys in 8 groups: state has a row a group, the trail a row a key, and timers of one group fire each at its time."""
    own, src, out, ckpt = runs.stream_session(spark, 2), f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/ckpt"
    start = 1_000_000
    first = [(f"k{i}", start + i) for i in range(3000)] + [(None, start)]
    for rows in (first, [("k7", start + 2050)], [("end", start + 2101)], [("k0", start + 2102)], [("end", start + 9_000)], [("end", start + 9_001)]):
        spark.createDataFrame(rows, "key string, ms long").coalesce(1).write.mode("append").parquet(src)
    stream = runs.replayable(own, src, spark.createDataFrame([], "key string, ms long").schema, per_batch=1)
    touches = stream.select("key", F.timestamp_millis("ms").alias("ts"))
    runs.drain(runs.start(state.tiers(state.combine(touches), 2000, "3000 milliseconds", buckets=8), ckpt, runs.batch_writer(out)))
    trail = spark.read.parquet(out).where("key IS DISTINCT FROM 'end'")
    gone = {(r.key, r.at_ms - start, r.n) for r in trail.where("what = 'demote'").collect()}
    # k0 and k7 were touched again before their time, so they go once and late.
    assert gone == {(f"k{i}", i + 2000, 1) for i in range(3000) if i not in (0, 7)} | {(None, 2000, 1), ("k0", 4102, 2), ("k7", 4050, 2)}
    raw = spark.read.format("statestore").option("stateVarName", "cold").load(ckpt)
    assert raw.count() <= 8 and runs.state_of(spark, ckpt, variable="cold").count() == 3001


def test_counter_takes_over_in_buckets(spark, tmp_path):
    own, src, ckpt = runs.stream_session(spark, 2), f"{tmp_path}/src", f"{tmp_path}/ckpt"
    df = spark.range(600).select(F.when(F.col("id") % 300 > 0, F.pmod("id", F.lit(300)).cast("string")).alias("key"), F.timestamp_millis("id").alias("ts"))
    df.write.parquet(src)
    seed = own.createDataFrame([("7", 100), ("old", 5), (None, 50)], "key string, n long")
    counts = state.seeded_counter(state.combine(runs.replayable(own, src, df.schema)), seed, 4)
    runs.drain(runs.start(counts, ckpt, runs.batch_writer(f"{tmp_path}/out")))
    got = {r.key.key: r.value.n for r in runs.state_of(spark, ckpt, variable="n").collect()}
    assert got == {**{str(i): 2 for i in range(1, 300)}, None: 52, "7": 102, "old": 5}
    assert spark.read.format("statestore").option("stateVarName", "n").load(ckpt).count() <= 4
