"""The ordered log source: batches, restarts, laps, ticks, ties, many ranges, and tiers that move between queries."""

import pytest
from pyspark.sql import functions as F

from statekit.sources import stores
from statekit.streaming import ordered, runs, state
from tests.test_golden import TRACE


def numbered(spark, n, files=4):
    df = spark.range(n).select((F.col("id") * 3).alias("seq"), F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("ts"))
    return df.repartition(files, F.xxhash64("seq"))


def collected(own, log, path, seen, fail_after=None, **options):
    """Run a plain copy of the log; ``seen`` gets (batch, lowest, highest, rows, laps) as each batch comes."""
    failures = []

    def write(df, number):
        rows = df.select("seq", "lap").collect()
        if not rows:  # the only batch of an empty log
            return
        seen.append((number, min(r.seq for r in rows), max(r.seq for r in rows), len(rows), sorted({r.lap for r in rows})))
        if fail_after == number and not failures:
            failures.append(number)
            raise RuntimeError("induced")

    return ordered.drained(lambda: runs.start(ordered.stream(own, log, **options), path, write, "append", to_end=False))


def test_batches_are_disjoint_and_ascending(spark, tmp_path):
    own, log, seen = runs.stream_session(spark, 2), ordered.arrange(numbered(spark, 1000), f"{tmp_path}/log", "seq", 7), []
    collected(own, log, f"{tmp_path}/ckpt", seen)
    assert len(seen) == log.batches >= 7 and sum(s[3] for s in seen) == log.rows == 1000
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:], strict=False)) and max(s[3] for s in seen) <= 142 * 9 / 8


def test_restart_repeats_the_failed_batch_only(spark, tmp_path):
    own, log, seen = runs.stream_session(spark, 2), ordered.arrange(numbered(spark, 600), f"{tmp_path}/log", "seq", 6), []
    collected(own, log, f"{tmp_path}/ckpt", seen, fail_after=2)
    assert [s[0] for s in seen] == [0, 1, 2, 2, 3, 4, 5][: len(seen)] and seen[2] == seen[3]
    # A finished query that starts again finds nothing new.
    before = len(seen)
    collected(own, log, f"{tmp_path}/ckpt", seen)
    assert len(seen) == before


def test_every_row_group_is_planned_once(spark, tmp_path):
    log = ordered.arrange(numbered(spark, 500), f"{tmp_path}/log", "seq", 9)
    reader = ordered.OrderedReader({"path": log.path, "first": "0", "until": str(log.batches), "laps": "1", "ticks": "0"})
    at, planned = reader.initialOffset(), []
    while reader.latestOffset() != at:
        end = reader.latestOffset()
        planned += [(p.file, p.row_group) for p in reader.partitions(at, end)]
        at = end
    groups = stores.row_groups(spark, f"{log.path}/data", ["seq"]).collect()
    assert sorted(planned) == sorted((g.file, g.row_group) for g in groups) and len(groups) > log.batches
    assert sum(g.rows for g in groups) == 500 and max(g.seq.hi for g in groups) == 1497


def test_equal_numbers_stay_together(spark, tmp_path):
    df = spark.range(900).select(F.when(F.col("id") < 300, 5).otherwise(F.col("id")).cast("long").alias("seq"))
    own, log, seen = runs.stream_session(spark, 2), ordered.arrange(df.repartition(3), f"{tmp_path}/log", "seq", 30), []
    collected(own, log, f"{tmp_path}/ckpt", seen, until=2)
    assert seen[0][1:3] == (5, 5) and seen[0][3] == 300 and seen[1][1] == 300


def test_ten_thousand_ranges(spark, tmp_path):
    """As many batches as asked for; time runs backwards by one batch in the middle."""
    df = numbered(spark, 20_000).withColumn("ts", F.when(F.col("seq") == 30_000, F.timestamp_micros(F.lit(0)).cast("timestamp_ntz")).otherwise(F.col("ts")))
    log = ordered.arrange(df, f"{tmp_path}/log", "seq", 10_000, "ts")
    assert log.batches == 10_000 and ordered.delay(spark, log) == "9999000 milliseconds"
    own, seen = runs.stream_session(spark, 1), []
    collected(own, log, f"{tmp_path}/ckpt", seen, first=9_990)
    assert len(seen) == 10 and seen[-1][2] == 59_997


def test_laps_lead_and_ticks(spark, tmp_path):
    own, log, seen = runs.stream_session(spark, 1), ordered.arrange(numbered(spark, 80), f"{tmp_path}/log", "seq", 4), []
    collected(own, log, f"{tmp_path}/ckpt", seen, first=1, until=3, laps=2, lead=True, ticks=1)
    assert [s[4] for s in seen] == [[-1], [0], [0], [1], [1], [2]]
    assert seen[0][2] < seen[1][1] and seen[1][1:4] == seen[3][1:4] and seen[5][1:4] == seen[2][1:4]


def test_odd_logs(spark, tmp_path):
    own, seen = runs.stream_session(spark, 1), []
    empty = ordered.arrange(numbered(spark, 0), f"{tmp_path}/empty", "seq", 5, "ts")
    assert (empty.batches, empty.rows, ordered.delay(spark, empty)) == (0, 0, "0 milliseconds")
    collected(own, empty, f"{tmp_path}/ckpt", seen)
    assert seen == []
    with pytest.raises(ValueError, match="no seq"):
        ordered.arrange(spark.createDataFrame([(1,), (None,)], "seq long"), f"{tmp_path}/null", "seq", 2)


def test_another_active_session(spark, tmp_path):
    """A session that knows the source and is the thread's active one does not stand in the way of the next."""
    log, seen = ordered.arrange(numbered(spark, 20), f"{tmp_path}/log", "seq", 2), []
    for k in range(2):
        own = runs.stream_session(spark, 1)
        collected(own, log, f"{tmp_path}/ckpt-{k}", seen)
        own.createDataFrame([(1,)], "x int").count()  # makes it the active one
    assert len(seen) == 2 * log.batches
    spark.createDataFrame([(1,)], "x int").count()


SHIFT = 1_000_000


def one_by_one(spark, tmp_path):
    rows = [(i, k, ms + SHIFT) for i, (k, ms) in enumerate([*TRACE, ("end", 50_000), ("end", 60_000)])]
    df = spark.createDataFrame(rows, "seq long, user string, ms long").withColumn("ts", F.timestamp_millis("ms").cast("timestamp_ntz"))
    return ordered.arrange(df.select("seq", "user", "ts"), f"{tmp_path}/log", "seq", len(rows), "ts")


def trail_of(spark, out):
    rows = spark.read.parquet(out).where("key <> 'end' AND what <> 'touch'").collect()
    return sorted((x.what, x.key, x.at_ms - SHIFT, x.n) for x in rows)


def test_tier_trace_survives_a_rescale(spark, tmp_path):
    """The worked example with one event a batch: handed over at several places, the trail stays as it was."""
    log = one_by_one(spark, tmp_path)
    want = [
        ("demote", "A", 130, 2), ("demote", "A", 630, 3), ("demote", "B", 140, 2), ("demote", "B", 640, 3),
        ("demote", "hot", 840, 14), ("promote", "A", 530, 2), ("promote", "B", 540, 2),
    ]
    out, seed = f"{tmp_path}/out", None
    for partitions, first, until in ((2, 0, 7), (4, 7, 18), (1, 18, log.batches)):
        own, ckpt = runs.stream_session(spark, partitions), f"{tmp_path}/ckpt-{until}"
        held = None if seed is None else own.createDataFrame(seed, "key string, hot long, last_ms long, cold long")
        begin = lambda own=own, ckpt=ckpt, first=first, until=until, held=held: runs.start(
            state.tiers(state.touches(ordered.stream(own, log, first=first, until=until, lead=True), F.col("user")), 100, seed=held),
            ckpt, runs.batch_writer(f"{out}/until={until}"), to_end=False,
        )
        ordered.drained(begin)
        assert runs.state_metadata(spark, ckpt).first().numPartitions == partitions
        seed = state.tier_seed(runs.state_of(spark, ckpt, variable="hot"), runs.state_of(spark, ckpt, variable="cold")).collect()
    assert trail_of(spark, out) == want
    assert {r.key: r.cold for r in seed if r.key != "end"} == {"hot": 14, "A": 3, "B": 3}
    due = {r.key: r.due_ms - SHIFT for r in runs.pending_timers(spark, ckpt).collect()}
    assert due == {"end": 60_100}


@pytest.mark.parametrize("file_rows", [50, 130])
def test_many_files_make_the_batches_of_one(spark, tmp_path, monkeypatch, file_rows):
    """Files are cut at exact ranks: each batch has the same rows, however many files the log takes, and no file is large."""
    odd = numbered(spark, 1003).withColumn("seq", F.col("seq") * F.col("seq"))  # far apart at the end
    shape = lambda log: [tuple(r) for r in ordered.index(spark, log).groupBy("batch").agg(F.min("lo"), F.max("hi"), F.sum("rows")).sort("batch").collect()]
    want = shape(ordered.arrange(odd, f"{tmp_path}/one", "seq", 6))
    monkeypatch.setattr(ordered, "FILE_ROWS", file_rows)
    many = ordered.arrange(odd, f"{tmp_path}/many", "seq", 6)
    assert shape(many) == want and len(want) >= 6
    files = ordered.index(spark, many).groupBy("file").agg(F.sum("rows").alias("rows")).collect()
    assert len(files) > 5 and max(f.rows for f in files) <= file_rows + 20


def test_many_files_with_equal_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "FILE_ROWS", 40)
    df = spark.range(500).select(F.when(F.col("id") < 300, 5).otherwise(F.col("id")).cast("long").alias("seq"))
    log = ordered.arrange(df.repartition(3), f"{tmp_path}/log", "seq", 10)
    assert log.rows == 500 and sorted(r.seq for r in spark.read.parquet(f"{log.path}/data").collect()) == [5] * 300 + list(range(300, 500))
    bounds = ordered.index(spark, log).groupBy("batch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).sort("batch").collect()
    assert all(a.hi < b.lo for a, b in zip(bounds, bounds[1:], strict=False))


@pytest.mark.parametrize("n", [1000, 1003])
def test_a_large_row_group_is_cut_into_files(spark, tmp_path, monkeypatch, n):
    """No task sorts more than FILE_ROWS rows, however few batches are asked for, and the batches stay the same."""
    def batches(name):
        log = ordered.arrange(numbered(spark, n), f"{tmp_path}/{name}", "seq", 2, "ts")
        rows = ordered.index(spark, log)
        return rows.groupBy("batch").agg(F.sum("rows").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).sort("batch").collect(), rows

    whole, _ = batches("whole")
    monkeypatch.setattr(ordered, "FILE_ROWS", 20)
    cut, rows = batches("cut")
    assert cut == whole
    assert max(r.rows for r in rows.groupBy("file").agg(F.sum("rows").alias("rows")).collect()) <= 20
