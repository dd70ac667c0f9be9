"""Commits, crashes, snapshots, pins and removal of files, on small tables of files really written."""

import os

import pytest
from pyspark.sql import functions as F

from statekit.sources import manifest, stores

SCHEMA = "key string, seq long, shard int"


def rows(spark, lo, hi, shards=2):
    return spark.range(lo, hi).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("seq"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def seqs(spark, root, version=None, only=None):
    df = manifest.read(spark, root, rows(spark, 0, 1).schema, version, only)
    return sorted(r.seq for r in df.collect())


def add(spark, root, lo, hi):
    return manifest.commit(spark, root, manifest.write(rows(spark, lo, hi), root))


def at(days):
    return F.current_timestamp() + F.make_dt_interval(days=F.lit(days))


def statuses(spark, root, now, age=900):
    found = manifest.judged(spark, root, now, age).groupBy("status").agg(F.sum("rows").alias("n")).collect()
    return {r.status: r.n for r in found}


def test_a_version_is_a_snapshot(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert manifest.newest(root) is None and seqs(spark, root) == [] and statuses_of_nothing(spark, root)
    first, second = add(spark, root, 0, 10), add(spark, root, 10, 20)
    assert (first, second) == (1, 2)
    assert seqs(spark, root, first) == list(range(10)) and seqs(spark, root) == list(range(20))
    assert seqs(spark, root, only=F.col("shard") == 1) == list(range(1, 20, 2))
    assert seqs(spark, root, only=F.col("lo") >= 10) == list(range(10, 20))


def statuses_of_nothing(spark, root):
    return manifest.live(spark, root).isEmpty() and manifest.pins(spark, root).isEmpty()


def test_crash_between_data_and_manifest(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    add(spark, root, 0, 10)
    manifest.write(rows(spark, 10, 20), root)
    assert seqs(spark, root) == list(range(10))
    assert statuses(spark, root, at(0)) == {"live": 10, "too_young": 10}
    assert statuses(spark, root, at(1)) == {"live": 10, "deletable": 10}
    add(spark, root, 10, 20)
    assert seqs(spark, root) == list(range(20))
    judged = manifest.judged(spark, root, at(1), 900)
    assert manifest.sweep(spark, judged) == 2
    assert statuses(spark, root, at(1)) == {"live": 20} and seqs(spark, root) == list(range(20))
    assert manifest.sweep(spark, manifest.judged(spark, root, at(1), 900)) == 0


def test_crash_within_the_manifest(spark, tmp_path):
    """A manifest that was begun is no version; its number is not used again."""
    root = f"file://{tmp_path}/t"
    add(spark, root, 0, 10)
    os.makedirs(f"{tmp_path}/t/manifest/version=2/_temporary/0/_temporary")
    with open(f"{tmp_path}/t/manifest/version=2/_temporary/0/_temporary/part-0.parquet", "w") as f:
        f.write("half")
    assert manifest.newest(root) == 1 and seqs(spark, root) == list(range(10))
    assert add(spark, root, 10, 20) == 3 and seqs(spark, root) == list(range(20))
    assert statuses(spark, root, at(1)) == {"live": 20}


def test_a_version_is_written_once(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    add(spark, root, 0, 10)
    more = manifest.write(rows(spark, 10, 20), root)
    monkeypatch.setattr(manifest, "versions", lambda root: ([], 0))  # a writer that has not seen the first commit
    with pytest.raises(Exception, match="(?i)already exists"):
        manifest.commit(spark, root, more)
    monkeypatch.undo()
    assert seqs(spark, root) == list(range(10))


def test_pins_hold_until_they_expire(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for k in range(4):
        version = add(spark, root, 10 * k, 10 * k + 10)
        if k == 1:
            manifest.pin(spark, root, "two", version, F.lit("2100-01-01"))
    before, after = manifest.compact(spark, root, rows(spark, 0, 1).schema, lambda df: df.where("seq >= 5"), 3)
    assert (before, after) == (4, 5) and seqs(spark, root) == list(range(5, 40))
    assert statuses(spark, root, at(1)) == {"live": 35, "pinned": 20, "deletable": 20}
    assert statuses(spark, root, F.lit("2101-01-01").cast("timestamp")) == {"live": 35, "deletable": 40}
    assert manifest.sweep(spark, manifest.judged(spark, root, at(1), 900)) == 4
    assert seqs(spark, root, 2) == list(range(20)) and seqs(spark, root) == list(range(5, 40))


def test_compaction_touches_crowded_shards_only(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for lo, hi, step in ((0, 10, 1), (10, 20, 2), (20, 30, 2)):
        mine = rows(spark, lo, hi).where(F.pmod("seq", F.lit(step)) == 0)
        manifest.commit(spark, root, manifest.write(mine, root))
    before, after = manifest.compact(spark, root, rows(spark, 0, 1).schema, lambda df: df, 2)
    report = {r.shard: (r.files_before, r.files_after, r.files_kept, r.rows_before, r.rows_after) for r in manifest.change_report(spark, root, before, after).collect()}
    assert report == {0: (3, 1, 0, 15, 15), 1: (1, 1, 1, 5, 5)}
    assert manifest.compact(spark, root, rows(spark, 0, 1).schema, lambda df: df, 2) == (after, after)


def test_footers(spark, tmp_path):
    df = spark.range(100).select("id", F.timestamp_micros(F.col("id")).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") > 200, 1).cast("long").alias("none"))
    df.coalesce(1).write.option("parquet.block.row.count.limit", 30).parquet(f"{tmp_path}/p")
    got = stores.row_groups(spark, f"{tmp_path}/p", ["id", "ts", "none"]).orderBy("row_group").collect()
    assert [(r.rows, r.id.lo, r.id.hi, r.ts.lo, r.ts.hi) for r in got] == [(30, 0, 29, 0, 29), (30, 30, 59, 30, 59), (30, 60, 89, 60, 89), (10, 90, 99, 90, 99)]
    assert [(r.none.lo, r.none.nulls, r.id.nulls) for r in got][0] == (None, 30, 0)
    assert len({r.file_bytes for r in got}) == 1 and os.path.getsize(got[0].file.removeprefix("file:").replace("///", "/")) == got[0].file_bytes


def test_a_stream_of_many_tasks_keeps_few_files(spark, tmp_path):
    """A stateful stream runs without adaptive execution; five state partitions leave one file a shard and batch, not five."""
    from statekit.streaming import ordered, runs, state

    own, root = runs.stream_session(spark, 5), f"file://{tmp_path}/t"
    df = spark.range(400).select(F.pmod("id", F.lit(97)).cast("string").alias("key"), F.col("id").alias("seq"))
    log = ordered.arrange(df, f"{tmp_path}/log", "seq", 4)
    sharded = lambda s: state.counter(s).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(3)).cast("int"))
    newest = lambda df: df.groupBy("key", "shard").agg(F.max("n").alias("n")).select("key", "n", "shard")
    sink = manifest.batch_sink(root, newest, 2, "n")
    ordered.drained(lambda: runs.start(sharded(ordered.stream(own, log)), f"{tmp_path}/ckpt", sink, to_end=False))
    per_shard = [r["count"] for r in manifest.live(spark, root).groupBy("shard").count().collect()]
    assert len(per_shard) == 3 and max(per_shard) <= 2
    got = {r.key: r.n for r in newest(manifest.read(spark, root, spark.createDataFrame([], "key string, n long, shard int").schema)).collect()}
    assert got == {str(k): 4 + (k < 400 - 4 * 97) for k in range(97)}


def test_a_large_shard_stays_within_its_files(spark, tmp_path, monkeypatch):
    """A compaction splits by size, but never into more files than allowed."""
    monkeypatch.setattr(manifest, "FILE_BYTES", 100, raising=False)
    own, root = spark.newSession(), f"file://{tmp_path}/t"
    own.conf.set("spark.sql.adaptive.enabled", "false")
    for k in range(4):
        add(spark, root, 100 * k, 100 * k + 100)
    manifest.compact(own, root, rows(own, 0, 1).schema, lambda df: df.repartition(6), 3)
    per_shard = [r["count"] for r in manifest.live(spark, root).groupBy("shard").count().collect()]
    assert len(per_shard) == 2 and 1 < max(per_shard) <= 3 and seqs(spark, root) == list(range(400))
