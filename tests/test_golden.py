"""The small worked examples, with their exact results."""

import pytest
from pyspark.sql import functions as F

from statekit.functions import routing as r
from statekit.operators import layout, log, metrics, records, reshape, scans, tiering, upkeep
from statekit.sources import files

LOG = "db_id string, key string, op string, value int, seq long"


def oplog(spark, rows, db="d"):
    return spark.createDataFrame([(db, k, op, v, i) for i, (op, k, v) in enumerate(rows)], LOG).withColumns(
        {"create_ts": F.lit(None).cast("timestamp_ntz"), "expire_ts": F.lit(None).cast("timestamp_ntz")}
    )


def as_dict(df, key="key", value="value"):
    return {row[key]: row[value] for row in df.collect()}


# Routing


def test_key_groups(spark):
    names = ["user-1", "user-2", "abc", "", "\U0001f600", "x" * 5000] + [f"k-{i}" for i in range(5000)]
    df = spark.createDataFrame([(n,) for n in names], "key string")
    once = layout.routed(df, 128, 4)
    report = layout.ownership_check(once, 128, [1, 3, 4, 128]).collect()
    assert {(x.keys, x.out_of_bounds, x.misplaced) for x in report} == {(len(names), 0, 0)}
    again = as_dict(layout.routed(df.repartition(5), 128, 4), value="key_group")
    assert again == as_dict(once, value="key_group")
    # A small number of groups still spreads the keys, and a wide one needs two bytes.
    assert len(set(as_dict(layout.routed(df, 16, 4), value="key_group").values())) == 16
    assert r.group_width(128) == 1 and r.group_width(129) == 2


@pytest.mark.parametrize("groups,parallelism", [(128, 1), (128, 3), (128, 4), (64, 3), (128, 128), (7, 5)])
def test_ranges_tile(spark, groups, parallelism):
    ranges = r.subtask_ranges(spark, groups, parallelism)
    assert [x.tiles for x in layout.tiling_check(ranges, groups).collect()] == [True] * parallelism
    owners = r.expand_groups(ranges).select("subtask", r.owner("key_group", groups, parallelism).alias("o"))
    assert owners.count() == groups and owners.where("subtask <> o").isEmpty()


def test_ranges_for_three(spark):
    got = [(x.subtask, x.lo, x.hi) for x in r.subtask_ranges(spark, 128, 3).orderBy("subtask").collect()]
    assert got == [(0, 0, 42), (1, 43, 85), (2, 86, 127)]


def test_tiling_check_finds_gap_and_overlap(spark):
    bad = spark.createDataFrame([(0, 0, 4), (1, 6, 8), (2, 8, 9)], "subtask int, lo int, hi int")
    got = {x.subtask: (x.gap_before, x.tiles) for x in layout.tiling_check(bad, 10).collect()}
    assert got == {0: (0, False), 1: (1, False), 2: (-1, False)}


def test_bad_parallelism():
    for groups, p in ((128, 0), (128, 129), (0, 1), (40000, 2)):
        with pytest.raises(ValueError):
            r.check_parallelism(groups, p)
    with pytest.raises(ValueError):
        r.shard("key_group", 128, 7)


def test_modulo_stream(spark):
    keyed = files.sequence(spark, 0, 999).select((F.col("id") % 50).cast("string").alias("key"))
    placed = layout.routed(layout.keyed_count(keyed), 64, 3, 16)
    report = layout.range_report(placed, 64, 3).collect()
    assert sum(x.rows for x in report) == 1000 and sum(x.keys for x in report) == 50
    assert all(x.rows > 0 and x.lo <= x.first_group <= x.last_group <= x.hi for x in report)


def test_encoded_keys_keep_the_order_past_one_byte(spark):
    df = spark.createDataFrame([(1, "b"), (255, "a"), (256, "a"), (1, "a")], "key_group int, key string")
    enc = df.select("*", r.encoded_key("key_group", "key", 1024, "s").alias("e"))
    got = [(x.key_group, x.key) for x in enc.orderBy("e").collect()]
    assert got == [(1, "a"), (1, "b"), (255, "a"), (256, "a")]


def test_handles(spark):
    df = spark.createDataFrame([("a|b|chk-1|0|42",), ("plain|chk-2|43|85",)], "h string")
    got = [tuple(x.p) for x in df.select(r.parse_handle(F.col("h")).alias("p")).collect()]
    assert got == [("a|b", "chk-1", 0, 42), ("plain", "chk-2", 43, 85)]


def test_shards(spark):
    keys = spark.range(800).select(F.concat(F.lit("user-"), "id").alias("key"))
    shuffled = files.rounds(keys, 3).orderBy(F.md5(F.concat("key", F.col("round").cast("string"))))
    placed = layout.routed(layout.keyed_count(shuffled), 128, 4, 16)
    stats = reshape.shard_merge_stats(placed)
    assert stats.where("total <> 3 OR shards <> 1").isEmpty() and stats.count() == 800
    assert layout.owned_shards(spark, 128, 4, 16).where("openers <> 1").isEmpty()
    # At three subtasks the ranges cut through shards 5 and 10, which are then opened twice.
    twice = layout.owned_shards(spark, 128, 3, 16).where("openers > 1").select("shard").distinct()
    assert sorted(x.shard for x in twice.collect()) == [5, 10]


# Change log


def test_read_your_writes(spark):
    ops = [
        ("put", "a", 1), ("get", "a", None), ("put", "a", 2), ("put", "a", 3), ("get", "a", None),
        ("put", "d", 7), ("get", "d", None), ("delete", "d", None), ("get", "d", None), ("get", "z", None),
    ]
    got = log.read_your_writes(oplog(spark, ops)).orderBy("seq").collect()
    assert [(x.key, x.value) for x in got] == [("a", 1), ("a", 3), ("d", 7), ("d", None), ("z", None)]


def test_counter_of_500(spark):
    ones = oplog(spark, [("merge", "cnt", 1)] * 500)
    got = log.fold(ones).collect()
    assert [(x.key, x.value, x.merges) for x in got] == [("cnt", 500, 500)]


@pytest.mark.parametrize("ops,want", [
    ([("put", "k", 5), ("merge", "k", 2), ("merge", "k", 3)], {"k": 10}),
    ([("merge", "k", 2), ("put", "k", 5)], {"k": 5}),
    ([("put", "k", 5), ("delete", "k", None), ("merge", "k", 3)], {"k": 3}),
    ([("put", "k", 5), ("merge", "k", 2), ("delete", "k", None)], {}),
    ([("merge", "k", 2), ("get", "k", None), ("merge", "k", 2)], {"k": 4}),
])
def test_fold(narrow, ops, want):
    df = oplog(narrow, ops)
    assert as_dict(log.fold(df)) == want
    assert {k: int(v) for k, v in as_dict(log.fold_squashed(log.squash(df))).items()} == want
    halves = [log.squash(df.where("seq < 2")), log.squash(df.where("seq >= 2"))]
    assert {k: int(v) for k, v in as_dict(log.fold_squashed(halves[0].unionByName(halves[1]))).items()} == want


def test_squash_is_short(spark):
    df = oplog(spark, [("put", "k", 1)] + [("merge", "k", 1)] * 50 + [("delete", "q", None)])
    assert log.squash(df).count() == 3


def test_checkpoint_clone(spark):
    df = oplog(spark, [("put", "before", 1), ("put", "after", 2)])
    assert as_dict(log.resolve(df, as_of=0)) == {"before": 1}
    # Durable is not captured: the flush point lies behind the write.
    assert as_dict(log.latest(log.captured(df, -1))) == {}
    live, pinned = log.latest(df), log.resolve(df, as_of=0)
    assert [x.key for x in live.exceptAll(pinned).collect()] == ["after"]


def test_checkpoint_and_duplicates(spark):
    df = oplog(spark, [("put", "a", 1), ("put", "b", 2)])
    row = log.checkpoint(df, "chk-1", F.lit(0)).first()
    assert (row.checkpoint_id, row.seq_hi, row.manifest_seq_hi, row.expire_ts) == ("chk-1", 1, 0, None)
    assert log.checkpoint(df, "chk-2", F.lit(99)).first().manifest_seq_hi == 1
    assert log.duplicate_positions(df).isEmpty()
    assert log.duplicate_positions(df.unionByName(df)).count() == 2


def test_newest_layer_wins(spark):
    rows = [("d", "a", "put", 1, 9, 1), ("d", "a", "put", 2, 3, 0), ("d", "b", "put", 5, 1, 1), ("d", "b", "delete", None, 2, 0)]
    df = spark.createDataFrame(rows, LOG + ", level int")
    assert as_dict(log.newest_first(df, "level")) == {"a": 2}


def test_barrier(spark):
    rows = [("s", v, i) for i, v in enumerate(["a", "a", "b", "BAR", "a", "c"])]
    df = spark.createDataFrame(rows, "stream string, value string, seq long")
    got = log.barrier_counts(df, "stream", "value", "BAR").collect()
    assert {x.value: x.n for x in got} == {"a": 2, "b": 1}
    end = log.drop_control(df, "value", "BAR").groupBy("value").count()
    assert as_dict(end, "value", "count") == {"a": 3, "b": 1, "c": 1}


def test_fencing(spark):
    rows = [("d", 1, 0), ("d", 1, 1), ("d", 2, 2), ("d", 1, 3), ("d", 2, 4), ("e", 1, 9), ("f", None, 1), ("f", 1, 2), ("f", None, 3), (None, 1, 5)]
    df = spark.createDataFrame(rows, "db_id string, writer_epoch int, seq long")
    got = {(x.db_id, x.seq): x.accepted for x in log.fence(df).collect()}
    assert got == {("d", 0): True, ("d", 1): True, ("d", 2): True, ("d", 3): False, ("d", 4): True, ("e", 9): True, ("f", 1): True, ("f", 2): True, ("f", 3): False, (None, 5): True}


def test_ttl(spark):
    rows = [("d", "ephemeral", "put", 1, 0, 2000), ("d", "permanent", "put", 2, 1, -1), ("d", "default", "put", 3, 2, None),
            ("d", "renewed", "put", 4, 3, 1000), ("d", "renewed", "put", 5, 4, 9000)]
    df = spark.createDataFrame(rows, LOG + ", ttl_ms long").withColumn("create_ts", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    df = log.with_expiry(df, F.col("ttl_ms"), default_ms=4000)
    at = lambda s: F.expr(f"TIMESTAMP_NTZ '2024-01-01 00:00:0{s}'")
    hidden = lambda s: sorted(as_dict(log.resolve(df, now=at(s), ttl="read_filter")))
    assert hidden(1) == ["default", "ephemeral", "permanent", "renewed"]
    assert hidden(2) == ["default", "permanent", "renewed"]
    assert hidden(5) == ["permanent", "renewed"]
    assert sorted(as_dict(log.resolve(df, now=at(9), ttl="lazy"))) == ["default", "ephemeral", "permanent", "renewed"]
    assert sorted(as_dict(upkeep.compact(df, at(9)))) == ["permanent"]
    with pytest.raises(ValueError):
        log.ttl_view(df, at(1), "sometimes")


def test_replay(spark):
    df = oplog(spark, [("put", "a", i) for i in range(10)])
    once = log.replay_dedupe(df.unionByName(df), 4)
    assert sorted(x.seq for x in once.collect()) == [5, 6, 7, 8, 9]


def test_asof_inclusive_and_repeated(spark):
    df = oplog(spark, [("put", "k", 1), ("put", "k", 2), ("delete", "k", None)])
    asks = spark.createDataFrame([("d", "k", s) for s in (-1, 0, 0, 1, 2)] + [("d", "x", 1)], "db_id string, key string, at_seq long")
    got = sorted((x.key, x.at_seq, x.value) for x in log.asof_read(asks, df).collect() if x.value)
    assert got == [("k", 0, 1), ("k", 0, 1), ("k", 1, 2)] and log.asof_read(asks, df).count() == 6


def test_asof_time_takes_the_last_write_of_an_instant(spark):
    ts = lambda c: F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(secs=F.col(c))
    rows = [("d", "k", "put", 1, 0, 5), ("d", "k", "put", 2, 1, 5), ("d", "k", "delete", None, 2, 9)]
    df = spark.createDataFrame(rows, LOG + ", s int").withColumn("create_ts", ts("s"))
    asks = spark.createDataFrame([("d", "k", s) for s in (4, 5, 8, 9, 9)], "db_id string, key string, s int")
    got = log.asof_time(asks.withColumn("at_ts", ts("s")), df).collect()
    assert sorted((x.s, x.value) for x in got if x.value) == [(5, 2), (8, 2)] and len(got) == 5


# Scans


def test_range_scan(spark):
    df = spark.createDataFrame([("range-1", "A"), ("range-2", "B"), ("range-3", "C"), ("s", "D")], "key string, value string")
    both = scans.ordered(scans.key_range(df, "key", "range-1", "range-3", True, True), "key")
    assert [x.value for x in both.collect()] == ["A", "B", "C"]
    assert scans.key_range(df, "key", "range-1", "range-3").count() == 2
    assert scans.key_range(df, "key", "range-1", None, False).count() == 3
    assert [x.value for x in scans.scan_prefix(df, "key", "range-", "2").collect()] == ["B", "C"]


def test_absent_key_is_null(spark):
    state = spark.createDataFrame([(f"k{i}", i) for i in range(500)], "key string, value int")
    asks = spark.createDataFrame([("k7",), ("gone",)], "key string")
    assert as_dict(scans.get(asks, state)) == {"k7": 7, "gone": None}
    assert scans.get_one(state, "k9").first().value == 9


def test_limits(spark):
    df = spark.createDataFrame([("k", "v"), ("", "v"), ("x" * 70000, "v")], "key string, value string")
    good, bad = scans.split_by_limits(df, "key", "value")
    assert good.count() == 1 and sorted(x.verdict for x in bad.collect()) == ["empty_key", "key_too_long"]


# Reshape


def truth(spark):
    return spark.range(400).select(F.concat(F.lit("user-"), "id").alias("key"), F.concat(F.lit("v-"), "id").alias("value"))


def test_rescale_chain(spark):
    t = truth(spark)
    state = t.withColumn("key_group", r.key_group("key"))
    one = reshape.rescale(state, reshape.handles(spark, "d", "c", 128, 3), 128, 2)
    flags = ["no_foreign_key", "no_duplicate", "no_loss", "values_intact", "right_owner"]
    check = reshape.verify_partition(one.withColumnRenamed("new_subtask", "subtask"), t, 128, 2).first()
    assert check.keys == 400 and all(check[f] for f in flags)
    assert 0 < one.where("copied").count() < 200
    two = reshape.rescale(state, reshape.next_handles(one, 128, 2), 128, 4)
    assert two.where("copied").isEmpty()
    check = reshape.verify_partition(two.withColumnRenamed("new_subtask", "subtask"), t, 128, 4).first()
    assert all(check[f] for f in flags)


def test_rescale_plan(spark):
    plan = reshape.rescale_plan(reshape.handles(spark, "d", "c", 128, 3), 128, 2).orderBy("new_subtask").collect()
    assert [(x.sources, x.base_subtask, x.base_overlap, x.copied_groups) for x in plan] == [(2, 0, 43, 21), (2, 2, 42, 22)]


def test_verify_finds_each_fault(spark):
    t = truth(spark)
    good = t.withColumn("subtask", r.owner(r.key_group("key"), 128, 2))
    first = F.col("key") == "user-0"
    faults = {
        "no_foreign_key": good.unionByName(spark.createDataFrame([("alien", "x", 0)], good.schema).withColumn("subtask", r.owner(r.key_group("key"), 128, 2))),
        "no_duplicate": good.unionByName(good.where(first)),
        "no_loss": good.where(~first),
        "values_intact": good.withColumn("value", F.when(first, "wrong").otherwise(F.col("value"))),
        "right_owner": good.withColumn("subtask", F.when(first, 1 - F.col("subtask")).otherwise(F.col("subtask"))),
    }
    for flag, gen in faults.items():
        row = reshape.verify_partition(gen, t, 128, 2).first()
        assert {f: row[f] for f in faults} == {f: f != flag for f in faults}


def test_split_and_merge(spark):
    state = spark.range(600).select(
        r.fixed_width("key-", F.col("id"), 6).alias("key"), F.concat(F.lit("val-"), "id").alias("value")
    )
    lo, hi = reshape.split(state, F.lit("key-000300"))
    assert (lo.count(), hi.count()) == (300, 300)
    ranges = spark.createDataFrame([("lo", 0, 63), ("hi", 64, 127)], "db_id string, lo int, hi int")
    merged = reshape.union_shards([lo, hi], ranges)
    assert reshape.reconcile(state, merged).first().asDict() == {"matching": 600, "wrong": 0, "missing": 0, "extra": 0}
    more = merged.unionByName(spark.createDataFrame([("key-000600", "new")], state.schema))
    assert more.count() == 601
    for bad in ([("a", 0, 63), ("b", 63, 127)], [("a", 0, 60), ("b", 64, 127)]):
        with pytest.raises(ValueError, match="not adjacent"):
            reshape.union_shards([lo, hi], spark.createDataFrame(bad, ranges.schema))


def test_reconcile_counts(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "key string, value int")
    b = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 4)], "key string, value int")
    assert reshape.reconcile(a, b).first().asDict() == {"matching": 2, "wrong": 1, "missing": 0, "extra": 1}


def test_generations(spark):
    rows = [(g, f"k{i}", 3 * g) for g in (1, 2, 3) for i in range(24)]
    got = reshape.max_across_generations(spark.createDataFrame(rows, "generation int, key string, n long"))
    assert got.where("n <> 9 OR generation <> 3").isEmpty() and got.count() == 24


def test_scopes(spark):
    pool = spark.range(600).select(
        F.concat(F.lit("db"), (F.col("id") % 4).cast("string")).alias("db_id"),
        F.floor(F.col("id") / 4).cast("string").alias("key"),
    ).withColumn("value", F.concat("db_id", F.lit("-k"), "key"))
    right = pool.withColumnRenamed("value", "got")
    assert {(x.reads, x.right_value, x.mixed, x.wrong) for x in reshape.scope_check(right, pool).collect()} == {(150, 150, 0, 0)}
    leak = right.withColumn("got", F.when((F.col("db_id") == "db1") & (F.col("key") == "7"), "db2-k7").otherwise(F.col("got")))
    lost = leak.withColumn("got", F.when((F.col("db_id") == "db3") & (F.col("key") == "9"), None).otherwise(F.col("got")))
    got = {x.db_id: (x.mixed, x.wrong) for x in reshape.scope_check(lost, pool).collect()}
    assert got == {"db0": (0, 0), "db1": (1, 1), "db2": (0, 0), "db3": (0, 1)}


# Records


def test_records(spark):
    base = spark.range(1000).select(
        F.concat(F.lit("acct:"), "id").alias("key"),
        records.record(F.col("id") * 7, F.concat(F.lit("user-"), "id"),
                       F.concat(F.lit("t"), (F.col("id") % 3).cast("string")), F.concat(F.lit("t"), (F.col("id") % 5).cast("string"))).alias("record"),
    )
    assert reshape.reconcile(base, records.apply_updates(base, spark.createDataFrame([], "key string, amount long, tag string, seq long")), value="record").first().matching == 1000
    alice = spark.createDataFrame([("alice", (100, "alice", ["vip", "eu"]))], base.schema)
    ups = spark.range(50).select(F.lit("alice").alias("key"), F.lit(10).alias("amount"), F.concat(F.lit("t"), "id").alias("tag"), F.col("id").alias("seq"))
    rec = records.apply_updates(alice, ups).first().record
    assert rec.balance == 600 and len(rec.tags) == 52 and rec.tags[:3] == ["vip", "eu", "t0"] and rec.tags[-1] == "t49"
    long = records.record_tags(ups).orderBy("pos").collect()
    assert [x.tag for x in long] == [f"t{i}" for i in range(50)]


# Tiering

HOT = [50 + 40 * i for i in range(12)]
TRACE = [("hot", 0), ("A", 10), ("B", 20), ("A", 30), ("B", 40)] + [("hot", x) for x in HOT] + [("A", 530), ("B", 540), ("hot", 740)]


def trace(spark):
    rows = [(k, i, ms) for i, (k, ms) in enumerate(TRACE)]
    df = spark.createDataFrame(rows, "key string, seq long, ms long")
    ts = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(secs=F.col("ms") / 1000)
    return df.withColumn("ts", ts)


@pytest.mark.parametrize("mode,promotions,demotions", [("watermark", 2, 5), ("gap", 3, 6)])
def test_tier_trace(narrow, mode, promotions, demotions):
    got = tiering.tier_batch(trace(narrow), 100, mode).collect()
    assert {x.key: x.n for x in got} == {"hot": 14, "A": 3, "B": 3}
    assert (sum(x.promotions for x in got), sum(x.demotions for x in got)) == (promotions, demotions)


def test_hot_wins(spark):
    hot = spark.createDataFrame([("a", 1), ("n", None)], "key string, value int")
    cold = spark.createDataFrame([("a", 99), ("b", 2), ("n", 5)], "key string, value int")
    got = {x.key: (x.value, x.tier) for x in tiering.hot_wins(hot, cold).collect()}
    assert got == {"a": (1, "hot"), "b": (2, "cold"), "n": (None, "hot")}


# Upkeep


def test_compaction(spark):
    rows = [("put", f"key-{i}", b) for b in range(20) for i in range(100)]
    df = oplog(spark, rows)
    now = F.expr("TIMESTAMP_NTZ '2030-01-01 00:00:00'")
    kept = upkeep.compact(df, now)
    assert kept.count() == 100 and kept.where("value <> 19").isEmpty()
    report = upkeep.compact_report(df, now).first()
    assert (report.rows_before, report.rows_after, report.hidden_versions) == (2000, 100, 1900)


def test_orphan_states_over_time(spark):
    ts = lambda s: F.expr(f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '{s}' SECOND")
    # A second database has files and checkpoints of the same names, held by nobody.
    other = [("e", "pinned"), ("e", "live")]
    f = spark.createDataFrame([("d", "old"), ("d", "pinned"), ("d", "live"), *other], "db_id string, file_id string").withColumn("create_ts", ts(0))
    refs = spark.createDataFrame([("d", "live")], "db_id string, file_id string")
    cp_refs = spark.createDataFrame([("d", "c1", "pinned")], "db_id string, checkpoint_id string, file_id string")
    cps = spark.createDataFrame([("d", "c1", 900), ("e", "c1", 0)], "db_id string, checkpoint_id string, s int")
    cps = cps.withColumn("expire_ts", F.when(F.col("s") == 900, ts(900)).otherwise(ts(0)))
    judged = lambda s, *low: upkeep.orphans(f, refs, cp_refs, cps, ts(s), 2, *low).collect()
    assert {x.status for x in judged(5) if x.db_id == "e"} == {"deletable"} and len(judged(5)) == 5
    assert {x.file_id for x in upkeep.orphan_files(f, refs, cp_refs).collect() if x.db_id == "e"} == {"pinned", "live"}
    at = lambda s: {x.file_id: x.status for x in judged(s) if x.db_id == "d"}
    assert at(1) == {"old": "too_young", "pinned": "pinned", "live": "live"}
    assert at(5) == {"old": "deletable", "pinned": "pinned", "live": "live"}
    # A young file alone does not free the pinned one; the end of the checkpoint does.
    assert at(901) == {"old": "deletable", "pinned": "deletable", "live": "live"}
    low = {x.file_id: x.status for x in judged(901, ts(0)) if x.db_id == "d"}
    assert low["old"] == "too_young"


def test_retention_and_refresh(spark):
    day = lambda d: F.expr(f"TIMESTAMP_NTZ '2024-01-{d:02d} 00:00:00'")
    rows = [("c1", 1, 5), ("c2", 2, None), ("c3", 3, 5), ("c4", 4, 25), ("c5", 5, 25), ("c6", 6, None)]
    df = spark.createDataFrame([("d", n, c, x) for n, c, x in rows], "db_id string, checkpoint_id string, c int, x int")
    cps = df.select(
        "db_id", "checkpoint_id",
        F.make_timestamp_ntz(F.lit(2024), F.lit(1), "c", F.lit(0), F.lit(0), F.lit(0)).alias("create_ts"),
        F.make_timestamp_ntz(F.lit(2024), F.lit(1), "x", F.lit(0), F.lit(0), F.lit(0)).alias("expire_ts"),
    )
    held = spark.createDataFrame([("d", "c1"), ("d", "c4")], "db_id string, checkpoint_id string")
    both = upkeep.checkpoint_retention(cps.union(cps.withColumn("db_id", F.lit("e"))), held, 1, day(10)).collect()
    assert len(both) == 12 and {x.checkpoint_id: x.status for x in both if x.db_id == "e"} == {"c1": "expired", "c2": "leak", "c3": "expired", "c4": "deletable", "c5": "deletable", "c6": "newest"}
    got = as_dict(upkeep.checkpoint_retention(cps, held, 1, day(10)), "checkpoint_id", "status")
    assert got == {"c1": "unrestorable", "c2": "leak", "c3": "expired", "c4": "referenced", "c5": "deletable", "c6": "newest"}
    fresh = upkeep.refresh(cps, "c1", day(20))
    assert as_dict(upkeep.checkpoint_retention(fresh, held, 1, day(10)), "checkpoint_id", "status")["c1"] == "referenced"


def test_write_stall(spark):
    f = spark.range(20).select(
        F.lit("d").alias("db_id"), F.col("id").alias("file_no"),
        (F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(secs=F.col("id"))).alias("create_ts"),
    )
    row = upkeep.write_stall(upkeep.level_log(f, 10, 4), 8).first()
    # Fourteen files before the first merge, above eight from the ninth flush until that merge.
    assert row.max_l0 == 14 and row.us_above == (13 - 8) * 1_000_000 + (19 - 18) * 1_000_000


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from statekit import session

    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(fake)


def test_clone_chain(spark):
    edges = [("r", None)] + [(f"c{i}", "r" if i == 0 else f"c{i - 1}") for i in range(9)] + [("x", "c3")]
    got = {x.db: (x.depth, x.root, x.clones) for x in upkeep.clone_chain(spark.createDataFrame(edges, "db_id string, parent_id string")).collect()}
    assert got["c8"] == (9, "r", 0) and got["x"] == (5, "r", 0) and got["c3"] == (4, "r", 2) and got["r"] == (0, "r", 1)
    for bad in ([("a", "b"), ("b", "c"), ("c", "a")], [("a", "nowhere")]):
        with pytest.raises(ValueError):
            upkeep.clone_chain(spark.createDataFrame(bad, "db_id string, parent_id string"))


def test_codecs(spark, tmp_path):
    rows = spark.range(150).select(F.concat(F.lit("key-"), "id").alias("key"), F.repeat(F.lit("payload "), 128).alias("value"))
    for name in files.CODECS:
        files.write_state(rows, str(tmp_path / name), name)
    size = {n: files.file_inventory(spark, str(tmp_path / n)).where("file LIKE '%.parquet'").agg(F.sum("bytes")).first()[0] for n in files.CODECS}
    assert all(size[n] < size["None"] for n in files.CODECS if n != "None")
    both = files.read_mixed(spark, str(tmp_path / "Zstd"), str(tmp_path / "Snappy"))
    assert both.count() == 300 and both.where("length(value) <> 1024").isEmpty()
    with pytest.raises(ValueError):
        files.write_state(rows, str(tmp_path / "x"), "zstd")


def test_missing_shards_are_skipped(spark, tmp_path):
    state = layout.routed(spark.range(5).select(F.col("id").cast("string").alias("key")))
    files.write_by(state, str(tmp_path / "s"), "shard")
    back = files.read_shards(spark, str(tmp_path / "s"), state.schema)
    assert back.count() == 5 and back.select("shard").distinct().count() < 16
    got = files.group_range(back, 0, 127).count()
    assert got == 5


# Metrics


def test_triage(spark):
    names = ["Unavailable", "Transaction", "Closed", "Data", "Internal", "Never heard of"]
    got = as_dict(metrics.error_triage(spark.createDataFrame([(n,) for n in names], "error string")), "error", "class")
    assert [got[n] for n in names] == ["retryable", "retryable", "fatal", "fatal", "fatal", "fatal"]


def test_catalog_ignores_label_order(spark):
    rows = [("m", {"a": "1", "b": "2"}, 1.0), ("m", {"b": "2", "a": "1"}, 2.0), ("m", {"a": "9"}, 3.0)]
    df = spark.createDataFrame(rows, "name string, labels map<string,string>, value double").withColumn("kind", F.lit("counter"))
    row = metrics.metric_catalog(df).first()
    assert (row.series, row.label_keys, row["sample"]) == (2, "a,b", 3.0)


def test_quantiles(narrow):
    df = narrow.range(1, 1001).select(F.lit("s").alias("name"), F.col("id").alias("v"))
    row = metrics.quantiles(df, "name", "v", {"p50": 0.5, "p99": 0.99, "p999": 0.999}).first()
    assert (row.p50, row.p99, row.p999) == (500, 990, 999)
