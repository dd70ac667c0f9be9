"""Chunked windows against brute force, with and without hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from statekit.operators import chunks, log, metrics
from statekit.operators.chunks import ChunkSpec

SPECS = [ChunkSpec(), ChunkSpec(5, 1), ChunkSpec(1, 1), ChunkSpec(40, 4)]


def rows(seed, n=120):
    rng = random.Random(seed)
    seqs = rng.sample(range(-60, 400), n)
    # A third of all rows has one key.
    return [("hot" if rng.random() < 0.34 else rng.choice("abcd"), s, rng.choice([None, -2, 0, 3, 9])) for s in seqs]


def by_key(data):
    out = {}
    for k, s, v in sorted(data, key=lambda r: r[1]):
        out.setdefault(k, []).append((s, v))
    return out


@pytest.mark.parametrize("spec", SPECS)
@pytest.mark.parametrize("seed", [1, 2])
def test_running_and_previous(spark, spec, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, "k string, seq long, v int")
    summed = chunks.running_sum(df, ["k"], "seq", {"s": F.col("v")}, spec=spec)
    prev = chunks.previous(summed, ["k"], "seq", {"p": F.col("v")}, spec=spec)
    maxed = chunks.earlier_max(prev, ["k"], "seq", {"m": F.col("v")}, spec=spec)
    whole = chunks.key_max(maxed, ["k"], "seq", {"w": F.col("v")}, spec=spec)
    got = {(r.k, r.seq): (r.s, r.p, r.m, r.w) for r in whole.collect()}
    assert len(got) == len(data)
    for k, series in by_key(data).items():
        total, last, top = None, None, None
        most = max((v for _, v in series if v is not None), default=None)
        for s, v in series:
            if v is not None:
                total = v if total is None else total + v
            assert got[(k, s)] == (total, last, top, most)
            if v is not None:
                last, top = v, v if top is None else max(top, v)


@pytest.mark.parametrize("spec", SPECS[1:])
def test_global_sequence(spark, spec):
    data = rows(3)
    df = spark.createDataFrame(data, "k string, seq long, v int")
    got = {r.seq: r.m for r in chunks.earlier_max(df, [], "seq", {"m": F.col("v")}, spec=spec).collect()}
    top = None
    for _, s, v in sorted(data, key=lambda r: r[1]):
        assert got[s] == top
        if v is not None:
            top = v if top is None else max(top, v)


def test_only_large_keys_are_hot(spark):
    data = [("hot", i, 1) for i in range(1000)] + [(f"k{i}", i, 1) for i in range(1000)]
    df = spark.createDataFrame(data, "k string, seq long, v int")
    assert [r.k for r in chunks.hot_keys(df, ["k"], "seq", ChunkSpec(100, 1)).collect()] == ["hot"]
    everything, only_hot = chunks.chunked(df, ["k"], "seq", spec=ChunkSpec(100, 1))
    assert only_hot.count() == 1000 and only_hot.where("k <> 'hot'").isEmpty()
    cut = everything.groupBy("k", chunks.CHUNK).count()
    sizes = {(r.k, r[chunks.CHUNK]): r["count"] for r in cut.collect()}
    assert max(sizes.values()) == 100 and len([k for k in sizes if k[0] == "hot"]) == 10
    assert sizes[("k7", None)] == 1


def test_no_task_gets_the_hot_key_whole(spark):
    """The plan of a running count shuffles by key and chunk, not by key."""
    df = spark.range(10).select(F.lit("k").alias("k"), F.col("id").alias("seq"))
    plan = chunks.running_sum(df, ["k"], "seq", {"n": F.lit(1)})._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    for line in physical.splitlines():
        if "Window" in line and "sum(1)" in line:
            assert "_chunk" in line


@pytest.mark.parametrize("spec", SPECS)
def test_previous_row_keeps_its_nulls(spark, spec):
    data = [("k", i, v) for i, v in enumerate([1, None, None, 4, None])]
    df = spark.createDataFrame(data, "k string, seq long, v int")
    even = F.col("seq") % 2 == 0
    got = chunks.previous(df, ["k"], "seq", {"p": F.col("v"), "at": F.col("seq")}, when=even, spec=spec)
    rows = sorted((r.seq, r.p, r.at) for r in got.collect())
    assert rows == [(0, None, None), (1, 1, 0), (2, 1, 0), (3, None, 2), (4, None, 2)]


def test_a_null_key_is_a_key_like_others(narrow):
    """A null series runs on over chunk borders, and its quantiles are not lost."""
    df = narrow.range(30).select(F.when(F.col("id") % 2 == 0, "a").alias("k"), F.col("id").alias("seq"))
    for few in (True, False):
        got = chunks.running_sum(df, ["k"], "seq", {"n": F.lit(1)}, few_keys=few).collect()
        assert {x.k: max(y.n for y in got if y.k == x.k) for x in got} == {"a": 15, None: 15}
    q = metrics.quantiles(df.withColumn("v", F.col("seq").cast("int")), "k", "v", {"top": 1.0}).collect()
    assert {x.k: x.top for x in q} == {"a": 28, None: 29}


def test_folds_keep_null_keys_and_decimals(spark):
    rows = [("d", None, "merge", "1.234", 1), ("d", None, "merge", "1.001", 2), ("d", "a", "put", "1.001", 3)]
    df = spark.createDataFrame(rows, "db_id string, key string, op string, v string, seq long")
    df = df.withColumn("value", F.col("v").cast("decimal(20,3)")).drop("v")
    want = {None: 2.235, "a": 1.001}
    assert {x.key: float(x.value) for x in log.fold_squashed(log.squash(df)).collect()} == want
    assert {x.key: round(x.value, 3) for x in log.fold_with(df, lambda v: v.sum()).collect()} == want
