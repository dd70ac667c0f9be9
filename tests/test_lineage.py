"""Clones without copies against copied ones and against a plain walk up the tree."""

import random

import pytest
from pyspark.sql import functions as F

from statekit.operators import lineage, log

LOG = "db_id string, key string, op string, value long, seq long, create_ts timestamp, expire_ts timestamp"
TREE = "db_id string, parent_id string, cut_seq long, lo_key string, hi_key string"


def random_case(seed):
    rng = random.Random(seed)
    tree = [("d0", None, None, None, None), ("e0", None, None, None, None)]
    for i in range(1, 14):
        parent = rng.choice(tree)[0]
        bounds = sorted(rng.sample("abcdefgh", 2)) if rng.random() < 0.4 else [None, None]
        if rng.random() < 0.2:
            bounds[rng.randint(0, 1)] = None
        tree.append((f"d{i}", parent, rng.randint(0, 300), *bounds))
    keys = [*"abcdefgh", None]
    rows = [(rng.choice(tree)[0], rng.choice(keys), rng.choice(["put", "put", "delete", "merge", "get"]), s, s, None, None) for s in range(300)]
    return rows, tree


def plain(rows, tree, target):
    of, path, cut, lo, hi = {t[0]: t for t in tree}, [], None, None, None
    at = target
    while at is not None:
        path.append((at, cut, lo, hi))
        _, parent, c, low, high = of[at]
        cut = c if cut is None else cut if c is None else min(cut, c)
        lo = low if lo is None else lo if low is None else max(lo, low)
        hi = high if hi is None else hi if high is None else min(hi, high)
        at = parent
    out = {}
    for db, cut, lo, hi in reversed(path):
        for d, key, op, value, seq, _, _ in rows:
            if d != db or op not in ("put", "delete") or (cut is not None and seq > cut):
                continue
            if (lo is not None and (key is None or key < lo)) or (hi is not None and (key is None or key >= hi)):
                continue
            out[key] = (value, db) if op == "put" else None
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("seed", range(4))
def test_against_a_walk_up_the_tree(spark, seed):
    rows, tree = random_case(seed)
    changes, family = spark.createDataFrame(rows, LOG), spark.createDataFrame(tree, TREE)
    got = {}
    for r in lineage.state(changes, lineage.views(family)).collect():
        got.setdefault(r.db_id, {})[r.key] = (r.value, r.source_db)
    for target in (t[0] for t in tree):
        assert got.get(target, {}) == plain(rows, tree, target)


def test_equal_to_a_copied_clone(spark):
    """Five generations, each copied with ``log.clone`` on one side and only named on the other."""
    rng = random.Random(9)
    rows = [("d0", rng.choice("abcdef"), rng.choice(["put", "delete"]), s, s, None, None) for s in range(100)]
    rows += [(f"d{rng.randint(0, s // 100)}", rng.choice("abcdef"), rng.choice(["put", "delete"]), s, s, None, None) for s in range(100, 600)]
    changes = spark.createDataFrame(rows, LOG)
    tree = [("d0", None, None, None, None)] + [(f"d{k}", f"d{k - 1}", 100 * k - 1, None, None) for k in range(1, 6)]
    copied = changes.where("db_id = 'd0'")
    for k in range(1, 6):
        copied = log.clone(copied, F.lit(100 * k - 1), f"d{k}").unionByName(changes.where(f"db_id = 'd{k}'"), allowMissingColumns=True)
    want = {(r.key, r.value) for r in log.latest(copied).collect()}
    seen = lineage.views(spark.createDataFrame(tree, TREE), spark.createDataFrame([("d5",)], "db_id string"))
    assert {(r.key, r.value) for r in lineage.state(changes, seen).collect()} == want and want


def test_readers_and_faults(spark):
    tree = [("a", None, None, None, None), ("b", "a", 5, None, None), ("c", "a", 9, None, None), ("d", "c", 2, None, None)]
    seen = lineage.views(spark.createDataFrame(tree, TREE).drop("lo_key", "hi_key"))
    got = {r.db_id: (r.readers, r.nearest, r.first_upto, r.last_upto) for r in lineage.shared(seen).collect()}
    assert got == {"a": (3, 1, 2, 9), "c": (1, 1, 2, 2)}
    with pytest.raises(ValueError, match="not in the table"):
        lineage.views(spark.createDataFrame([("a", "z", 1, None, None)], TREE))
    with pytest.raises(ValueError, match="cycle"):
        lineage.views(spark.createDataFrame([("a", "b", 1, None, None), ("b", "a", 1, None, None)], TREE))
    assert lineage.views(spark.createDataFrame([], TREE)).isEmpty()
