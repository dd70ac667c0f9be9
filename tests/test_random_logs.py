"""Random change logs against a brute-force interpreter; one key holds about a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from statekit.operators import log

SCHEMA = "db_id string, key string, op string, value int, seq long"


def random_log(seed, n=600):
    rng = random.Random(seed)
    out = []
    for s in rng.sample(range(5 * n), n):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}"
        op = rng.choice(["put", "delete", "merge", "merge", "get"])
        out.append(("d", key, op, None if op in ("delete", "get") else rng.randrange(-5, 9), s))
    return out


def brute(data):
    """Latest value, fold, element set and the answer of every get."""
    latest, folded, sets, gets = {}, {}, {}, {}
    for _, k, op, v, s in sorted(data, key=lambda row: row[4]):
        if op == "put":
            latest[k], folded[k], sets[k] = v, v, {v}
        elif op == "delete":
            for d in (latest, folded, sets):
                d.pop(k, None)
        elif op == "merge":
            folded[k] = folded.get(k, 0) + v
            sets.setdefault(k, set()).add(v)
        else:
            gets[(k, s)] = latest.get(k)
    return latest, folded, sets, gets


@pytest.mark.parametrize("fixture", ["spark", "narrow"])
@pytest.mark.parametrize("seed", [11, 12])
def test_against_brute_force(request, fixture, seed):
    spark = request.getfixturevalue(fixture)
    data = random_log(seed)
    nothing = F.lit(None).cast("timestamp_ntz")
    df = spark.createDataFrame(data, SCHEMA).withColumns({"create_ts": nothing, "expire_ts": nothing})
    latest, folded, sets, gets = brute(data)
    assert {r.key: r.value for r in log.latest(df).collect()} == latest
    assert {r.key: r.value for r in log.fold(df).collect()} == folded
    got = {}
    for r in log.fold_set(df, F.col("value")).collect():
        got.setdefault(r.key, set()).add(r.element)
    assert got == sets
    assert {(r.key, r.seq): r.value for r in log.read_your_writes(df).collect()} == gets
    custom = {r.key: r.value for r in log.fold_with(df, lambda v: v.max()).collect()}
    assert custom == {k: float(max(v)) for k, v in sets.items()}
    cut = 1500
    old, new = df.where(F.col("seq") <= cut), df.where(F.col("seq") > cut)
    assert {r.key: int(r.value) for r in log.fold_into(log.fold(old), new).collect()} == folded
    squashed = log.squash(old).unionByName(log.squash(new))
    assert {r.key: int(r.value) for r in log.fold_squashed(squashed).collect()} == folded
    at = [-1, 700, 1500, 3000]
    asks = [("d", k, a) for k in {row[1] for row in data} for a in at]
    lookups = spark.createDataFrame(asks, "db_id string, key string, at_seq long")
    want = {(k, a): brute([row for row in data if row[4] <= a])[0].get(k) for _, k, a in asks}
    for unique in (True, False):
        seen = log.asof_read(lookups, df, unique=unique).collect()
        assert {(r.key, r.at_seq): r.value for r in seen} == want
