import hashlib
import random

from pyspark.sql import functions as F

from statekit.llm import suffix_dedup as op


def brute(rows, depth=100):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            if w in seen:
                gone[p : p + depth] = [True] * depth
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def rows_for_test():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(40), prose(200)
    rows = [(i, prose(r.randint(1, 150))) for i in range(40)]
    rows += [(100 + i, prose(20) + passage[i : 150 + i] + prose(30)) for i in range(20)]
    rows += [(200 + i, base[: 30 * i] + "X" * (i % 3) + base[30 * i :]) for i in range(12)]
    rows += [(300, "ab " * 400), (301, "ab " * 60), (302, "a" * 99), (303, "a" * 100), (304, "a" * 101), (305, None), (306, ""), (307, base), (308, base)]
    rows += [(-5, passage * 3), (309, prose(60) * 2)]
    return rows


def test_against_brute_force(spark):
    rows = rows_for_test()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gram", F.lit(1)).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.remove_repeats(spark, df).collect()}
    assert got == brute(rows)


def test_many_small_blocks(spark, monkeypatch):
    """Members of a bucket come from many blocks, each of which has settled its own."""
    monkeypatch.setattr(op, "MEMBERS", 20)
    rows = rows_for_test()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.remove_repeats(spark, df).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 64)
    rows = rows_for_test()[:60]
    import numpy as np
    import pyarrow as pa

    from statekit.llm import common as c

    data, at = c.buffer(pa.array([t or "" for _, t in rows]))
    doc, place, _, _ = op.spans(data, at)
    for k in range(len(rows)):
        first, size, ahead = op.unplaced(place[doc == k])
        assert size.sum() == max(0, at[k + 1] - at[k] - op.DEPTH + 1)
        assert (first == np.cumsum(size) - size).all() and ((ahead >= size - 1) & (ahead <= op.REACH)).all()


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op.remove_repeats(spark, df).count() == 0
    long = "xyz " * 50
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (2, "a"), (2, long)], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in op.remove_repeats(spark, df).collect())
    assert [x[1:3] for x in got] == [(0, 200), (1, 200), (2, 1), (2, 200)]
    assert got[1][3] == 200 and got[3][3] == 200
