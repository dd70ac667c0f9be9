import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from statekit.llm import common, toxicity as op
from statekit.llm.common import table

SF = "/root/testdata/sf0.1"


def test_gradients_like_finite_differences(monkeypatch):
    model = op.new_model(1, np.float64)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(7, op.VECTOR))
    index = rng.integers(0, 7, (5, op.STEPS))
    mask = (np.arange(op.STEPS) < np.array([16, 3, 1, 0, 9])[:, None]).astype(float)
    y, w = np.array([1.0, 0, 1, 0, 1]), rng.random(5)
    _, g, dv = op.gradients(model, vectors, index, mask, y, w)

    def slope(values, at):
        old = values[at]
        out = []
        for step in (1e-5, -1e-5):
            values[at] = old + step
            out.append(op.gradients(model, vectors, index, mask, y, w)[0])
        values[at] = old
        return (out[0] - out[1]) / 2e-5

    for name, grad in [*g.items(), ("vectors", dv)]:
        values = vectors if name == "vectors" else model[name]
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in values.shape)
            assert abs(slope(values, at) - grad[at]) < 1e-6 + 1e-4 * abs(grad[at]), name


def test_windows_cover_every_word():
    n = np.array([0, 1, 15, 16, 17, 24, 25, 100])
    first = np.r_[0, np.cumsum(n)]
    begin, size, doc = op.windows(first)
    for k, words in enumerate(n):
        mine = [(b - first[k], s) for b, s, d in zip(begin, size, doc) if d == k]
        assert {x for b, s in mine for x in range(b, b + s)} == set(range(words))
        assert all(b2 - b1 == op.STRIDE for (b1, _), (b2, _) in zip(mine, mine[1:])) and len(mine) >= 1


def test_trigrams_of_words():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["Abc, é x abc", None, ""]).fill_null("")})
    word, gram, owner, inverse, first = op.features(batch)
    assert first.tolist() == [0, 4, 4, 4] and inverse[0] == inverse[3] and len(word) == 3
    want = {b"abc": [b"\x02ab", b"abc", b"bc\x03"], "é".encode(): [b"\x02\xc3\xa9", b"\xc3\xa9\x03"], b"x": [b"\x02x\x03"]}
    for text, k in ((b"abc", inverse[0]), ("é".encode(), inverse[1]), (b"x", inverse[2])):
        keys = np.array([int.from_bytes(t, "big") for t in want[text]], np.uint64)
        assert gram[owner == k].tolist() == (common.mix(keys) & np.uint64(op.GRAMS - 1)).tolist()


def test_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = F.pmod(common.fold("doc_id"), F.lit(3)) == 1
    model = op.train(*op.sample(docs, labels.where(~held)))
    got = op.score(spark, docs.where(held), model).join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    rank = got["score"].rank()
    y = got["toxic"] == 1
    area = (rank[y].mean() - (y.sum() + 1) / 2) / (~y).sum()
    assert area > 0.95
    assert (got["predicted"][y] == 1).mean() > 0.7 and (got["toxic"][got["predicted"] == 1] == 1).mean() > 0.85


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (1, None, 3), (None, "", 3), (2, "... !", 3), (3, "word " * 40000, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (None, 1)], "doc_id long, toxic int")
    for rows in (labels, labels.where("false"), spark.createDataFrame([(1, 1), (3, 0), (3, 1), (2, 0), (2, None)], "doc_id long, toxic int")):
        got = op.score(spark, docs, op.train(*op.sample(docs, rows))).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert op.score(spark, docs.where("false"), op.new_model()).count() == 0
