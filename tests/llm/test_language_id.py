import random

import numpy as np
from pyspark.sql import functions as F

from statekit.llm import common, language_id as op
from statekit.llm.common import table

SF = "/root/testdata/sf0.01"


def brute_grams(text):
    raw = text.encode()
    raw = bytes(b + 32 if 65 <= b < 91 else b if op.LETTER[b] else 32 for b in raw)
    out = bytearray(b" ")
    for b in raw + b" ":
        if b == 32 and out[-1] == 32:
            continue
        if out[-1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97:
            b += 0x20
        out.append(b)
    return [bytes(out[k : k + 4]) for k in range(len(out) - 3)]


def test_grams_like_brute_force():
    import pyarrow as pa

    r = random.Random(1)
    texts = ["", "a", "ab", "É!! É", "  x  y "] + ["".join(r.choice("abÉé ßZ.1\n") for _ in range(r.randint(0, 30))) for _ in range(200)]
    key, at = op.grams(pa.RecordBatch.from_pydict({"text": pa.array(texts)}))
    for k, text in enumerate(texts):
        want = brute_grams(text)
        packed = np.array([int.from_bytes(g, "big") for g in want], np.uint64)
        assert (key[at[k] : at[k + 1]] == common.mix(packed)).all() and at[k + 1] - at[k] == len(want)


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    held = F.pmod(common.fold("doc_id"), F.lit(4)) == 2
    model = op.learn(spark, docs.where(~held))
    got = op.identify(spark, docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 150
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_no_lost_language():
    """A Bloom filter has no false negatives: the AND of an n-gram's slots keeps every bit put in."""
    key = common.mix(np.arange(5000, dtype=np.uint64))
    masks = np.zeros(op.SLOTS, np.int64)
    for k in range(op.HASHES):
        np.bitwise_or.at(masks, op.slot(key, k).astype(np.int64), np.arange(5000) % 4 + 1)
    seen = masks[op.slot(key, 0).astype(np.int64)] & masks[op.slot(key, 1).astype(np.int64)]
    assert ((seen & (np.arange(5000) % 4 + 1)) == np.arange(5000) % 4 + 1).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the one and the other", "en", 1), (2, "der die das und", "de", 2), (3, None, "en", 3), (4, "x", None, 4)], "doc_id long, text string, lang string, score int")
    model = op.learn(spark, docs.union(docs))
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "é"), (None, "the other and"), (5, "das und das "), (5, "das und das "), (6, "the " * 50000)]
    df = spark.createDataFrame([(i, t, 0.5, "zz") for i, t in odd], "doc_id long, text string, score double, lang_pred string")
    got = [(r.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in op.identify(spark, df, model).collect()]
    assert [g[1] for g in sorted(got, key=lambda g: (g[0] or 0))] == ["en", "und", "und", "und", "de", "de", "de", "en"] and all(g[2] for g in got)
    assert sorted(r.doc_id or 0 for r in op.keep_known(spark, df, model).collect()) == [0, 4, 5, 5, 6]
    empty = op.learn(spark, docs.where("false"))
    assert {r.lang_pred for r in op.identify(spark, df, empty).collect()} == {"und"}
    assert op.identify(spark, df.where("false"), model).count() == 0


def test_more_languages_than_bits(spark):
    """130 made-up languages, each with letters of its own: every one is learned and told apart."""
    r = random.Random(3)
    names = [f"l{k:03}" for k in range(130)]
    words = {x: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for x in names}
    rows = [(k * 20 + n, " ".join(r.choices(words[x], k=30)), x) for k, x in enumerate(names) for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op.learn(spark, docs.where("doc_id % 20 < 15"))
    assert sorted(model.languages) == names and len(model.masks) == 3
    got = op.identify(spark, docs.where("doc_id % 20 >= 15"), model).collect()
    assert len(got) == 650 and all(x.lang_pred == names[x.doc_id // 20] and x.score > 0 for x in got)


def test_decision_like_brute_force(spark):
    """Shares of n-grams per language by sets and loops, corrected for the fill of each slice."""
    docs = table(spark, SF, "documents").where("text IS NOT NULL")
    model = op.learn(spark, docs)
    rows = docs.select("doc_id", "text").where("doc_id % 40 = 0").collect()
    got = {x.doc_id: x for x in op.identify(spark, docs, model).collect()}
    for d in rows:
        keys = common.mix(np.array([int.from_bytes(g, "big") for g in brute_grams(d.text)], np.uint64))
        share = []
        for k in range(len(model.languages)):
            hits = sum(all(int(model.masks[0][int(op.slot(x, h))]) >> k & 1 for h in range(op.HASHES)) for x in keys[:, None].ravel())
            false = model.false_rate[k]
            share.append(min(1, max(0, (hits - false * len(keys)) / max(1, len(keys)) / max(1e-9, 1 - false))))
        best = max(range(len(share)), key=lambda k: (share[k], -k))
        rest = max([x for k, x in enumerate(share) if k != best], default=0)
        if any(x.isalpha() for x in d.text):
            assert got[d.doc_id].lang_pred == model.languages[best]
            assert abs(got[d.doc_id].score - (share[best] / (share[best] + rest) * min(1, 2 * share[best]) if share[best] else 0)) < 1e-9
