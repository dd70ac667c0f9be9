import random
import re
from collections import Counter

from statekit.llm import quality as op
from statekit.llm.common import table

SF = "/root/testdata/sf0.01"
SPACES = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(hit), failed)


def test_counts_like_brute_force(spark):
    r = random.Random(6)
    words = ["a", "b", "é#", "<x>", "ﬁ", "\u00a0", "%", "cc"]
    texts = ["".join(r.choice(words) + r.choice([" ", "\n", "\t", "  ", "\x0b"]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += [" ".join(str(i % m) for i in range(n)) for m in (3, 9, 40, 70) for n in (5, 8, 9, 40, 100)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, " \n \n"), (903, "word " * 3000), (904, "x\nx\n\nx\r\n"), (905, "same"), (905, "same"), (None, "null id")]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, score int, weights string").repartition(3)
    trusted = op.trusted_ids(spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int"))
    got = op.judge(spark, docs, trusted).collect()
    assert sorted(((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert all(not (x.base_failed and x.kept) for x in got)


def test_score_tells_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = op.judge(spark, docs, op.trusted_ids(labels)).where("NOT base_failed").join(labels, "doc_id").collect()
    good, bad = ([x.score for x in got if x.quality == q] for q in (1, 0))
    assert sum(s >= -0.06 for s in good) >= 0.98 * len(good) and sum(s < -0.06 for s in bad) >= 0.9 * len(bad)


def test_score_like_brute_force(spark):
    rows = [(1, "a b a"), (2, "b c"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    import math

    grams = {i: [*t.split(), *zip(t.split(), t.split()[1:])] for i, t in rows}
    raw, target = Counter(g for x in grams.values() for g in x), Counter(grams[1])
    n, m = sum(raw.values()) + op.BUCKETS, sum(target.values()) + op.BUCKETS
    w = {g: math.log((target[g] + 1) / m) - math.log((raw[g] + 1) / n) for g in raw}
    got = {x.doc_id: x.score for x in op.judge(spark, docs, op.trusted_ids(labels)).collect()}
    assert all(abs(got[i] - sum(w[g] for g in x) / len(x)) < 1e-12 for i, x in grams.items())


def test_empty_and_native(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = op.judge(spark, docs, op.trusted_ids(labels))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
