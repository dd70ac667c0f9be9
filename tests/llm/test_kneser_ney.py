"""The language model against a plain one in Python, its probabilities' sum, base figures, odd rows, long texts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statekit.llm import kneser_ney, queries

SF = "/root/testdata/sf0.001"


def words_of(text):
    lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    return [w for w in re.split("[ \t\n\x0b\x0c\r]", lower) if w] + ["</s>"]


class Plain:
    def __init__(self, texts, order):
        self.order, self.raw = order, Counter(w for t in texts for w in words_of(t))
        top = Counter()
        for t in texts:
            line = ["<s>"] * (order - 1) + words_of(t)
            top.update(tuple(line[i : i + order]) for i in range(len(line) - order + 1))
        self.counts = {order: top}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.cut, self.totals, self.spare = {}, {}, {}
        for k, f in self.counts.items():
            t = Counter(f.values())
            self.cut[k] = kneser_ney.discounts(t[1], t[2], t[3], t[4])
            self.totals[k], self.spare[k] = Counter(), defaultdict(float)
            for g, n in f.items():
                self.totals[k][g[:-1]] += n
                self.spare[k][g[:-1]] += self.cut[k][min(n, 3)]

    def p(self, context, word):
        if not self.raw:
            return 1.0
        p = 1 / (len(self.raw) + 1)
        for k in range(1, self.order + 1):
            before = tuple(context[len(context) - k + 1 :])
            total = self.totals[k][before]
            if total:
                n = self.counts[k][(*before, word)]
                p = (n - self.cut[k][min(n, 3)] + self.spare[k][before] * p) / total
        return p

    def score(self, text):
        line = ["<s>"] * (self.order - 1) + words_of(text)
        at = range(self.order - 1, len(line))
        base = sum(math.log10((self.raw[line[i]] + 1) / (sum(self.raw.values()) + len(self.raw) + 1)) for i in at)
        return len(at), sum(line[i] in self.raw for i in at), base, sum(math.log10(self.p(line[i - self.order + 1 : i], line[i])) for i in at)


def held(spark, texts, order, scored=None):
    scored = texts if scored is None else scored
    df = spark.createDataFrame(list(enumerate(scored)), "doc_id long, text string").withColumns({"n": F.lit(1), "part": F.lit("x"), "score": F.lit(None)})
    model = kneser_ney.fit(spark, spark.createDataFrame([(t,) for t in texts], "text string"), order)
    got = sorted(kneser_ney.score(spark, df, model).collect())
    plain = Plain(texts, order)
    for r, text in zip(got, scored, strict=True):
        n, known, base, total = plain.score(text)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, sum(plain.raw.values()))
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9) and r["score"] == pytest.approx(total, rel=1e-5, abs=1e-6)
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / n), rel=1e-9)
    return model, plain


def texts(seed, n, most=40):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "é", "The", "THE", "\x00", "\x1c", "𝔘"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [rng.choice(["", " "]) + "".join(w + rng.choice([" ", "  ", "\t", "\n", "\r\n"]) for w in rng.choices(words, weights, k=rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_a_plain_model(spark, order):
    unseen = [None, "", "never seen words w1", " \n ", "w0 " * 300]
    model, plain = held(spark, texts(order, 250), order, texts(order + 50, 40) + unseen)
    assert len(model.hot) > 5
    for context in (["w0", "w1"], ["w3", "nowhere"], ["<s>", "<s>"]):
        assert sum(plain.p(context, w) for w in [*plain.raw, "nowhere"]) == pytest.approx(1)


def test_blocks_and_long_texts(spark, monkeypatch):
    """Many blocks to a task, and a text of several pieces whose words carry over."""
    monkeypatch.setattr(kneser_ney, "BLOCK", 50)
    long = " ".join(random.Random(1).choices(["a", "b", "cc", "ddd", "e" * 50], k=150_000))
    assert len(long) > 1 << 20
    held(spark, [long, *texts(3, 60)], 3, [long, "a b cc", "x" * (3 << 20)])


@pytest.mark.parametrize("rows", [[], [None], ["", ""], ["one"], ["a b"] * 7])
def test_small_tables(spark, rows):
    held(spark, rows, 2, [*rows, "a b c"])


def test_files_written_twice_are_the_same(spark, tmp_path):
    root = f"file://{tmp_path}"
    keys, values = np.arange(5, dtype=np.uint64), np.arange(5).astype(kneser_ney.RAW)
    for _ in range(2):
        kneser_ney.put_table(root, "t", 1001, keys, values)
    assert [p.name for p in tmp_path.rglob("*") if p.is_file()] == ["1001"]
    found = kneser_ney.looked_up(root, "t", kneser_ney.RAW, np.full(2, 1001), np.array([3, 9], np.uint64))
    assert found["n"].tolist() == [3, 0]


def test_whole_table(spark):
    got = queries.QUERIES["op13_lm_scoring"](spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["text"]
    out = {i for i in docs.index if zlib.crc32(str(i).encode()) % 7 == 2}
    assert set(got.index[got["held_out"]]) == out and len(got) == len(docs)
    plain = Plain([t for i, t in docs.items() if i not in out], kneser_ney.ORDER)
    for i in [*sorted(out)[:20], *docs.index[:20]]:
        n, known, base, total = plain.score(docs[i])
        r = got.loc[i]
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(total, rel=1e-5)
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()
