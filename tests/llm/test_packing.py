import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from statekit.llm import packing as op

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got, window):
    tokenizer = Tokenizer.from_file(PATH)
    docs = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    seen, filled = defaultdict(list), defaultdict(list)
    for p in got:
        ids = docs[p.doc_id][p.start : p.start + p.length]
        assert len(ids) == p.length > 0 and zlib.crc32(ids.tobytes()) == p.ids_crc32 and p.doc_tokens == len(docs[p.doc_id])
        seen[p.doc_id].append((p.start, p.length))
        filled[p.sequence_id].append((p.offset, p.length))
    for parts, size in [*((seen[i], len(d)) for i, d in docs.items()), *((f, None) for f in filled.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == size or (size is None and at <= window)
    padding = 0
    for parts in filled.values():
        n = sum(x for _, x in parts)
        padding += 0 if n & (n - 1) == 0 else window - n
    return padding


@pytest.mark.parametrize("window", [16, 2048])
def test_round_trip(spark, monkeypatch, window):
    monkeypatch.setattr(op, "BUCKET_ROWS", 20)
    r = random.Random(2)
    words = ["the", "It's", "naïve", "x", "123", "--'s", "Straße", "<|endoftext|>", "ΑΣ", "éa", "½", "\x1c", "a\xa0b", "don't"]
    rows = [(i, r.choice([" ", "\n", ""]).join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(150)]
    rows += [(200 + i, "same length here") for i in range(90)] + [(400, None), (401, ""), (402, "long " * 9000)]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n int").repartition(4)
    got = op.pack(spark, df, PATH, window=window).collect()
    assert check(rows, got, window) == 0


def test_plan_fits():
    r = np.random.default_rng(1)
    histogram = np.r_[0, r.poisson(40, 63), 0]
    rows, repeats = op.plan(histogram, 64)
    used = np.bincount(rows.ravel(), np.repeat(repeats, 3), 65)
    used[0] = 0
    assert (used <= histogram).all() and (rows.sum(axis=1) == 64).all() and used.sum() > 0.9 * histogram.sum()


def test_edges(spark):
    assert op.pack(spark, spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    df = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c"), (1, "d")], "doc_id long, text string")
    got = op.pack(spark, df, PATH).collect()
    assert sorted((p.doc_id or 0, p.doc_tokens) for p in got if p.start == 0) == [(0, 2), (1, 2), (1, 3)]


def test_pieces_are_encoded_together(monkeypatch):
    tokenizer, bare, *rest, cache = op.encoder(PATH)
    calls = []

    class Counting:
        def encode(self, *args, **options):
            calls.append(1)
            return bare.encode(*args, **options)

    cache.clear()
    monkeypatch.setattr(op, "encoder", lambda path: (tokenizer, Counting(), *rest, cache))
    r = random.Random(4)
    signs = [*map(chr, range(256)), *"stmdrevel''' 0½" * 20, "'ll", "'RE"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 90))) for _ in range(2000)]
    texts += ["", "a’s Σ", "<|endoftext|>'s", "word " * 300_000 + "x" * 40, "é" * 3000]
    got = op.encode(PATH, texts)
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) < 500


def test_a_full_cache_starts_again(monkeypatch):
    monkeypatch.setattr(op, "CACHE", 50)
    tokenizer = op.encoder(PATH)[0]
    for k in range(5):
        text = " ".join(f"word{chr(97 + i)}{chr(97 + k)}" for i in range(20))
        assert op.encode(PATH, [text, text])[1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(op.encoder(PATH)[-1]) <= 50
