"""Phrase mining against plain counting in Python and against the SQL twin."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from statekit.llm import collocations, queries
from tools.check import rows_of

SF = "/root/testdata/sf0.01"


def brute(rows, most, longest, least, percent):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            inside = (q for q in cand if len(q) > len(p) and 100 * cand[q] >= percent * a)
            if any(q[i : i + len(p)] == p for q in inside for i in range(len(q) - len(p) + 1)):
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, i, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.fixture(autouse=True)
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"words": F.lit(1), "prefix": F.lit("x"), "n": F.lit(None)})
    options = {"most": 50, "longest": 5, "least": 4, "percent": 100} | options
    got = collocations.collocations(spark, df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]
    return sorted(tuple(r) for r in got.collect()), brute(rows, **options)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "ab", "É", "é", "New", "YORK", "x\x00", "𝔘", "the", "of", "c d", "-"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", "\r\n", "\x0b", " \x1c"]
    return [(rng.choice(["en", "en", "en", None, "und", "de"]), "".join(rng.choice(words[: rng.randint(3, 13)]) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed, monkeypatch):
    """Small blocks, so that stripes of a key come from many of them; every prefix is hot in one run."""
    monkeypatch.setattr(collocations, "BLOCK", 700)
    monkeypatch.setattr(collocations, "HOT", (1 / 256, 1 / 256, 1e-9)[seed])
    got, want = mined(spark, texts(seed, 300), percent=(100, 60, 100)[seed], least=(4, 3, 20)[seed])
    assert got == want and len(got) > 20


def test_ties_and_repeats(spark):
    rows = [("en", "q w. z y. z y x. q w")] * 5 + [("en", "é f. e f")] * 10
    got, want = mined(spark, rows)
    assert got == want


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    got, want = mined(spark, texts(7, 200))
    assert got == want and got


@pytest.mark.parametrize("rows", [[], [("en", None)], [(None, "")], [("en", ". ,\t \n")], [("en", "a b"), ("en", "a b")]])
def test_nothing_to_mine(spark, rows):
    got, want = mined(spark, rows)
    assert got == want == []


def test_very_long_text(spark, monkeypatch):
    """A text of many blocks counts whole, also one without any end of a piece."""
    monkeypatch.setattr(collocations, "BLOCK", 5_000)
    rng = random.Random(3)
    free = " ".join(rng.choice("abcdefgh") for _ in range(20_000))
    cut = "".join(rng.choice("abcdefgh") + rng.choice([" ", " ", "."]) for _ in range(20_000))
    got, want = mined(spark, [("en", free), ("de", cut)], least=40)
    assert got == want and got


def test_exact_quotient(spark):
    """Products beyond 64 bits, just beside a whole quotient."""
    cases = [(3 * 10**12 + 1, 10**15 + 7, 4 * 10**12, 5 * 10**12), (10**13, 10**15, 10**13, 10**13), (10**13 - 1, 10**15, 10**13, 10**13), (1, 1, 1, 1), (7, 11, 13, 17)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long")
    got = df.select(collocations.quotient(*map(F.col, "anlr"))).collect()
    assert [r[0] for r in got] == [1000 * a * n // (x * y) for a, n, x, y in cases]


def test_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.SQL["op12_phrase_collocations"])
    want = rows_of([d[0] for d in want.description], want.fetchall())
    got = queries.QUERIES["op12_phrase_collocations"](spark, SF)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want and len(want[0]) > 50
