import random

import pytest

from statekit.llm import jaccard_join as op


def grams(text, width):
    w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    return {tuple(w)} - {()} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent):
    sets = {i: grams(t, width) for i, t in rows}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    order = sorted(sets)
    for x in order:
        for y in order:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                label[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def rows_for_test(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, i = [], 0
    for size in [3, 5, 10, 11, 20, 40, 90, 200, 400]:
        for _ in range(3):
            base = prose(size)
            for k in range(9):
                copy = list(base)
                for _ in range(r.randint(0, 1 + size // 60)):
                    copy[r.randrange(len(copy))] = r.choice(vocabulary)
                if k % 3 == 2:
                    copy = copy[: -r.randint(1, max(1, size // 12))]
                rows.append((i := i + 1, " ".join(copy)))
    base = prose(150)
    for _ in range(90):
        copy = list(base)
        for _ in range(r.randint(0, 7)):
            copy[r.randrange(150)] = r.choice(vocabulary)
        rows.append((i := i + 1, "\n".join(copy).title()))
    notice = prose(60)
    rows += [((i := i + 1), " ".join(notice + prose(40))) for _ in range(50)]
    return rows + [(9001, None), (9002, ""), (9003, " \n "), (9004, "One"), (9005, "one"), (9006, "one two"), (9007, "a b c " * 300), (9008, "a b c " * 20)]


@pytest.mark.parametrize(("width", "percent", "few"), [(3, 90, 32), (3, 90, 3), (5, 80, 8)])
def test_against_brute_force(spark, monkeypatch, width, percent, few):
    monkeypatch.setattr(op, "FEW", few)
    rows = rows_for_test(few)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, component_id int").repartition(6)
    got = op.jaccard_components(spark, df, width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, width, percent)
    assert len(got) == len(rows)


def test_levels_meet():
    for percent in (80, 90):
        low, partner, blocks, _ = op.levels(percent, 5000)
        level = lambda n: [k for k in range(len(blocks)) if (low[k] <= n < low[k + 1]) or (k + 1 < len(low) and low[k + 1] <= n and n <= partner[k] and n < low[k + 2])]
        for n in range(1, 700):
            for m in range(n, n * 100 // percent + 1):
                assert set(level(n)) & set(level(m))


def test_edges(spark):
    assert op.jaccard_components(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "A b c d e f"), (4, "A b c d e f"), (4, "x")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in op.jaccard_components(spark, df).collect())
    assert got == [(0, 2, None), (4, 1, 4), (4, 2, None)]
