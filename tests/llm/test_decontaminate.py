import hashlib
import random
import re

from statekit.llm import decontaminate as op

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))


def brute(docs, items):
    out = {}
    windows = [(i, tuple(w[x : x + 10])) for i, t in items for w in [words(t)] for x in range(max(1, len(w) - 9)) if w]
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for i, win in windows:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found.add(i)
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["a", "be", "çé", "day", "x9", "über", "the", "of"]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(prose(n))) for k, n in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 30, 30, 25, 12])]
    items += [(20, None), (21, "..."), (22, "the, the the"), (23, items[8][1].upper())]
    docs = []
    for k in range(60):
        text = prose(r.randint(0, 80))
        if k % 2:
            part = items[r.randrange(5, 12)][1].split()
            lo = r.randint(0, max(0, len(part) - 10))
            text[10:10] = part[lo : lo + r.randint(8, 20)]
        docs.append((k, r.choice([" ", ", ", "\n"]).join(text).title()))
    docs += [(90, None), (91, ""), (92, "the the"), (93, "çé " * 3000), (94, " ".join(prose(3000)))]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_words int").repartition(4)
    b = spark.createDataFrame([(str(i), t, "z") for i, t in items] + [("5", items[5][1], "z")], "item_id string, text string, gram string")
    got = op.find_leaks(spark, d, b).collect()
    assert {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got} == brute(docs, [(str(i), t) for i, t in items])


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(None, "a b"), (1, "a b c"), (1, "a b c"), (1, "d")], "doc_id long, text string")
    item = spark.createDataFrame([(None, "b c"), (7, "D")], "item_id long, text string")
    assert op.find_leaks(spark, none, item).count() == 0
    assert [x.n_hit for x in op.find_leaks(spark, one, no_items).collect()] == [0, 0, 0]
    got = sorted((x.doc_id or 0, x.n_words, x.n_hit, x["items"]) for x in op.find_leaks(spark, one, item).collect())
    assert got == [(0, 2, 0, []), (1, 1, 1, ["7"]), (1, 3, 2, ["null"])]


def test_a_window_of_many_items(spark):
    """A sentence that all items share is one window; null is no name."""
    shared = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(f"i{k}", shared) for k in range(400)] + [(None, shared), ("null", shared + " eleven")], "item_id string, text string")
    docs = spark.createDataFrame([(k, f"before {shared} after {k}") for k in range(50)] + [(50, shared + " eleven"), (51, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in op.find_leaks(spark, docs, items).collect()}
    want = sorted([f"i{k}" for k in range(400)] + ["null", "null"])
    assert all(got[k].items == want and got[k].n_items == 402 and got[k].n_hit == 10 for k in range(50))
    assert got[50].items == want and got[50].n_hit == 11 and not got[51].contaminated and got[51].items == []
