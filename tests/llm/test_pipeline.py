import random

import public_tokenizers
from test_decontaminate import brute as leaks
from test_jaccard_join import brute as components
from test_packing import check
from test_secrets import brute as secrets

import corpus_pipeline as p
from statekit.llm import packing
from statekit.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_like_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    items = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in p.STAGES[:-1]:
        docs = p.durable(spark, stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language ID":
            assert set(after) == {i for i, r in before.items() if r.text and any(x.isalpha() for x in r.text)}
        elif name == "n-gram Jaccard join":
            assert set(after) == {c for _, c in components([(i, r.text) for i, r in before.items()], 5, 80).values()}
        elif name == "benchmark decontamination":
            found = leaks([(i, r.text) for i, r in before.items()], items)
            assert set(after) == {i for i, f in found.items() if not f[-1]}
        else:
            assert set(after) == set(before)
            for i, r in after.items():
                assert secrets(r.text)[:3] == (0, 0, 0) and (r.text == before[i].text or "[secret]" in r.text) and r.n_chars == len(r.text)
        before = after
    rows = [(i, r.text) for i, r in before.items()]
    assert check(rows, p.pack(spark, docs, SF).collect(), packing.WINDOW) == 0
    assert public_tokenizers.path("word_bpe_49k.json")


def test_odd_rows(spark, tmp_path):
    r = random.Random(1)
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the same words again and again", "en", "s", 3), (2, "the same words again and again", "en", "s", 3), (None, "one more text here", None, None, None)]
    rows += [(10 + i, " ".join(r.choice("der die das und the of") for _ in range(30)), "en", "s", 1) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (df, df.where("false")):
        docs = some
        for _, stage in p.STAGES[:-1]:
            docs = p.durable(spark, stage(spark, docs, str(tmp_path)), "stage")
        p.pack(spark, docs, str(tmp_path)).collect()


def test_texts_under_one_id_are_decided_one_by_one(spark, tmp_path):
    leak, clean, other, last = (" ".join(f"{x}{k}" for k in range(40)) for x in ("leak", "clean", "other", "last"))
    spark.createDataFrame([("i", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, leak), (None, clean), (2, leak), (2, other), (3, clean), (3, last), (3, last), (4, clean), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert key(p.leaks(spark, docs, str(tmp_path))) == sorted((r for r in rows if r[1] != leak), key=str)
    want = [(None, leak), (None, clean), (2, other), (3, last), (3, last), (5, None)]
    assert key(p.near_copies(spark, docs, str(tmp_path))) == sorted(want, key=str)
