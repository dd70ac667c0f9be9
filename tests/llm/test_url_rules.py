import re
from itertools import combinations

from pyspark.sql import functions as F

from statekit.llm import url_rules as op


def brute(url):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in host)
    fits = [(len(h + p), h + p, v) for h, p, v in op.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [
    "http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=1", "http://example.org/en/2", "http://b.org", "http://b.org?x", "http://b.org/", "org/", "http://com/de/", "http://xcom/de/",
    "http://a.com/de/5#t", "http://a.com/fr/5", "http://a.com/en/5", "x://y://z.org/a", "://h.com/fr/", None, "", "http://É.org/A?b/c", "http://a-b.c.example.net/de/9.html?q=1&r=2", "http://x.org#a://b",
]


def test_fixed_rules_like_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://x.org/", "", "")], "page_id long, url string, host string, tokens string")
    got = op.judge(spark, df, support=0.9).collect()
    for x in got:
        host, path, rule, verdict = brute(URLS[x.page_id] if x.page_id is not None else "http://x.org/")
        assert (x.host, x.path, x.rule) == (host, path, rule) and (verdict is None or x.verdict == verdict)
    assert len(got) == len(URLS) + 1


def test_mined_rules_like_brute_force(spark):
    urls = [f"http://{a}.example.{t}/{g}/{n}" for a in ("ab",) for t in ("org", "com", "net") for g in ("es", "de", "fr", "en") for n in (1, 22)]
    rows = op.prepared(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).cache()
    known = [(set(sorted(r.tokens)[: op.MOST_TOKENS]), r.fixed) for r in rows.where("fixed IS NOT NULL").collect()]
    want = set()
    for tokens, _ in known:
        for k in range(1, len(tokens) + 1):
            want |= {frozenset(x) for x in combinations(sorted(tokens), k)}
    rated = {}
    for s in want:
        have = [v for t, v in known if s <= t]
        for v in ("allow", "block"):
            if have.count(v) >= 0.05 * len(known) and have.count(v) >= 0.7 * len(have):
                rated[s, v] = have.count(v) / len(have)
    below = lambda s: (frozenset(x) for k in range(1, len(s)) for x in combinations(s, k))
    minimal = {(s, v) for (s, v), q in rated.items() if not any(rated.get((o, v), 0) >= q - 1e-9 for o in below(s))}
    got = op.mine(rows, 0.05, 0.7)
    assert {(s, v) for s, v, *_ in got} == minimal
    index = op.inverted(got)
    for r in rows.collect():
        fits = [k for k, (s, *_) in enumerate(got) if s <= set(r.tokens)]
        found = [x[0] for t in r.tokens for x in index.get(t, ()) if x[1] <= set(r.tokens)]
        assert sorted(found) == fits


def test_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert op.judge(spark, none).count() == 0
    odd = spark.createDataFrame([(1, None), (1, None), (2, "http://a.net/" + "x/" * 20000)], "page_id long, url string")
    assert [x.verdict for x in op.judge(spark, odd).orderBy(F.col("page_id")).collect()] == ["allow"] * 3


def pages(spark, urls):
    return op.prepared(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))


def test_supersets_do_not_crowd_out_a_weaker_rule(spark):
    urls = ["http://a.com/de/b/c/d/e/f/g"] * 20 + ["https://h.example.org/es/i/j/k/l/m"] * 20 + ["http://z.org/mix"] * 3 + ["http://z.com/de/mix"]
    got = {(s, v): round(q, 9) for s, v, q, _ in op.mine(pages(spark, urls), 0.02, 0.7)}
    assert got[frozenset(["p:mix"]), "allow"] == 0.75 and got[frozenset(["p:c"]), "block"] == got[frozenset(["p:i"]), "block"] == 1
    assert all(len(s) <= 2 for s, _ in got)


def test_every_labelled_row_counts(spark):
    urls = F.when(F.col("id") % 2 == 0, "http://a.com/de/x").otherwise("http://b.org/y/z")
    got = {(s, v): (q, share) for s, v, q, share in op.mine(op.prepared(spark.range(410_000).select(F.col("id").alias("page_id"), urls.alias("url"))), 0.1, 0.7)}
    assert got[frozenset(["p:x"]), "block"] == got[frozenset(["p:y"]), "allow"] == (1.0, 0.5)


def test_host_words_of_long_urls(spark):
    deep = "/".join("abcdefghi")
    got = op.mine(pages(spark, [f"http://good.example.org/en/{deep}"] * 5 + [f"http://bad.example.org/es/{deep}"] * 5 + [f"http://ugly.example.org/en/{deep}"]), 0.1, 0.7)
    assert {(frozenset(["w:bad"]), "block", 1.0), (frozenset(["w:good"]), "allow", 1.0)} <= {x[:3] for x in got}


def test_many_common_segments(spark):
    """Twelve segments that each stand in half of the labelled urls, and a way for rules too many to be sent."""
    urls = [f"http://x.org/{'/'.join(f's{chr(97 + k)}' for k in range(12) if (n * 2654435761 >> k + 8) & 1)}/{'es' if n % 3 else 'mix'}" for n in range(2000)]
    urls = [u.replace("x.org", "x.com/de") if n % 2 else u for n, u in enumerate(urls)] + ["http://q.net/sa/sb", "http://q.net/es", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    sent, joined = (sorted(map(tuple, op.judge(spark, df, 0.05, 0.5, most).collect())) for most in (op.MOST_SENT, 0))
    assert sent == joined and len(sent) == len(urls) and any(r[5] for r in sent)
