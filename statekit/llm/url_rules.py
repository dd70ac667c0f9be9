"""URL filter by association rules: fixed rules first, mined token combinations for the rest.

The urls that the fixed rules decide are the labelled ones. Spark's FP-growth mines which combinations of url
tokens go with a verdict; rules below the support or confidence, and rules that a shorter one already implies, are
pruned in Spark, all others are kept. A url is judged by the best mined rule whose tokens it has, found by an inverted
index that lists each rule under its rarest token.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.llm import common as c
from statekit.session import durable

# Fixed rules: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SUPPORT, CONFIDENCE = 0.002, 0.7
MOST_TOKENS = None  # of a url, for mining: all
MOST_SENT = 200_000  # rules that are sent to the tasks; more are joined
DEFAULT = "allow"


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(after, "^([^/?#]*)", 1)
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fixed rule that fits, as text, and its verdict."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: labels of the host by place, words in them, path segments and keys of the query; digits read #."""
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    labels = F.split(shape(host), "\\.")
    top = F.transform(F.slice(F.reverse(labels), 1, 3), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    words = F.transform(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("w:"), x))
    segments = F.transform(F.split(shape(path), "/"), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.split(F.regexp_extract(url, "\\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1)))
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(url, "^([^:]*)://", 1)))
    every = F.array_distinct(F.concat(top, words, segments, keys, scheme))
    return F.filter(every, lambda x: F.length(F.regexp_extract(x, ":(.*)", 1)) > 0)


def prepared(pages: DataFrame) -> DataFrame:
    df = pages.select(F.col("page_id"), F.coalesce("url", F.lit("")).alias("_url"))
    host, path = parts(F.col("_url"))
    df = df.withColumns({"host": host, "path": path})
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    return df.withColumns({"rule": rule, "fixed": verdict, "tokens": tokens(F.col("host"), F.col("path"), F.col("_url"))})


def rules(rows: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Pruned rules from all rows with a fixed verdict: items, verdict, confidence, support.

    Three kinds of tokens say nothing in company and are rules by themselves only: those of one verdict, which imply
    their supersets; those of all rows; and of tokens that stand in the same rows all but one, which stands for
    its class while Spark's FP-growth mines the sets and is replaced by each of them afterwards.
    """
    spark = rows.sparkSession
    labels = sorted({v for *_, v in RULES})
    counts = [f"n{k}" for k in range(len(labels))]
    known = rows.where("fixed IS NOT NULL").select(F.array_sort("tokens").alias("items"), F.col("fixed").alias("verdict"))
    known = durable(spark, known, "labelled-urls")
    every = known.count()
    least = max(1, math.ceil(support * every))
    marks = [F.xxhash64("items", F.lit(k)).cast("decimal(20,0)").alias(f"mark{k}") for k in range(2)]
    single = known.select("verdict", *marks, F.explode("items").alias("token")).groupBy("token")
    single = single.agg(*[F.sum((F.col("verdict") == v).cast("long")).alias(n) for v, n in zip(labels, counts, strict=True)], F.sum("mark0").alias("mark0"), F.sum("mark1").alias("mark1"))
    single = single.withColumns({"total": sum((F.col(n) for n in counts), F.lit(0)), "most": F.greatest(*counts)}).where(F.col("most") >= least)
    single = durable(spark, single, "url-tokens")
    classes = single.where((F.col("most") < F.col("total")) & (F.col("total") < every)).groupBy("mark0", "mark1", *counts)
    classes = durable(spark, classes.agg(F.min("token").alias("rep"), F.collect_list("token").alias("members")).select("rep", "members"), "url-classes")
    # At most the tokens of a url / support of them.
    heads = spark.sparkContext.broadcast(frozenset(r.rep for r in classes.select("rep").collect()))

    def baskets(batch: pa.RecordBatch):
        have = zip(batch.column("items").to_pylist(), batch.column("verdict").to_pylist(), strict=True)
        yield {"items": [[*(t for t in got if t in heads.value), f"={verdict}"] for got, verdict in have]}

    found = single.select(F.array("token").alias("items"), "total", *counts)
    out = [rated(found.withColumns({f"below{k}": F.lit(0.0) for k in range(len(labels))}), labels, least, confidence)]
    if heads.value:
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(c.map_batches(known, baskets, "items array<string>"))
        out += [rated(x, labels, least, confidence) for x in levels(spark, model.freqItemsets, labels)]
    lone, *larger = out
    for x in larger:
        lone = lone.unionByName(members(x, classes))
    return lone.select("items", "verdict", "confidence", (F.col("n") / max(1, every)).alias("support"))


def levels(spark: SparkSession, frequent: DataFrame, labels: list[str]) -> Iterator[DataFrame]:
    """Frequent token sets of two and more, by size, with the best confidence that a proper subset has for each verdict."""
    label = lambda x: x.startswith("=")
    counts = [F.coalesce(F.max(F.when(F.array_contains("items", f"={v}"), F.col("freq"))), F.lit(0)).alias(f"n{k}") for k, v in enumerate(labels)]
    sets = frequent.withColumn("found", F.array_sort(F.filter("items", lambda x: ~label(x)))).where("size(found) > 0").groupBy("found")
    sets = sets.agg(F.max(F.when(~F.exists("items", label), F.col("freq"))).alias("total"), *counts).withColumnRenamed("found", "items")
    sets = durable(spark, sets.where(F.greatest(*[f"n{k}" for k in range(len(labels))]) > 0), "url-sets")
    rate = {f"best{k}": F.col(f"n{k}") / F.col("total") for k in range(len(labels))}
    below = sets.where("size(items) = 1").withColumns(rate)
    for size in range(2, (sets.agg(F.max(F.size("items"))).first()[0] or 0) + 1):
        one_less = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda at: F.filter("items", lambda x, k: k != at))
        parts = sets.where(F.size("items") == size).withColumn("part", F.explode(one_less))
        parts = parts.join(below.select(F.col("items").alias("part"), *rate), "part").groupBy("items", "total", *[f"n{k}" for k in range(len(labels))])
        now = durable(spark, parts.agg(*[F.max(f"best{k}").alias(f"below{k}") for k in range(len(labels))]), "url-level")
        yield now
        below = now.withColumns({best: F.greatest(q, F.col(best.replace("best", "below"))) for best, q in rate.items()})


def rated(sets: DataFrame, labels: list[str], least: int, confidence: float) -> DataFrame:
    """The rules among token sets: often and sure enough, and surer than with any token less."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(f"n{k}").alias("n"), F.col(f"below{k}").alias("below")) for k, v in enumerate(labels)]))
    each = sets.select("items", "total", each.alias("r")).select("items", "r.*", (F.col("r.n") / F.col("total")).alias("confidence"))
    return each.where((F.col("n") >= least) & (F.col("confidence") >= confidence) & (F.col("confidence") > F.col("below"))).drop("below")


def members(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Every rule once for each choice of tokens from the classes of its tokens."""
    lists = found.withColumn("rep", F.explode("items")).join(classes, "rep").groupBy("items", "verdict", "n", "confidence").agg(F.collect_list("members").alias("lists"))
    choices = F.aggregate("lists", F.array(F.array().cast("array<string>")), lambda got, more: F.flatten(F.transform(got, lambda x: F.transform(more, lambda t: F.concat(x, F.array(t))))))
    return lists.select(F.explode(choices).alias("items"), "verdict", "n", "confidence").withColumn("items", F.array_sort("items"))


def ranked(found: DataFrame) -> list[tuple[frozenset, str, float, float]]:
    """Rules from the best to the worst: by confidence, length, support and name."""
    out = [(frozenset(r["items"]), r.verdict, r.confidence, r.support) for r in found.collect()]
    return sorted(out, key=lambda r: (-round(r[2], 9), len(r[0]), -r[3], sorted(r[0])))


def mine(rows: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[frozenset, str, float, float]]:
    """``rules`` as a list, the best first."""
    return ranked(rules(rows, support, confidence))


def inverted(rules: list) -> dict[str, list[tuple[int, frozenset, str]]]:
    """Rules by their rarest token, each with its rank."""
    count = defaultdict(int)
    for tokens_, *_ in rules:
        for t in tokens_:
            count[t] += 1
    index = defaultdict(list)
    for rank, (tokens_, verdict, *_) in enumerate(rules):
        index[min(tokens_, key=lambda t: (count[t], t))].append((rank, tokens_, verdict))
    return dict(index)


def judge(spark: SparkSession, pages: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most_sent: int = MOST_SENT) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, mined (tokens of the mined rule, or null).

    A null url, or one without ``://``, has empty host and path and no tokens. A url that no rule fits is allowed.
    Equal rules are ranked by confidence, length, support and name. Nothing labelled: nothing mined. Other columns
    are ignored, repeated rows stay repeated. Up to ``most_sent`` rules go to the tasks as an inverted index; more of them
    are joined by their rarest token, with the same result.
    """
    rows = prepared(pages)
    found = durable(spark, rules(rows, support, confidence), "url-rules")
    out = matched(spark, rows, ranked(found)) if found.count() <= most_sent else joined(rows, found)
    verdict = F.coalesce("fixed", "learned", F.lit(DEFAULT)).alias("verdict")
    return out.select("page_id", "host", "path", "rule", verdict, F.when(F.col("fixed").isNull(), F.col("mined")).alias("mined"))


def matched(spark: SparkSession, rows: DataFrame, found: list) -> DataFrame:
    """The best rule of each row, by the index in the tasks."""
    shared = spark.sparkContext.broadcast(inverted(found))

    def match(batches):
        for batch in batches:
            verdicts, names = [], []
            for got in batch.column("tokens").to_pylist():
                mine_ = set(got or ())
                fits = [r for t in mine_ for r in shared.value.get(t, ()) if r[1] <= mine_]
                _, items, verdict = min(fits, key=lambda r: r[0]) if fits else (None, None, None)
                verdicts.append(verdict)
                names.append(items and " ".join(sorted(items)))
            out = [batch.column(x) for x in ("page_id", "host", "path", "rule", "fixed")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(verdicts, pa.string()), pa.array(names, pa.string())], names=["page_id", "host", "path", "rule", "fixed", "learned", "mined"])

    ids = dict(rows.dtypes)["page_id"]
    return rows.select("page_id", "host", "path", "rule", "fixed", "tokens").mapInArrow(match, f"page_id {ids}, host string, path string, rule string, fixed string, learned string, mined string")


def joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The best rule of each row, by a join of the distinct token sets with the rules under their rarest token."""
    token = found.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = found.withColumn("token", F.explode("items")).join(token, "token").groupBy("items", "verdict", "confidence", "support").agg(F.min(F.struct("n", "token")).alias("key"))
    order = F.struct((-F.round("confidence", 9)).alias("q"), F.size("items").alias("k"), (-F.col("support")).alias("s"), F.array_sort("items").alias("items"), "verdict")
    index = index.select(F.col("key.token").alias("token"), "items", order.alias("order"))
    sets = rows.select(F.array_sort("tokens").alias("set")).distinct()
    fits = sets.withColumn("token", F.explode("set")).join(index, "token").where(F.size(F.array_except("items", "set")) == 0)
    best = fits.groupBy("set").agg(F.min("order").alias("best"))
    out = rows.withColumn("set", F.array_sort("tokens")).join(best, "set", "left")
    return out.select("page_id", "host", "path", "rule", "fixed", F.col("best.verdict").alias("learned"), F.array_join("best.items", " ").alias("mined"))
