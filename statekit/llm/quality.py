"""Quality rules in DataFrame functions only: hashed n-gram likelihood ratio and fixed repetition rules.

Words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials are counted over them, one of all
documents and one of the trusted ones, and a document's score is the mean of log(p_trusted / p_raw) over its
n-grams, so that length doesn't matter. A document is kept if it passes the fixed rules and its score
reaches the threshold; the same text always gets the same verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.llm import common as c
from statekit.session import durable

BUCKETS = 1 << 14
TRUSTED_ROWS = 20_000
THRESHOLD = -0.06
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RUN = 8


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def without(text: Column, signs: str) -> Column:
    return F.translate(text, signs, "")


def run_hashes(hashes: Column) -> Column:
    """Hash of every run of RUN words, from the hashes of the words."""
    starts = F.when(F.size(hashes) >= RUN, F.sequence(F.lit(0), F.size(hashes) - RUN)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(RUN)]))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the four counts, n_words and the hashes of the words."""
    text = F.col("text")
    df = docs.select("doc_id", text, word_list(text).alias("words"))
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) != "")
    df = df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(without(text, SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    df = df.withColumn("runs", run_hashes(F.col("hashes")))
    # Most texts repeat no run, which a set of the hashes shows; only the others sort them with their places.
    placed = F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = F.size("runs") > F.size(F.array_distinct("runs"))
    df = df.withColumn("placed", F.when(again, placed).otherwise(F.array().cast("array<struct<h: bigint, i: int>>"))).drop("runs")
    same = lambda x, k: F.coalesce(F.get("placed", k)["h"] == x["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter("placed", lambda x, k: same(x, k + 1) | same(x, k - 1)), lambda x: x["i"]))
    df = df.withColumn("places", places).drop("placed")
    covers = F.transform("places", lambda p, k: F.least(F.lit(RUN), F.coalesce(F.get("places", k + 1) - p, F.lit(RUN))))
    return df.withColumn("n_repeat_words", F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x)).drop("places")


def buckets(hashes: Column) -> Column:
    """Bucket of every word and of every pair of neighbours."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    two = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(one, F.slice(two, 1, F.greatest(F.lit(0), F.size(hashes) - 1)))


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """At most so many ids of trusted rows (quality 1), the first by hash: a bounded sample to broadcast."""
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def weights(spark: SparkSession, docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row: the log ratio of every bucket, add-one smoothed, counted over all documents."""
    marked = docs.join(F.broadcast(trusted.withColumn("trusted", F.lit(1))), "doc_id", "left")
    hashes = marked.select("trusted", F.transform(word_list(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    grams = hashes.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), F.explode(buckets(F.col("hashes"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))
    counts = durable(spark, counts, "quality-counts")  # a row per bucket
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    ratio = F.log((F.col("target") + 1) / F.lit(float(total.target + BUCKETS))) - F.log((F.col("raw") + 1) / F.lit(float(total.raw + BUCKETS)))
    return every.select("bucket", ratio.alias("w")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "w"))), lambda x: x["w"]).alias("weights"))


def judge(spark: SparkSession, docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_words, the four counts, base_failed, kept, score.

    Null text counts as empty: no words, score 0, failed. Without trusted rows all scores are 0. Repeated rows
    stay repeated; other columns are ignored. Scores and verdicts depend on the text and the counts only.
    """
    rows = c.documents(docs)
    table = weights(spark, rows, trusted).scalar()
    df = measures(rows).withColumn("buckets", buckets(F.col("hashes"))).drop("hashes")
    total = F.aggregate("buckets", F.lit(0.0), lambda a, b: a + F.get(F.col("weights"), b))
    df = df.withColumn("weights", table).withColumn("score", F.coalesce(total / F.nullif(F.size("buckets"), F.lit(0)), F.lit(0.0)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = [F.col(x) for x in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    out += [failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), F.col("score")]
    # inline() stops a later filter from being pushed down, which would evaluate everything once more per use.
    return df.select(F.inline(F.array(F.struct(*out))))
