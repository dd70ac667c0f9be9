"""Benchmark decontamination as a prefix-filtered set join with exact verification.

An item's windows are sets of word shingles; to contain a window, a document must contain its rarest
shingle, so that one shingle per window is the necessary prefix (containment 1.0 leaves no slack).

1. Shingles of all windows are counted over the whole corpus, which gives the order by rarity.
2. Every document shingle that is the prefix of some window is joined to these windows by its hash.
3. Length and position: a window of n words whose prefix stands at word k fits only if k words precede the
   match and n - k follow it in the document.
4. The words of the window are compared with the document's words at that place.

Only two Bloom filters of fixed size (2 MB) are sent to the tasks; they keep other shingles from being shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.llm import common as c
from statekit.session import durable

WINDOW, SHINGLE = 10, 3
BITS = 1 << 24
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_hashes(batch: pa.RecordBatch):
    """Folded bytes, word bounds and the shingles of 1 to SHINGLE words at each word (crossing texts, too)."""
    data, at = c.buffer(batch.column("text"))
    data = c.FOLD[data]
    start, stop, first = c.words(data, at, WORD)
    word = c.span_hash(c.prefix_hash(data), start, stop)
    grams = [c.mix(word + np.uint64(1))]
    for k in range(1, SHINGLE):
        grams.append(c.pair(grams[-1][:-1], word[k:]) if len(grams[-1]) else grams[-1])
    return data, at, start, stop, first, grams


def windows_of(window: int):
    def run(batch: pa.RecordBatch):
        """Every window of every item with its words and the shingles at each of its words."""
        data, _, start, stop, first, grams = word_hashes(batch)
        items = batch.column("item_id").to_pylist()
        out: dict[str, list] = {"item_id": [], "words": [], "size": [], "grams": []}
        for k, item in enumerate(items):
            lo, hi = int(first[k]), int(first[k + 1])
            n = min(window, hi - lo)
            for x in range(lo, hi - n + 1) if n else ():
                width = min(SHINGLE, n)
                out["item_id"].append(item)
                out["words"].append(b" ".join(data[start[w] : stop[w]].tobytes() for w in range(x, x + n)))
                out["size"].append(n)
                out["grams"].append([{"gram": int(g), "place": p} for p, g in enumerate(grams[width - 1][x : x + n - width + 1].view(np.int64))])
        yield out

    return run


def bloom(grams: DataFrame) -> np.ndarray:
    """A Bloom filter with two bits per shingle, put together in Spark: BITS / 8 bytes whatever the input."""
    bit = [F.pmod(F.col("gram"), F.lit(BITS)), F.pmod(F.shiftrightunsigned("gram", 32), F.lit(BITS))]
    bits = grams.select(F.explode(F.array(*bit)).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def known(filter_: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which shingles may be in the filter."""
    low, high = (grams & np.uint64(BITS - 1)).astype(np.int64), ((grams >> np.uint64(32)) & np.uint64(BITS - 1)).astype(np.int64)
    found = np.flatnonzero((filter_[low >> 3] >> (low & 7).astype(np.uint8)) & 1)
    return found[((filter_[high[found] >> 3] >> (high[found] & 7).astype(np.uint8)) & 1) == 1]


def count_grams(shared, widths: list[int]):
    def run(batch: pa.RecordBatch):
        *_, first, grams = word_hashes(batch)
        for width in widths:
            got = grams[width - 1][known(shared.value, grams[width - 1])]
            gram, n = np.unique(got, return_counts=True)
            yield {"gram": gram, "n": n}

    return run


def find_prefixes(shared, widths: list[int], window: int):
    def run(batch: pa.RecordBatch):
        """Per document its number of words, and each place of a prefix shingle with the words around it."""
        data, at, start, stop, first, grams = word_hashes(batch)
        hits: list[list] = [[] for _ in range(batch.num_rows)]
        for width in widths:
            for x in known(shared.value, grams[width - 1]):
                k = int(np.searchsorted(first, x, "right")) - 1
                lo, hi = max(int(first[k]), x - window + 1), min(int(first[k + 1]), x + window)
                if x + width <= first[k + 1]:
                    near = b" ".join(data[start[w] : stop[w]].tobytes() for w in range(lo, hi))
                    hits[k].append({"gram": int(grams[width - 1][x].view(np.int64)), "at": int(x - first[k]), "before": int(x - lo), "near": near})
        yield {"doc_id": c.ids(batch), "n_words": np.diff(first), "hits": hits}

    return run


def covered(batch: pa.RecordBatch):
    """Words covered by the found windows."""
    n = []
    for found in batch.column("spans").to_pylist():
        total, end = 0, -1
        for a, b in sorted((f["start"], f["start"] + f["size"]) for f in found):
            total += max(0, b - max(a, end))
            end = max(end, b)
        n.append(total)
    yield {"doc_id": batch.column("doc_id"), "n_hit": n, "windows": batch.column("windows")}


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, items, contaminated.

    An item shorter than the window is one window. Null texts have no words; a null item id reads 'null'
    and is not the item of that name; items equal in id are one item, repeated windows count once. Ties in rarity go by hash. For null ids,
    repeated rows and ids see ``common.one_each``. Either table may be empty; other columns are ignored.
    """
    c.bounded(spark)
    texts, names = c.one_each(spark, docs)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = c.map_batches(items, windows_of(window), "item_id string, words binary, size int, grams array<struct<gram: long, place: int>>")
    made = durable(spark, made, "leak-made")
    # A window that many items share is looked for once; its items are joined to what was found.
    windows = made.dropDuplicates(["words"]).select(F.monotonically_increasing_id().alias("window"), "words", "size", "grams")
    windows = durable(spark, windows, "leak-windows")
    owners = made.select("item_id", "words").distinct().join(windows.select("window", "words"), "words").select("window", "item_id")
    tokens = windows.select("window", "size", F.explode("grams").alias("g")).select("window", "size", "g.gram", "g.place")
    widths = sorted({min(SHINGLE, r.size) for r in windows.select("size").distinct().collect()})  # at most `window` sizes
    shared = spark.sparkContext.broadcast(bloom(tokens.select("gram")))
    counts = c.map_batches(texts, c.lean(count_grams(shared, widths)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    ranked = tokens.join(counts, "gram", "left").groupBy("window")
    prefixes = ranked.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "place")).alias("p")).where("p.n > 0")
    prefixes = prefixes.select("window", "p.gram", "p.place").join(windows.select("window", "words", "size"), "window")
    prefixes = durable(spark, prefixes, "leak-prefixes")
    shared = spark.sparkContext.broadcast(bloom(prefixes.select("gram")))
    hits = "hits array<struct<gram: long, at: int, before: int, near: binary>>"
    found = durable(spark, c.map_batches(texts, c.lean(find_prefixes(shared, widths, window)), f"doc_id long, n_words long, {hits}"), "leak-hits")
    places = found.select("doc_id", "n_words", F.explode("hits").alias("h")).select("doc_id", "n_words", "h.*")
    pairs = places.join(prefixes, "gram").where("at >= place AND at - place + size <= n_words")
    # The window must start `place` words before the shingle, on the words themselves.
    near = F.split(F.decode("near", "utf-8"), " ")
    same = F.array_join(F.slice(near, F.col("before") - F.col("place") + 1, F.col("size")), " ") == F.decode("words", "utf-8")
    pairs = pairs.where(same).select("doc_id", F.struct((F.col("at") - F.col("place")).alias("start"), "size").alias("span"), "window")
    spans = pairs.groupBy("doc_id").agg(F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("window")).alias("windows"))
    spans = durable(spark, c.map_batches(spans, covered, "doc_id long, n_hit long, windows array<long>"), "leak-spans")
    # Documents with the same windows have the same items.
    listed = spans.select("windows").distinct().withColumn("window", F.explode("windows")).join(owners, "window").groupBy("windows")
    listed = listed.agg(F.collect_set(F.struct("item_id")).alias("items"))
    listed = listed.select("windows", F.sort_array(F.transform("items", lambda x: F.coalesce(x["item_id"], F.lit("null")))).alias("items"))
    digest = F.sha2(F.array_join("items", ","), 256)
    spans = spans.join(listed, "windows").select("doc_id", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "items")
    none = hashlib.sha256(b"").hexdigest()
    out = found.select("doc_id", "n_words").join(spans, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
    return c.shown(out, names)
