"""Phrases whose words come together more often than their parts would, mined with stripes.

Level k of one to five counts phrases of k words. Each prefix of k - 1 words keys a *stripe*: an associative counter of
the words that follow it, with one entry (``ELSE``) for whatever else follows, the end of a piece included. A task
fills the stripes of a block of text, Spark merges stripes of a key elementwise, and a merged stripe gives at once the
extensions (its frequent entries), the count of the prefix (its total) and the maximum that may subsume the prefix.

A word is counted on its own in a stripe only if the k - 1 words that end with it are frequent themselves, which a
filter of the last level's extensions tells: every part of a frequent phrase is frequent, so nothing is lost. The filter
has 16 bits for each extension, at most 2**28; a fuller one lets more words through, which changes no result.

Hot keys: the stripe without a prefix (all words of a language) and those of prefixes that hold ``HOT`` or more of all
words (at most 1 / HOT of them, so their list is small) are split into buckets of next words.

Texts are whole: one that is longer than a block is cut where a piece ends, which no phrase crosses. A null text is
empty, a null lang is ``und``, rows with equal ids all count, other columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statekit.llm import common as c
from statekit.session import durable

LONGEST, LEAST, PERCENT = 5, 100, 100
BLOCK = 4 << 20
BUCKETS = 256
HOT = 1 / 256
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 16, 1 << 28, 16
UNKNOWN = "und"
ELSE = "\t"  # no word holds a tab or a space

ENDS = b".,;:!?\n\x0b\x0c\r"
INSIDE = c.split_on(ENDS + b" \t")
END = ~c.split_on(ENDS)

STRIPE = "lang string, prefix string, bucket int, words string, counts string"  # both lists with spaces between


@dataclass
class Known:
    """What a level needs of the one before: a filter of its extensions and the hot ones among them."""

    bits: np.ndarray
    hot: np.ndarray

    def holds(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        for slot in slots(key, len(self.bits) * 64):
            out &= (self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        return out


def slots(key: np.ndarray, bits: int) -> list[np.ndarray]:
    return [key & np.uint64(bits - 1), (key >> np.uint64(32)) & np.uint64(bits - 1)]


# ---- blocks of text --------------------------------------------------------------------------------------------


def short_enough(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``c.PIECE`` bytes; longer texts cut at ends of pieces."""
    for part in c.pieces(batch):
        if part.num_rows > 1 or int(c.lengths(part.column("text")).sum()) <= most:
            yield part
            continue
        data, _ = c.buffer(part.column("text"))
        ends = np.flatnonzero(END[data]) + 1
        start = 0
        while start < len(data):
            at = np.searchsorted(ends, start + most)
            stop = int(ends[at]) if at < len(ends) else len(data)
            text = pa.array([data[start:stop].tobytes()], pa.large_binary()).view(pa.large_string())
            yield pa.RecordBatch.from_arrays([text, part.column("lang")], names=["text", "lang"])
            start = stop


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts and languages of about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        for part in short_enough(batch, most):
            held.append(part)
            size += int(c.lengths(part.column("text")).sum())
            if size >= most:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    texts, langs = (pa.concat_arrays([p.column(n).cast(pa.large_string()) for p in parts]) for n in ("text", "lang"))
    return texts, langs


def text_hash(texts: pa.Array) -> np.ndarray:
    data, at = c.buffer(texts)
    return c.span_hash(c.prefix_hash(data), at[:-1], at[1:])


class Block:
    """The words of a block as numbers: ``word`` and ``lang`` of each position, and where a piece starts."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, at = c.buffer(texts)
        data = c.FOLD[data]
        start, stop, first = c.words(data, at, INSIDE)
        ended = np.r_[0, np.cumsum(END[data])]
        self.fresh = np.ones(len(start) + 1, bool)
        self.fresh[1:-1] = ended[start[1:]] > ended[stop[:-1]]
        self.fresh[first] = True
        letters = data[c.expand(start, stop - start)]
        offsets = np.r_[0, np.cumsum(stop - start)]
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
        names = langs.dictionary_encode()
        self.words, self.names = words.dictionary, names.dictionary
        self.word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = np.repeat(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(first))
        self.word_hash, self.lang_hash = text_hash(self.words), text_hash(self.names)

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a phrase of ``size`` words starts, and its identifier there."""
        at = np.arange(len(self.word))
        key = c.pair(self.lang_hash[self.lang], self.word_hash[self.word])
        for k in range(1, size):
            go = ~self.fresh[at + k]
            at, key = at[go], key[go]
            key = c.pair(key, self.word_hash[self.word[at + k]])
        return at, key


def stripes_of(block: Block, size: int, known: Known | None):
    """The stripes of all prefixes of ``size - 1`` words of a block."""
    many = len(block.words)
    if known is None:
        at, following = np.arange(len(block.word)), block.word
        prefix, hot = block.lang, np.ones(len(at), bool)
    else:
        at, key = block.hashes(size - 1)
        alive = known.holds(key)
        at, key = at[alive], key[alive]
        goes_on = np.zeros(len(block.word) + 1, bool)
        goes_on[at] = True
        goes_on = goes_on[at + 1] & ~block.fresh[at + size - 1]
        following = np.full(len(at), many)
        following[goes_on] = block.word[at[goes_on] + size - 1]
        hot = np.isin(key, known.hot)
        prefix = block.lang[at]
        for k in range(size - 1):
            prefix = np.unique(prefix * many + block.word[at + k], return_inverse=True)[1]
    bucket = np.zeros(len(at), np.int64)
    split = hot & (following < many)
    bucket[split] = (block.word_hash[following[split]] % np.uint64(BUCKETS)).astype(np.int64)
    stripe = prefix * BUCKETS + bucket
    if len(stripe) and int(stripe.max()) >= (1 << 62) // (many + 1):
        stripe = np.unique(stripe, return_inverse=True)[1]
    entry, where, count = np.unique(stripe * (many + 1) + following, return_index=True, return_counts=True)
    heads = np.flatnonzero(np.diff(entry // (many + 1), prepend=-1))
    one, nexts = at[where[heads]], following[where]
    del at, following, stripe, entry
    texts = [block.words.take(pa.array(block.word[one + k])) for k in range(size - 1)]
    nexts = pa.array(nexts, mask=nexts == many)
    return {
        "lang": block.names.take(pa.array(block.lang[one])),
        "prefix": pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string())) if texts else pa.array([""] * len(one), pa.large_string()),
        "bucket": bucket[where[heads]],
        "words": listed(heads, block.words.take(nexts).fill_null(ELSE)),
        "counts": listed(heads, pa.array(count)),
    }


def listed(heads: np.ndarray, values: pa.Array) -> pa.Array:
    lists = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(values)], pa.int32()), values.cast(pa.string()))
    return pc.binary_join(lists, " ")


def partial(docs: DataFrame, size: int, known, most: int) -> DataFrame:
    """The stripes of each block of about ``most`` bytes; ``docs`` has lang and text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(STRIPE))

    def run(batches):
        for texts, langs in blocks(batches, most):
            block = Block(texts, langs)
            if len(block.word):
                columns = stripes_of(block, size, known.value if known else None)
                yield pa.RecordBatch.from_arrays([c.as_arrow(columns[f.name], f.type) for f in arrow], schema=arrow)

    return docs.mapInArrow(run, STRIPE)


# ---- merged stripes --------------------------------------------------------------------------------------------


def merged(parts: DataFrame, least: int) -> DataFrame:
    """Stripes of a key added up elementwise: total, frequent entries and the largest of them."""
    key = ["lang", "prefix", "bucket"]
    entries = F.arrays_zip(F.split("words", " ").alias("words"), F.split("counts", " ").alias("counts"))
    entries = parts.repartition(*key).select(*key, F.inline(entries)).groupBy(*key, "words").agg(F.sum(F.col("counts").cast("long")).alias("n"))
    frequent = (F.col("words") != ELSE) & (F.col("n") >= least)
    return entries.groupBy(*key).agg(
        F.sum("n").alias("total"),
        F.max(F.when(frequent, F.col("n"))).alias("top"),
        F.collect_list(F.when(frequent, F.struct(F.col("words").alias("word"), "n"))).alias("kept"),
    )


def extensions(stripes: DataFrame) -> DataFrame:
    phrase = F.when(F.col("prefix") == "", F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word"))
    return stripes.select("lang", "prefix", F.inline("kept")).select("lang", "prefix", phrase.alias("phrase"), F.col("n").alias("a"))


def phrase_hash(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The identifiers of :meth:`Block.hashes` for phrases of equally many words."""
    data, at = c.buffer(phrases)
    start, stop, first = c.words(data, at, INSIDE)
    letters = c.span_hash(c.prefix_hash(data), start, stop)
    size = len(start) // max(1, len(phrases))
    key = text_hash(langs)
    for k in range(size):
        key = c.pair(key, letters[first[:-1] + k])
    return key


def known_of(spark: SparkSession, found: DataFrame, many: int, words: int) -> Known:
    """Filter and hot list of a level's ``many`` extensions, put together in Spark."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, many * BITS_EACH):
        bits *= 2

    def fill(batch: pa.RecordBatch):
        key = phrase_hash(batch.column("lang"), batch.column("phrase"))
        slot = np.concatenate(slots(key, bits))
        order = np.argsort(slot)
        place = slot[order] >> np.uint64(6)
        heads = np.flatnonzero(np.diff(place, prepend=place[0] + np.uint64(1)))
        mask = np.bitwise_or.reduceat(np.uint64(1) << (slot[order] & np.uint64(63)), heads)
        yield {"place": place[heads], "mask": mask}

    def name(batch: pa.RecordBatch):
        yield {"key": phrase_hash(batch.column("lang"), batch.column("phrase"))}

    rows = c.map_batches(found.select("lang", "phrase"), fill, "place long, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask"))
    rows = rows.toPandas()  # at most MOST_BITS / 64
    out = np.zeros(bits // 64, np.uint64)
    out[rows["place"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    hot = c.map_batches(found.where(F.col("a") >= words * HOT).select("lang", "phrase"), name, "key long").collect()  # at most 1 / HOT
    return Known(out, np.array([r["key"] for r in hot], np.int64).view(np.uint64))


def mine_stripes(spark: SparkSession, docs: DataFrame, longest: int, least: int) -> list[DataFrame]:
    """The merged stripes of each level, written once; a level without extensions is the last."""
    docs = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    levels: list[DataFrame] = []
    known, words = None, 0
    for size in range(1, longest + 1):
        levels.append(durable(spark, merged(partial(docs, size, known, BLOCK), least), "stripes"))
        many, total = levels[-1].agg(F.coalesce(F.sum(F.size("kept")), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
        words = words or total
        if many == 0 or size == longest:
            break
        known = spark.sparkContext.broadcast(known_of(spark, extensions(levels[-1]), many, words))
    return levels


# ---- phrases ---------------------------------------------------------------------------------------------------


def quotient(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) for positive longs with products of up to 38 digits."""
    wide = lambda x: x.cast("decimal(38,0)")
    top, below = wide(wide(a) * 1000) * wide(n), wide(left) * wide(right)
    return F.call_function("div", wide(top), wide(below)).cast("long")


def collocations(
    spark: SparkSession, docs: DataFrame, most: int = 2_000, longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT
) -> DataFrame:
    """Each language's ``most`` best phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase scores by its weakest cut. One that lies inside a longer frequent phrase with ``percent`` of its count is
    left out; as counts fall with length, longer ones by one word tell.
    """
    levels = mine_stripes(spark, docs, longest, least)
    words = levels[0].groupBy("lang").agg(F.sum("total").alias("n"))
    if len(levels) < 2:
        levels.append(levels[0].limit(0))
    sized = [extensions(s).withColumn("size", F.lit(k)) for k, s in enumerate(levels[1:], 2)]
    stripes = levels[1]
    for more in levels[2:]:
        stripes = stripes.unionByName(more)
    found = sized[0]
    for more in sized[1:]:
        found = found.unionByName(more)
    totals = stripes.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("total").alias("f"), F.max("top").alias("longer_right"))
    part = F.split("phrase", " ")
    rest = F.array_join(F.slice(part, 2, longest), " ")
    left = found.groupBy("lang", rest.alias("phrase")).agg(F.max("a").alias("longer_left"))
    cut = found.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumns({"head": F.array_join(F.slice(part, F.lit(1), F.col("k")), " "), "tail": F.array_join(F.slice(part, F.col("k") + 1, F.col("size")), " ")})
    cut = cut.join(totals.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cut = cut.join(totals.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cut = cut.join(F.broadcast(words), "lang")  # a row per language
    best = cut.groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct(quotient(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    )
    best = best.join(totals.drop("f"), ["lang", "phrase"], "left").join(left, ["lang", "phrase"], "left")
    longer = F.greatest(F.coalesce("longer_left", F.lit(0)), F.coalesce("longer_right", F.lit(0)))
    alone = best.where(100 * longer < percent * F.col("a")).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
