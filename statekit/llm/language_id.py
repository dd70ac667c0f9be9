"""Language identification by bit-sliced Bloom filters over byte n-grams.

A slot of the filter is a mask with one bit per language, and the AND of an n-gram's slots is the mask of all
languages that (probably) contain it. A mask has 62 bits; further languages go to further masks. A document's languages are ranked by how many of its
n-grams have their bit, corrected for the share of false positives that the filling of each slice implies.

An n-gram enters a language only if it is not much rarer there than in the language that uses it most, so that
quotations and mixed pages in the learning rows do not wash the filters out. Learning takes a bounded sample
(``PER_LANGUAGE`` rows per language in expectation, picked by a hash of the id); scoring takes every document.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.llm import common as c

GRAM = 4
PER_LANGUAGE = 2_000
SLOTS, HASHES = 1 << 18, 2
RARER = 0.2
BITS = 62  # languages of one mask
UNKNOWN = "und"

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Filter:
    languages: list[str]  # by falling number of rows, then by name
    masks: np.ndarray  # a row of slots for every BITS languages
    false_rate: np.ndarray


def grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of every text, and where each text's n-grams start (and the last one's end).

    Letters are folded to lower case, everything else is one space, also before and after the text.
    """
    data, at = c.buffer(batch.column("text"))
    n = len(at) - 1
    framed = np.full(len(data) + 2 * n, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(at))
    framed[place] = np.where(LETTER[data], c.FOLD[data], 32)
    high = framed[1:]
    high[(framed[:-1] == 0xC3) & (high >= 0x80) & (high <= 0x9E) & (high != 0x97)] += 0x20
    bounds = at + 2 * np.arange(n + 1)
    space = framed == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[bounds[:-1]] = True
    at = np.r_[0, np.cumsum(keep)][bounds]
    text = framed[keep].astype(np.uint64)
    if len(text) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    key = np.zeros(len(text) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        key = (key << np.uint64(8)) | text[k : k + len(key)]
    count = np.maximum(0, np.diff(at) - GRAM + 1)
    return c.mix(key)[c.expand(at[:-1], count)], np.r_[0, np.cumsum(count)]


def count_grams(batch: pa.RecordBatch):
    key, at = grams(batch)
    names = np.array(batch.column("lang").to_pylist(), object)
    for name in np.unique(names.astype(str)):
        mine = np.flatnonzero(names == name)
        gram, n = np.unique(key[c.expand(at[mine], at[mine + 1] - at[mine])], return_counts=True)
        yield {"lang": [name] * len(gram), "gram": gram, "n": n}


def slot(gram, k: int):
    """The k-th slot of an n-gram."""
    return (gram >> np.uint64(18 * k)) & np.uint64(SLOTS - 1)


def learn(spark: SparkSession, docs: DataFrame, per_language: int = PER_LANGUAGE) -> Filter:
    """A filter for all languages of the rows with text and lang."""
    c.bounded(spark)
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row per language
    languages = [r["lang"] for r in found]
    if not languages:
        return Filter([], np.zeros((0, SLOTS), np.int64), np.zeros(0))
    share = spark.createDataFrame([(r["lang"], k, per_language / r["count"]) for k, r in enumerate(found)], "lang string, k int, share double")
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.join(F.broadcast(share), "lang").where(lot < F.col("share")).select("text", "lang")
    counts = c.map_batches(sample, count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # a row per language
    rated = counts.where("n > 1").join(F.broadcast(totals), "lang").join(F.broadcast(share), "lang")
    rated = rated.select("gram", "k", (F.col("n") / F.col("total")).alias("rate"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = rated.join(best, "gram").where(F.col("rate") >= RARER * F.col("best"))
    masks = kept.groupBy("gram", F.expr(f"k div {BITS}").alias("part")).agg(F.bit_or(F.expr(f"shiftleft(1L, k % {BITS})")).alias("mask"))
    slots = F.explode(F.array(*[F.shiftrightunsigned("gram", 18 * k).bitwiseAND(F.lit(SLOTS - 1)) for k in range(HASHES)]))
    filled = masks.select("part", slots.alias("slot"), "mask").groupBy("part", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()  # at most SLOTS rows a part
    out = np.zeros((-(-len(languages) // BITS), SLOTS), np.int64)
    out[filled["part"].to_numpy(np.int64), filled["slot"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64)
    fill = np.array([((out[k // BITS] >> k % BITS) & 1).mean() for k in range(len(languages))])
    return Filter(languages, out, fill**HASHES)


def has_letter(text: str | None) -> bool:
    return text is not None and any(x.isalpha() for x in text)


def decide(shared):
    def run(batch: pa.RecordBatch):
        model: Filter = shared.value
        key, at = grams(batch)
        slots = [slot(key, k).astype(np.int64) for k in range(HASHES)]
        total = np.diff(at)
        n = batch.num_rows
        share = np.zeros((max(1, len(model.languages)), n))
        for k in range(len(model.languages)):
            if k % BITS == 0:
                mask = np.bitwise_and.reduce([model.masks[k // BITS][x] for x in slots])
            hits = np.r_[0, np.cumsum((mask >> k % BITS) & 1)]
            hits = hits[at[1:]] - hits[at[:-1]]
            false = model.false_rate[k]
            share[k] = np.clip((hits - false * total) / np.maximum(1, total) / max(1e-9, 1 - false), 0, 1)
        best = share.argmax(axis=0)
        first = share.max(axis=0)
        others = share.copy()
        others[best, np.arange(n)] = 0
        score = np.where(first > 0, first / np.maximum(1e-12, first + others.max(axis=0)), 0.0) * np.minimum(1, first * 2)
        data, where = c.buffer(batch.column("text"))
        ascii_ = np.r_[0, np.cumsum(LETTER[data] & (data < 128))]
        sure = ascii_[where[1:]] > ascii_[where[:-1]]
        known = [bool(model.languages) and (sure[k] or has_letter(batch.column("text")[k].as_py())) for k in range(n)]
        yield {
            "doc_id": batch.column("doc_id"),
            "lang_pred": [model.languages[best[k]] if known[k] else UNKNOWN for k in range(n)],
            "score": np.where(known, score, 0.0),
        }

    return run


def identify(spark: SparkSession, docs: DataFrame, model: Filter) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.

    ``und`` with score 0 if the text is null, has no letter, or nothing was learned. A text too short or
    too strange for any n-gram gets the most frequent language with score 0; so do ties go to the more
    frequent language. Other columns are ignored, repeated rows stay repeated.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return c.map_batches(rows, decide(spark.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")


def keep_known(spark: SparkSession, docs: DataFrame, model: Filter) -> DataFrame:
    """The rows of docs, with their columns, whose text has a known language."""
    c.bounded(spark)
    shared = spark.sparkContext.broadcast(model)

    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = c.pieces(pa.RecordBatch.from_pydict({"doc_id": np.zeros(len(texts), np.int64), "text": pa.array(texts.fillna(""), pa.string())}))
            yield pd.Series([x != UNKNOWN for part in parts if part.num_rows for out in decide(shared)(part) for x in out["lang_pred"]], dtype=bool)
            c.release()

    return docs.where(F.pandas_udf(known, "boolean")("text"))
