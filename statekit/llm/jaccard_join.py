"""Jaccard join over word n-grams as a blocked sparse product of the document by n-gram matrix.

The columns (n-grams) are dealt into blocks, and the part of a document's row inside a block is a
*block row*. A pair within the similarity differs in at most D n-grams, D derived from the sizes, so with
D + E blocks at least E of its block rows are equal (E is a quarter of D, two at least); documents that share fewer
with all others together are out at once. Only equal block rows are multiplied:

* Equal rows of the whole matrix are one row (exact copies cost nothing).
* Block rows shared by few documents are multiplied pair by pair; the sizes of equal block rows add up to a
  first part of the overlap, which is enough to accept most pairs.
* Documents in widely shared block rows (large groups of near copies) are multiplied by single n-grams
  instead, rarest first, and only over as many columns as the size bound needs. Columns that are still
  shared by many are multiplied with one central row; afterwards only rows in different components
  are compared, and only if the n-grams that no other row has leave room for the similarity.
* Whatever the accumulated counts don't decide is counted over the two whole rows.

Nothing is capped: every pair that the bounds leave is decided, or both sides are already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.llm import common as c
from statekit.llm.links import components
from statekit.session import durable

FEW = 32
BLOCK = 200_000
LEAST_PARTS, PART_BYTES = 64, 8 << 20


def shingle_sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; a shorter text is one n-gram as a whole."""
    data, at = c.buffer(batch.column("text"))
    data = c.FOLD[data]
    start, stop, first = c.words(data, at, c.NOT_SPACE)
    word = c.span_hash(c.prefix_hash(data), start, stop)
    gram = word
    for k in range(1, width):
        gram = c.pair(gram[:-1], word[k:]) if len(gram) else gram
    out = []
    for k in range(batch.num_rows):
        lo, hi = first[k], first[k + 1]
        if hi - lo >= width:
            out.append(np.unique(gram[lo : hi - width + 1]))
        elif hi > lo:
            whole = word[lo : lo + 1]
            for x in range(lo + 1, hi):
                whole = c.pair(whole, word[x : x + 1])
            out.append(c.mix(whole + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def levels(percent: int, most: int = 1 << 31) -> tuple[np.ndarray, ...]:
    """Size classes: smallest size of each, largest partner of its sizes, number of blocks (0: none needed),
    and how many of them are equal at least."""
    low = [1]
    while low[-1] < most:
        low.append(max(low[-1] + 1, low[-1] * 100 // percent + 1, low[-1] * 4 // 3))
    low = np.array(low, np.int64)
    high = low[1:] - 1
    partner = high * 100 // percent
    differ = (high + partner) * (100 - percent) // (100 + percent)
    equal = np.maximum(2, -(-differ // 4))
    return low, partner, np.where(differ > 0, differ + equal, 0), equal


def profile(width: int):
    def run(batch: pa.RecordBatch):
        sets = shingle_sets(batch, width)
        with np.errstate(over="ignore"):
            yield {
                "doc_id": c.ids(batch),
                "n": np.array([len(s) for s in sets], np.int64),
                "s1": np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64),
                "s2": np.array([c.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64),
            }

    return run


def block_rows(width: int, percent: int):
    low, partner, blocks, equal = levels(percent)

    def run(batch: pa.RecordBatch):
        sigs, docs, sizes, needs = [], [], [], []
        ids = c.ids(batch)
        for k, s in enumerate(shingle_sets(batch, width)):
            if not len(s):
                continue
            own = int(np.searchsorted(low, len(s), "right")) - 1
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c.mix(s), dtype=np.uint64)])
            top = s >> np.uint64(32)
            for level in (own - 1, own):
                if level < 0 or not blocks[level] or len(s) > partner[level]:
                    continue
                n = int(blocks[level])
                edge = np.searchsorted((top * np.uint64(n)) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
                size = np.diff(edge)
                name = c.mix(np.arange(n, dtype=np.uint64) + np.uint64((level + 1) << 32))
                sig = c.mix((sums[edge[1:]] - sums[edge[:-1]]) ^ name)
                empty = int((size == 0).sum())
                if empty < equal[level]:  # then a pair also shares blocks that are not empty
                    sig, size = sig[size > 0], size[size > 0]
                needs.append(np.full(len(sig), max(1, int(equal[level]) - empty)))
                sigs.append(sig)
                docs.append(np.full(len(sig), ids[k]))
                sizes.append(size if level == own else -1 - size)  # below zero: met by smaller ones only
        if sigs:
            yield {"sig": np.concatenate(sigs), "doc_id": np.concatenate(docs), "size": np.concatenate(sizes), "need": np.concatenate(needs)}

    return run


def met_rows(texts: DataFrame, width: int, percent: int, parts: int, block: int) -> DataFrame:
    """The block rows (sig, doc_id, size, need) that two documents or more have.

    Each travels once, packed with the others of its block of text to the part that its signature names; one that only a
    single document has ends there. A signature keeps 56 bits.
    """
    schema = pa.schema([("part", pa.int32()), ("blob", pa.binary())])
    found = block_rows(width, percent)

    def flush(held) -> Iterator[pa.RecordBatch]:
        sig, doc, size, need = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        part = (sig % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((sig, part))
        bounds = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
        out = {"part": [], "blob": []}
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            at = order[lo:hi]
            out["part"].append(int(part[at[0]]))
            out["blob"].append(c.packed([sig[at], doc[at].view(np.uint64), ((size[at] << 1) ^ (size[at] >> 63)).view(np.uint64), need[at].view(np.uint64)]))
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    def send(batches):
        held, rows = [], 0
        for batch in batches:
            for piece in c.pieces(batch):
                for x in found(piece):
                    held.append([x["sig"] >> np.uint64(8), x["doc_id"].astype(np.int64), x["size"].astype(np.int64), x["need"].astype(np.int64)])
                    rows += len(x["sig"])
                    if rows >= block:
                        yield from flush(held)
                        rows = 0
        if rows:
            yield from flush(held)
        c.release()

    def settle(held) -> pa.RecordBatch:
        sig, doc, size, need = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(sig, kind="stable")
        sig, doc, size, need = sig[order], doc[order].view(np.int64), size[order], need[order]
        heads = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        many = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
        kept = np.repeat(many, np.diff(np.r_[heads, len(sig)]))
        size = (size >> np.uint64(1)).astype(np.int64) ^ -(size & np.uint64(1)).astype(np.int64)
        columns = [sig.view(np.int64)[kept], doc[kept], size[kept].astype(np.int32), need[kept].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["sig", "doc_id", "size", "need"])

    def meet(batches):
        part, held = None, []
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if p != part and held:
                    yield settle(held)
                part = p
                held.append(c.unpacked(blob, 4))
        if held:
            yield settle(held)
        c.release()

    sent = texts.mapInArrow(send, "part int, blob binary").repartition(parts, "part").sortWithinPartitions("part")
    return sent.mapInArrow(meet, "sig long, doc_id long, size int, need int")


def single_grams(width: int):
    def run(batch: pa.RecordBatch):
        sets = shingle_sets(batch, width)
        size = np.array([len(s) for s in sets], np.int64)
        yield {"doc_id": np.repeat(c.ids(batch), size), "gram": np.concatenate(sets), "n": np.repeat(size, size)}

    return run


def overlaps(width: int):
    def run(batch: pa.RecordBatch):
        sets = shingle_sets(batch, width)
        other = shingle_sets(batch.select(["other"]).rename_columns(["text"]), width)
        same = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sets, other, strict=True)]
        yield {"a": batch.column("a"), "b": batch.column("b"), "na": [len(x) for x in sets], "nb": [len(x) for x in other], "same": same}

    return run


def enough(same: Column | str, percent: int) -> Column:
    """Whether so many common n-grams reach the similarity: same / (na + nb - same) >= percent / 100."""
    same = F.col(same) if isinstance(same, str) else same
    return same * (100 + percent) >= percent * (F.col("na") + F.col("nb"))


def pairs_of(rows: DataFrame, key: str, percent: int, also: Column | None = None) -> DataFrame:
    """Pairs a < b of rows (key, doc_id, n, ...) that share a key and have sizes that allow the similarity."""
    left = rows.select(key, *[F.col(x).alias(f"{x}_a") for x in rows.columns if x != key])
    right = rows.select(key, *[F.col(x).alias(f"{x}_b") for x in rows.columns if x != key])
    near = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    both = left.join(right, key).where((F.col("doc_id_a") < F.col("doc_id_b")) & near & (F.lit(True) if also is None else also))
    return both.withColumnsRenamed({"doc_id_a": "a", "doc_id_b": "b", "n_a": "na", "n_b": "nb"})


def decide(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among the pairs (a, b), counted over the whole rows of both."""
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), "text"), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("other")), "b")
    counted = c.map_batches(two.select("a", "b", "text", "other"), c.lean(overlaps(width)), "a long, b long, na long, nb long, same long")
    return counted.where(enough("same", percent)).select("a", "b")


def jaccard_components(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_copies (documents with the same set).

    Null and empty texts have no n-grams and are linked with nothing. Ties cannot occur: the smallest id names
    a component. For null ids, repeated rows and ids see ``common.one_each``; other columns are ignored.
    """
    c.bounded(spark)
    texts, names = c.one_each(spark, docs)
    sizes = durable(spark, c.map_batches(texts, c.lean(profile(width)), "doc_id long, n long, s1 long, s2 long"), "jaccard-sizes")
    filled = sizes.where("n > 0")
    same = filled.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    rows = durable(spark, filled.join(same, ["n", "s1", "s2"]).select("doc_id", "n", "rep", "n_copies"), "jaccard-rows")
    reps = rows.where("doc_id = rep").select("doc_id", "n")

    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    met = met_rows(texts, width, percent, max(LEAST_PARTS, size // PART_BYTES), BLOCK)
    shared = durable(spark, met.join(reps, "doc_id"), "jaccard-blocks")
    # A document that shares fewer block rows than any pair within the similarity must is out.
    met = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("sig")
    met = shared.join(met, "sig").withColumn("lower", F.col("size") < 0)
    able = met.groupBy("doc_id", "lower").agg(F.count(F.lit(1)).alias("has"), F.max("need").alias("least")).where("has >= least")
    shared = durable(spark, met.join(able.select("doc_id", "lower"), ["doc_id", "lower"]).drop("lower", "need"), "jaccard-able")
    held = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    many = shared.join(held.where(f"held > {FEW}").select("sig"), "sig").select("doc_id").distinct()
    many = durable(spark, many, "jaccard-many")
    few = shared.join(held.where(f"held <= {FEW}").select("sig"), "sig")
    few = few.join(many.withColumn("wide", F.lit(True)), "doc_id", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    once = (F.col("size_a") >= 0) | (F.col("size_b") >= 0)  # a pair counts in the class of its smaller side
    once = once & ~(F.col("wide_a") & F.col("wide_b"))  # two of those meet in their single n-grams
    pairs = pairs_of(few, "sig", percent, once).groupBy("a", "b", "na", "nb").agg(F.sum(F.greatest("size_a", "size_b")).alias("same"))
    pairs = durable(spark, pairs.withColumn("sure", enough("same", percent)), "jaccard-pairs")
    columns = durable(spark, rare_columns(spark, texts, many, width, percent), "jaccard-columns")
    wide = columns.groupBy("gram").agg(F.count(F.lit(1)).alias("held"), F.max(F.struct("shared_by", "doc_id", "n")).alias("centre")).where("held > 1")
    narrow = pairs_of(columns.join(wide.where(f"held <= {FEW}").select("gram"), "gram"), "gram", percent, unshared_bound(percent))
    wide = wide.where(f"held > {FEW}")
    stars = columns.join(wide.select("gram", "centre"), "gram").where("doc_id != centre.doc_id")
    stars = stars.select(F.least("doc_id", "centre.doc_id").alias("a"), F.greatest("doc_id", "centre.doc_id").alias("b"), F.col("n").alias("na"), F.col("centre.n").alias("nb"))
    stars = stars.where(f"na * 100 >= nb * {percent} AND nb * 100 >= na * {percent}")
    open_ = pairs.where("NOT sure").select("a", "b").unionByName(narrow.select("a", "b")).unionByName(stars.select("a", "b")).distinct()
    links = pairs.where("sure").select("a", "b").unionByName(decide(open_, texts, width, percent))
    links = durable(spark, links, "jaccard-links")
    labels = components(spark, links)

    rest = columns.join(wide.select("gram"), "gram").join(labels, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    mixed = rest.groupBy("gram").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo != hi").select("gram")
    apart = unshared_bound(percent) & (F.col("component_id_a") != F.col("component_id_b"))
    cross = durable(spark, pairs_of(rest.join(mixed, "gram"), "gram", percent, apart).select("a", "b").distinct(), "jaccard-cross")
    if cross.limit(1).collect():
        labels = components(spark, links.unionByName(decide(cross, texts, width, percent)))

    found = rows.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left")
    found = found.select("doc_id", F.coalesce("component_id", "rep").alias("component_id"), "n_copies")
    out = sizes.join(found, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")
    )
    return c.shown(out, names, "doc_id", "component_id")


def unshared_bound(percent: int) -> Column:
    """What two rows can have in common at most must reach the similarity.

    N-grams that no other row has can't be common, and if the pair meets in this column first, nothing
    before it in the order by rarity is: a pair that is within the similarity passes in the first column it meets in.
    """
    alone = F.least(F.col("n_a") - F.col("alone_a"), F.col("n_b") - F.col("alone_b"))
    after = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return F.least(alone, after) * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))


def rare_columns(spark: SparkSession, texts: DataFrame, many: DataFrame, width: int, percent: int) -> DataFrame:
    """The rarest n-grams of the given documents, as many as a pair within the similarity must meet in."""
    grams = c.map_batches(texts.join(many, "doc_id"), c.lean(single_grams(width)), "doc_id long, gram long, n long")
    grams = durable(spark, grams, "jaccard-grams")
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = grams.join(counts, "gram").groupBy("doc_id", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"),
        F.sum(F.when(F.col("df") == 1, 1).otherwise(0)).alias("alone"),
        F.sum("df").alias("shared_by"),
    )
    prefix = F.expr(f"int(n - ((n * {percent} + 99) div 100) + 1)")
    ranked = ranked.where(f"(n - alone) * 100 >= n * {percent}")
    columns = ranked.select("doc_id", "n", "alone", "shared_by", F.posexplode(F.slice("grams", F.lit(1), prefix)).alias("at", "g"))
    return columns.where("g.df > 1").select("g.gram", "doc_id", "n", "alone", "shared_by", "at")
