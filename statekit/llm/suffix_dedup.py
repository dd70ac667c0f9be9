"""Exact removal of repeated 100-byte strings with a sparse suffix array built by bucket refinement.

Every suffix that can share 100 bytes with another one is reached from an *anchor*: in each window of
100 bytes, the leftmost 25-gram with the smallest hash. Equal windows choose the same anchor at the same
place, so only anchors (about one byte in forty) are shuffled, each for the run of windows that chose it.

Bucket refinement, coarse to fine; a bucket with one member is left out of all later rounds:

1. *q-gram buckets*: anchors by the identifier of their 25-gram.
2. *span buckets*: the identifier of a longer string is made from the identifiers of its q-grams at later
   offsets, id50(p) = (id25(p), id25(p+25)), id100(p) = (id50(p), id50(p+50)), each result being used
   again by the next. A span (all windows of an anchor) is (id100(first), id100(last)).
3. *part buckets*: only where one q-gram bucket has fallen apart into several span buckets, the first member of
   each is refined again: in parts of up to 19 windows, first by the 82 bytes that they have in common.
4. *window buckets*: the same once more for the first members of parts that differ, by their single windows.

A bucket's pointer is its earliest member; every other member is removed. Each round sends its members once, to the
*part* that a hash of the q-gram bucket names, where they are sorted by the identifiers of bucket, span and position. Only
the order within a bucket is needed, so identifiers are hashes instead of ranks (64 bits of span within 64 bits of
q-gram) and refinement stops at depth 100. A task has sorted its own block of members before: of a span bucket only the
block's earliest member travels on, so a passage that half of the corpus holds is one member a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.llm import common as c
from statekit.session import durable

DEPTH, GRAM = 100, 25
PART = 19
PART_COMMON = DEPTH - PART + 1
REACH = DEPTH - GRAM
BLOCK = 1 << 20
MEMBERS = 300_000
LEAST_PARTS, PART_BYTES = 64, 16 << 20
PLACE = np.uint64((1 << 24) - 1)


def placed(first, size, ahead):
    """A run of windows as one number: where it starts, how many, and how far its anchor is from there."""
    return (first << 14) | (size << 7) | ahead


def unplaced(place: np.ndarray):
    return place >> 14, (place >> 7) & 127, place & 127


def identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """id25 and id100 of every position of a block that has room for them."""
    sums = c.prefix_hash(data)
    n = len(data) - GRAM + 1
    _, down = c.powers(len(sums))
    id25 = c.mix((sums[GRAM:] - sums[:-GRAM]) * down[:n])
    id50 = c.pair(id25[:-GRAM], id25[GRAM:])
    return id25, c.pair(id50[: n - REACH], id50[2 * GRAM :][: n - REACH])


def anchors(id25: np.ndarray, windows: int) -> np.ndarray:
    """Of each window, the position of the leftmost smallest 25-gram."""
    key = (id25 & ~PLACE) | np.arange(len(id25), dtype=np.uint64)
    width = 1
    while width * 2 <= REACH + 1:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = REACH + 1 - width
    low = np.minimum(key[:windows], key[rest : rest + windows])
    return (low & PLACE).astype(np.int64)


def spans(data: np.ndarray, at: np.ndarray):
    """(text, place, q-gram bucket, span bucket) of each anchor of several texts that lie one after the other."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found = []
    for start in range(0, max(0, len(data) - DEPTH + 1), BLOCK):
        block = data[start : start + BLOCK + DEPTH - 1]
        id25, id100 = identifiers(block)
        anchor = anchors(id25, len(id100))
        mine = owner[start : start + len(id100)]
        whole = mine == owner[start + DEPTH - 1 : start + DEPTH - 1 + len(id100)]  # a window lies in one text
        head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (mine[1:] != mine[:-1]) | (whole[1:] != whole[:-1])])
        size = np.diff(np.r_[head, len(id100)])
        head, size = head[whole[head]], size[whole[head]]
        ahead = anchor[head] - head
        span = c.pair(id100[head], id100[head + size - 1]) + c.mix((ahead * 128 + size).astype(np.uint64))
        found.append((mine[head], placed(head + start - at[mine[head]], size, ahead), id25[anchor[head]], span))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else None


def find_anchors(batch: pa.RecordBatch):
    data, at = c.buffer(batch.column("text"))
    if (got := spans(data, at)) is not None:
        yield {"doc_id": c.ids(batch)[got[0]], "place": got[1], "gram": got[2], "span": got[3]}


def runs_of(batch: pa.RecordBatch):
    """The runs that the documents bring: ids, start of their text in the bytes, place and bucket; and the hashes."""
    data, at = c.buffer(batch.column("text"))
    lists = batch.column("runs")
    flat, ends = lists.flatten(), np.diff(lists.offsets.to_numpy())
    place, gram = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("place", "gram"))
    doc = np.repeat(np.arange(batch.num_rows), ends)
    return c.ids(batch)[doc], at[doc], place, gram, c.prefix_hash(data)


def find_parts(batch: pa.RecordBatch):
    """Runs cut by the distance to the anchor; all windows of a part have PART_COMMON bytes in common."""
    ids, text, place, gram, sums = runs_of(batch)
    first, size, ahead = unplaced(place)
    for part in range(0, REACH + 1, PART):
        far = np.minimum(ahead, part + PART - 1)  # the distance falls from window to window
        near = np.maximum(ahead - size + 1, part)
        some = far >= near
        doc, start, anchor, far, near = ids[some], text[some], (first + ahead)[some], far[some], near[some]
        common = c.span_hash(sums, start + anchor - part, start + anchor - part + PART_COMMON)
        one, last = (c.span_hash(sums, start + anchor - x, start + anchor - x + DEPTH) for x in (far, near))
        span = c.pair(one, last) + c.mix((far * 128 + near).astype(np.uint64))
        yield {"doc_id": doc, "place": placed(anchor - far, far - near + 1, far), "gram": c.pair(gram[some].view(np.uint64), common), "span": span}


def find_windows(batch: pa.RecordBatch):
    """The single windows of the runs that the documents bring."""
    ids, text, place, gram, sums = runs_of(batch)
    first, size, _ = unplaced(place)
    window = c.expand(text + first, size)
    own = c.span_hash(sums, window, window + DEPTH)
    yield {"doc_id": np.repeat(ids, size), "place": placed(window - np.repeat(text, size), 1, 0), "gram": np.repeat(gram, size), "span": own}


def unpack(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with its packed texts as bytes."""
    press = zstandard.ZstdDecompressor()
    texts = pa.array([press.decompress(x) for x in batch.column("packed").to_pylist()], pa.binary())
    rest = {n: batch.column(n) for n in batch.schema.names if n != "packed"}
    return pa.RecordBatch.from_pydict(rest | {"text": texts})


def unpacked(fn):
    def run(batch: pa.RecordBatch):
        for packed in c.pieces(batch, "packed"):
            for part in c.pieces(unpack(packed)):
                yield from fn(part)

    return run


def in_pieces(fn):
    def run(batch: pa.RecordBatch):
        for part in c.pieces(batch):
            yield from fn(part)

    return run


def pack_texts(batch: pa.RecordBatch):
    press = zstandard.ZstdCompressor(level=1)
    yield {"doc_id": batch.column("doc_id"), "packed": [press.compress(x.encode()) for x in batch.column("text").to_pylist()]}


def pointers(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Members (gram, span, doc_id, place) sorted by bucket and position; which are pointers, and which stand in a q-gram
    bucket of several span buckets."""
    order = np.lexsort(columns[::-1])
    gram, span, doc, place = (x[order] for x in columns)
    new = np.r_[True, gram[1:] != gram[:-1]]
    head = new | np.r_[True, span[1:] != span[:-1]]
    bucket = np.cumsum(new) - 1
    several = (np.bincount(bucket, head) > 1)[bucket]
    return [gram, span, doc, place], head, several


def sent(found: DataFrame, fn, parts: int, block: int) -> DataFrame:
    """The members that ``fn`` finds in each batch, combined in blocks of about ``block`` and packed for their parts."""
    schema = pa.schema([("part", pa.int32()), ("late", pa.bool_()), ("blob", pa.binary())])

    def flush(held) -> Iterator[pa.RecordBatch]:
        columns, head, _ = pointers([np.concatenate(x) for x in zip(*held, strict=True)])
        part = (c.mix(columns[0]) % np.uint64(parts)).astype(np.int64)
        out = []
        for late, some in ((True, ~head), (False, head)):
            mine = np.flatnonzero(some)
            mine = mine[np.argsort(part[mine], kind="stable")]
            bounds = np.flatnonzero(np.diff(part[mine], prepend=-1, append=-1))
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                at = mine[lo:hi]
                out.append({"part": int(part[at[0]]), "late": late, "blob": c.packed([x[at].view(np.uint64) for x in (columns[2:] if late else columns)])})
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for members in fn(batch):
                held.append([members["gram"].view(np.uint64), members["span"].view(np.uint64), members["doc_id"], members["place"]])
                size += len(members["place"])
                if size >= block:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return found.mapInArrow(run, "part int, late boolean, blob binary")


def refine(spark: SparkSession, found: DataFrame, fn, parts: int) -> tuple[DataFrame, DataFrame]:
    """Members of the span buckets but the earliest, and the earliest ones of q-gram buckets with several of them.

    Written once: what the next round and the end read is not computed again.
    """
    schema = pa.schema([("edge", pa.bool_()), ("doc_id", pa.int64()), ("place", pa.int64()), ("gram", pa.int64())])

    def rows(edge: bool, doc: np.ndarray, place: np.ndarray, gram: np.ndarray) -> pa.RecordBatch:
        kinds = pa.array(np.full(len(doc), edge))
        return pa.RecordBatch.from_arrays([kinds, pa.array(doc.view(np.int64)), pa.array(place.view(np.int64)), pa.array(gram.view(np.int64))], schema=schema)

    def settle(held) -> Iterator[pa.RecordBatch]:
        gram, span, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
        (gram, span, doc, place), head, several = pointers([gram, span, doc.view(np.int64), place.view(np.int64)])
        yield rows(False, doc[~head], place[~head], gram[~head])
        yield rows(True, doc[head & several], place[head & several], gram[head & several])

    def run(batches):
        part, held = None, []
        for batch in batches:
            for p, late, blob in zip(*(batch.column(x).to_pylist() for x in ("part", "late", "blob")), strict=True):
                if late:  # settled by the task that sent it
                    doc, place = c.unpacked(blob, 2)
                    yield rows(False, doc, place, np.zeros(len(doc), np.uint64))
                    continue
                if p != part and held:
                    yield from settle(held)
                    held = []
                part = p
                held.append(c.unpacked(blob, 4))
        if held:
            yield from settle(held)

    dealt = sent(found, fn, parts, MEMBERS).repartition(parts, "part").sortWithinPartitions("part")
    done = durable(spark, dealt.mapInArrow(run, "edge boolean, doc_id long, place long, gram long"), "repeats")
    edges = done.where("edge").groupBy("doc_id").agg(F.collect_list(F.struct("place", "gram")).alias("runs"))
    return done.where("NOT edge").select("doc_id", "place"), edges


def merge(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs; touching intervals join."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    head = np.flatnonzero(np.r_[True, starts[1:] > stops[:-1]])
    return starts[head], stops[np.r_[head[1:] - 1, len(stops) - 1]]


def cut(batch: pa.RecordBatch):
    data, at = c.buffer(batch.column("text"))
    runs = batch.column("runs")
    n, removed, count, digest, kept = [], [], [], [], []
    for k in range(batch.num_rows):
        text = data[at[k] : at[k + 1]]
        a = b = np.zeros(0, np.int64)
        if runs[k].is_valid and len(runs[k].values):
            place = runs[k].values.to_numpy(zero_copy_only=False)
            first, size, _ = unplaced(place)
            a, b = merge(first, first + size + DEPTH - 1)
        keep = np.ones(len(text), bool)
        for x, y in zip(a, b, strict=True):
            keep[x:y] = False
        rest = text[keep].tobytes()
        n.append(len(text))
        removed.append(int((b - a).sum()))
        count.append(len(a))
        digest.append(hashlib.sha256(rest).hexdigest())
        kept.append(rest)
    yield {"doc_id": batch.column("doc_id"), "n_bytes": n, "n_removed": removed, "n_spans": count, "kept_sha256": digest, "kept": kept}


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes.

    Null text counts as empty, texts under 100 bytes keep all, an empty table gives no row. A null id is
    an id before all others; for repeated rows and ids see ``common.one_each``. Other columns are ignored.
    """
    texts, names = c.one_each(spark, docs)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, size // PART_BYTES)
    # The texts are shuffled by id once, packed; the three joins below take the same exchange.
    packed = c.map_batches(texts, pack_texts, "doc_id long, packed binary")
    whole, edges = refine(spark, texts, in_pieces(find_anchors), parts)
    cut_up, edges = refine(spark, packed.join(edges, "doc_id"), unpacked(find_parts), parts)
    single, _ = refine(spark, packed.join(edges, "doc_id"), unpacked(find_windows), parts)
    runs = whole.unionByName(cut_up).unionByName(single).groupBy("doc_id").agg(F.collect_list("place").alias("runs"))
    out = packed.join(runs, "doc_id", "left").select("doc_id", "packed", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return c.shown(c.map_batches(out, unpacked(cut), schema), names)
