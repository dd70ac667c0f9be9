"""Packing token sequences: non-negative least squares over shallow length combinations.

Every document gives whole windows and a rest. Which rests share a window is planned on their histogram
alone (at most `window` numbers, whatever the corpus): all combinations of one or two rests and a spread of
threes that fill a window exactly are enumerated, their repeat counts are solved as a non-negative least-squares
problem against the histogram and rounded down. The plan is dealt out in Spark: rests of one length are
numbered within salted buckets, so that a third of all documents may have the same length, and the number
says which repeat and which place is theirs. What the rounding leaves is packed greedily, longest first in
each bucket, one stream cut at the window ends; its last part is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statekit.llm import common as c
from statekit.session import durable

WINDOW = 2048
BUCKET_ROWS = 100_000
MOST_BUCKETS = 4096
CACHE = 250_000
CALL = 100
BLOCK = 1 << 20
# How the tokenizer cuts text in Latin-1 (contractions, letters, one digit, other signs).
LOWER = np.frombuffer("".join(map(chr, range(256))).lower().encode("latin-1"), np.uint8)
GAP, LETTER, DIGIT, SIGN = range(4)
KIND = np.full(256, SIGN, np.uint8)
KIND[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = GAP
KIND[[*range(ord("a"), ord("z") + 1), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = LETTER
KIND[[*range(ord("0"), ord("9") + 1), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT
SHORT = np.isin(np.arange(256), list(b"stmd"))
LONG = [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]


@lru_cache(maxsize=2)
def encoder(path: str):
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    bare = Tokenizer(tokenizer.model)  # for pieces that are cut and in lower case
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    dtype = np.dtype("<u2" if tokenizer.get_vocab_size() < 1 << 16 else "<u4")
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    return tokenizer, bare, dtype, ends, {}


def whole(path: str, text: str) -> np.ndarray:
    tokenizer, _, dtype, _, _ = encoder(path)
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype)


def learn(path: str, words: list[bytes]) -> None:
    """Put the ids of the words into the cache; one call for many, told apart by the tokens that end a word."""
    _, bare, dtype, ends, cache = encoder(path)
    for i in range(0, len(words), CALL):
        some = words[i : i + CALL]
        ids = np.array(bare.encode(b" ".join(some).decode("latin-1"), add_special_tokens=False).ids, dtype)
        stops = ((np.flatnonzero(ends[ids]) + 1) * dtype.itemsize).tolist()
        if len(stops) != len(some) or stops[-1] != ids.nbytes:
            raise ValueError("the tokenizer does not mark the ends of words")
        data = ids.tobytes()
        cache.update(zip(some, [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], strict=True))


def cut_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of lower-case Latin-1 begin a piece of the tokenizer's, and which lie in one. It ends with two gaps."""
    kind = KIND[data]
    begins = kind == DIGIT
    begins[0] = True
    begins[1:] |= kind[1:] != kind[:-1]
    inside = kind != GAP
    begins &= inside
    # An apostrophe that begins its run takes some letters along, and a new piece begins after them.
    q = np.flatnonzero(begins & (data == ord("'")))
    one, two = SHORT[data[q + 1]], np.isin(data[q + 1].astype(np.int64) << 8 | data[q + 2], LONG)
    q, after = q[one | two], (q + 2 + two)[one | two]
    begins[q + 1] = False
    begins[after] |= kind[after] == LETTER
    return begins, inside


def encode_plain(path: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of Latin-1 texts one after the other, and where each text's ids start (and the last one's end)."""
    _, _, dtype, _, cache = encoder(path)
    data = LOWER[np.frombuffer(b" ".join([*texts, b" "]), np.uint8)]
    begins, inside = cut_words(data)
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    of_text = np.concatenate([[0], np.cumsum(np.add.reduceat(begins, starts[:-1], dtype=np.int64))])  # pieces before each text
    letters = data[inside]
    at = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
    held, stops = c.buffer(pieces.dictionary)
    held, stops = held.tobytes(), stops.tolist()
    words = [held[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]
    new = [w for w in words if w not in cache]
    if len(cache) + len(new) > CACHE:
        cache.clear()
        new = words
    learn(path, new)
    ids = [cache[w] for w in words]
    counts = np.fromiter(map(len, ids), np.int64, len(ids)) // dtype.itemsize
    first = np.cumsum(counts) - counts
    which = pieces.indices.to_numpy()
    total = np.concatenate([[0], np.cumsum(counts[which])])
    return np.frombuffer(b"".join(ids), dtype)[c.expand(first[which], counts[which])], total[of_text]


def latin(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def blocks(text: str) -> list[str]:
    """A text cut before white space, where no token crosses, into parts of about ``BLOCK`` characters."""
    out, at = [], 0
    while len(text) - at > BLOCK and (end := text.find(" ", at + BLOCK)) > 0:
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def encode(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text, as the tokenizer gives them without special tokens.

    Latin-1 text is cut as the tokenizer would cut it, and each distinct piece looked up in a bounded cache; other
    text, or one that may hold a special token, goes to the tokenizer as it is.
    """
    parts = [(i, part) for i, text in enumerate(texts) for part in blocks(text)]
    ids: list[list[np.ndarray]] = [[] for _ in texts]
    run: list[tuple[int, bytes]] = []

    def flush() -> None:
        if run:
            got, at = encode_plain(path, [data for _, data in run])
            for (i, _), a, b in zip(run, at[:-1], at[1:], strict=True):
                ids[i].append(got[a:b])
            run.clear()

    size = 0
    for i, part in parts:
        data = None if "<|" in part else latin(part)
        if data is None:
            flush()
            ids[i].append(whole(path, part))
        else:
            run.append((i, data))
            size += len(data)
        if size >= BLOCK:
            flush()
            size = 0
    flush()
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in ids]


def tokenize(path: str, end_id: int):
    def run(batch: pa.RecordBatch):
        press = zstandard.ZstdCompressor(level=1)
        n, ids = [], []
        for got in encode(path, batch.column("text").to_pylist()):
            got = np.append(got, got.dtype.type(end_id))
            n.append(len(got))
            ids.append(press.compress(got.tobytes()))
        yield {"doc_id": batch.column("doc_id"), "n": n, "ids": ids}

    return run


def combinations(window: int) -> np.ndarray:
    """Lengths of up to three rests that fill a window exactly (0: none), each row in falling order."""
    rows = [(a, window - a, 0) for a in range(window - 1, (window - 1) // 2, -1) if a >= window - a]
    for a in range(window - 2, 0, -1):
        rest = window - a
        for b in {(rest + 1) // 2, rest * 2 // 3, rest * 3 // 4, rest * 7 // 8}:
            if 0 < b < rest and b <= a and rest - b <= b:
                rows.append((a, b, rest - b))
    return np.array(rows, np.int64).reshape(-1, 3)


def solve(histogram: np.ndarray, rows: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 with least squares of (lengths used - histogram), by accelerated projected gradient."""
    n = len(histogram)
    target = histogram.astype(float)
    target[0] = 0
    used = rows > 0

    def lengths(x):
        total = np.bincount(rows.ravel(), (x[:, None] * used).ravel(), n)
        total[0] = 0
        return total

    share = np.bincount(rows.ravel(), minlength=n).astype(float)
    step = 1 / (3 * max(1.0, share[1:].max()))  # rows have three entries, columns this many
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        error = lengths(y) - target
        error[0] = 0
        new = np.maximum(0, y - step * error[rows].sum(axis=1))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x


def plan(histogram: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and their repeats, rounded so that no length is used more often than it occurs."""
    rows = combinations(window)
    x = solve(histogram, rows)
    left = histogram.copy()
    order = np.argsort(-x, kind="stable")
    repeats = np.zeros(len(rows), np.int64)
    for k in order[: int((x > 0).sum())]:
        length, times = np.unique(rows[k][rows[k] > 0], return_counts=True)
        repeats[k] = min(int(x[k] + 0.5), int((left[length] // times).min()))
        left[length] -= repeats[k] * times
    for k in order:  # what rounding left, as far as the same combinations still go
        length, times = np.unique(rows[k][rows[k] > 0], return_counts=True)
        more = int((left[length] // times).min())
        repeats[k] += more
        left[length] -= more * times
    return rows[repeats > 0], repeats[repeats > 0]


def slots(rows: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every place of the plan: length, first number it serves, first sequence, place in the sequence."""
    base = np.cumsum(repeats) - repeats
    at = np.cumsum(rows, axis=1) - rows
    length, seq, count = rows.ravel(), np.repeat(base, 3), np.repeat(repeats, 3)
    at = at.ravel()
    keep = np.flatnonzero(length)
    keep = keep[np.argsort(length[keep], kind="stable")]
    length, seq, count, at = length[keep], seq[keep], count[keep], at[keep]
    total = np.cumsum(count) - count
    head = np.r_[True, length[1:] != length[:-1]] if len(length) else np.zeros(0, bool)
    first = total - np.maximum.accumulate(np.where(head, total, 0)) if len(length) else total
    return length, first, seq, at, count


def deal(shared):
    def run(batch: pa.RecordBatch):
        """Sequence and place of each numbered rest; -1: not in the plan."""
        length, first, seq, at, count = shared.value
        r, number = (batch.column(x).to_numpy().astype(np.int64) for x in ("r", "number"))
        out, place = np.full(len(r), -1), np.zeros(len(r), np.int64)
        if len(length):
            # Places are ordered by (length, first number); find the last one not after ours.
            k = np.searchsorted(length * (1 << 40) + first, r * (1 << 40) + number, "right") - 1
            ok = (k >= 0) & (length[k] == r) & (number - first[k] < count[k]) & (r > 0)
            out[ok], place[ok] = (seq[k] + number - first[k])[ok], at[k][ok]
        yield {x: batch.column(x) for x in ("doc_id", "bucket", "n", "r")} | {"seq": out, "place": place}

    return run


def ends_of(total: int, window: int) -> np.ndarray:
    """Ends of the last sequences of a stream: powers of two that sum up to what is left."""
    rest = total % window
    parts = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return total - rest + np.cumsum(np.array(parts, np.int64)) if parts else np.zeros(0, np.int64)


def cut(window: int, planned: int, stream: int, dtype: str):
    tail = ends_of(stream, window)
    whole = stream // window

    def streamed(at: int, length: int):
        while length:
            if at // window < whole:
                seq, begin, end = at // window, at // window * window, (at // window + 1) * window
            else:
                k = int(np.searchsorted(tail, at, "right"))
                seq, begin, end = whole + k, int(tail[k - 1]) if k else whole * window, int(tail[k])
            take = min(length, end - at)
            yield seq, at - begin, take
            at, length = at + take, length - take

    def run(batch: pa.RecordBatch):
        press = zstandard.ZstdDecompressor()
        out: dict[str, list] = {x: [] for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        for d in batch.to_pylist():
            ids = np.frombuffer(press.decompress(d["ids"]), dtype).astype("<u4")
            n, r = d["n"], d["r"]
            parts = [(planned + whole + len(tail) + d["full"] + k, 0, window) for k in range(n // window)]
            if d["seq"] >= 0:
                parts.append((d["seq"], d["place"], r))
            elif r:
                parts.extend((planned + s, o, m) for s, o, m in streamed(d["at"], r))
            start = 0
            for seq, offset, length in parts:
                row = (d["doc_id"], start, length, zlib.crc32(ids[start : start + length].tobytes()), n, seq, offset)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
                start += length
        yield out

    return run


def running(sums: dict[int, int]) -> dict[int, int]:
    out, total = {}, 0
    for k in sorted(sums):
        out[k], total = total, total + sums[k]
    return out


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``, so an empty or null text is one token; an empty table gives no row.
    Rows equal in id and text are one document, packed once; for null and repeated ids see
    ``common.one_each``. Other columns are ignored. ``window`` must be a power of two.
    """
    c.bounded(spark)
    texts, names = c.one_each(spark, docs)
    dtype = str(encoder(tokenizer)[2])
    tokens = durable(spark, c.map_batches(texts, c.lean(tokenize(tokenizer, end_id)), "doc_id long, n long, ids binary"), "pack-tokens")
    lengths = tokens.select("doc_id", "n", (F.col("n") % window).alias("r"))
    rows = tokens.count()
    buckets = max(1, min(MOST_BUCKETS, rows // BUCKET_ROWS, rows // 64))
    lengths = lengths.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    counted = durable(spark, lengths.groupBy("r", "bucket").agg(F.count(F.lit(1)).alias("count")), "pack-counts")
    histogram = np.zeros(window + 1, np.int64)
    for row in counted.where("r > 0").groupBy("r").agg(F.sum("count").alias("n")).collect():  # at most `window` rows
        histogram[row.r] = row.n
    combos, repeats = plan(histogram, window)
    shared = spark.sparkContext.broadcast(slots(combos, repeats))
    planned = int(repeats.sum())

    before = F.sum("count").over(Window.partitionBy("r").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = counted.select("r", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("r", "bucket").orderBy("doc_id"))
    numbered = lengths.withColumn("number", number - 1).join(before, ["r", "bucket"]).withColumn("number", F.col("number") + F.col("before"))
    numbered = numbered.select("doc_id", "bucket", "n", "r", "number")
    dealt = durable(spark, c.map_batches(numbered, deal(shared), "doc_id long, bucket long, n long, r long, seq long, place long"), "pack-dealt")

    left = F.when((F.col("seq") < 0), F.col("r")).otherwise(0)
    full = F.floor(F.col("n") / window)
    sums = dealt.groupBy("bucket").agg(F.sum(left).alias("left"), F.sum(full).alias("full")).collect()  # at most MOST_BUCKETS rows
    streams, wholes = running({s.bucket: s.left for s in sums}), running({s.bucket: s.full for s in sums})
    base = spark.createDataFrame([(k, streams[k], wholes[k]) for k in streams], "bucket long, stream long, whole long")
    order = Window.partitionBy("bucket").orderBy(F.desc("left"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumns({"left": left, "whole_": full})
    placed = placed.withColumns({"at": F.coalesce(F.sum("left").over(order), F.lit(0)), "full": F.coalesce(F.sum("whole_").over(order), F.lit(0))})
    placed = placed.join(F.broadcast(base), "bucket").select("doc_id", "r", "seq", "place", (F.col("at") + F.col("stream")).alias("at"), (F.col("full") + F.col("whole")).alias("full"))
    pieces = tokens.join(placed, "doc_id").select("doc_id", "n", "ids", "r", "seq", "place", "at", "full")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    total = sum(s.left for s in sums)
    return c.shown(c.map_batches(pieces, c.lean(cut(window, planned, total, dtype)), schema), names)
