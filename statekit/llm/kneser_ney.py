"""Interpolated modified Kneser-Ney language model, counted in Spark and read by the workers as sorted hash arrays.

Counting: a task turns texts into word identifiers (56-bit hashes), counts the n-grams of a block of text and sends them,
packed, to *parts* by a hash of their context. A task for each part adds them up and writes the part as one file: sorted
64-bit keys, then a value column. From what it has added up it also sends on the contexts (total, and how many
n-grams occur once, twice, more often) and the n-grams one word shorter with the number of distinct words before them,
which are the adjusted counts of the next lower order. Contexts that end in a word with 1 / ``HOT`` or more of all
tokens (at most HOT words) are spread over all parts by whole n-gram; their figures meet as one small row per part.

Scoring: the files lie in the shared folder, each worker maps them into memory and looks up the sorted distinct keys
of a piece of text. The driver holds word lists of at most HOT entries, and six figures an order.

Files are written under another name first and then renamed, so a task that runs twice leaves the same files. A shared
folder that is no file system is read through Arrow, part by part, instead of being mapped.

Texts: A-Z are lower-cased, words end at ASCII white space, every text ends with one END token, also an empty or null
one; the words before a text are BEGIN tokens. A text that is longer than a piece is read in chunks, with the words
before a chunk carried over. Rows with equal or null ids are scored one by one, other columns are not read, a model of
an empty table gives every token the probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.llm import common as c
from statekit.session import durable, work_path

ORDER = 2
BLOCK = 1_300_000
HOT = 256
LEAST_PARTS, PART_BYTES = 64, 16 << 20
ID_BYTES = 7
BEGIN, END = np.uint64(1), np.uint64(2)
IN_MEMORY = 64
PACKED = "kind string, part int, blob binary, figures array<long>"


@dataclass
class Model:
    root: str
    parts: int
    order: int
    tokens: int  # N
    distinct: int  # V
    hot: np.ndarray
    discounts: dict[int, np.ndarray] = field(default_factory=dict)  # for counts 0, 1, 2, 3 and more
    first_total: int = 0
    first_spare: float = 1.0  # probability that the first order leaves for all words alike


# ---- files -----------------------------------------------------------------------------------------------------


def local(root: str) -> str | None:
    """The path of a folder that the machine's file system shows, None for other stores."""
    where = urlparse(root)
    return where.path if where.scheme in ("", "file") else None


def put(root: str, name: str, data: bytes) -> None:
    spare = f"{name}.{uuid.uuid4().hex}"
    if (path := local(root)) is not None:
        os.makedirs(os.path.dirname(f"{path}/{name}"), exist_ok=True)
        with open(f"{path}/{spare}", "wb") as f:
            f.write(data)
        os.replace(f"{path}/{spare}", f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(root)
    store.create_dir(os.path.dirname(f"{path}/{name}"), recursive=True)
    with store.open_output_stream(f"{path}/{spare}") as f:
        f.write(data)
    store.move(f"{path}/{spare}", f"{path}/{name}")


_open: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()


def get(root: str, name: str) -> np.ndarray:
    """The bytes of a file, mapped; of another store, at most ``IN_MEMORY`` files are held at a time.

    A part that no n-gram fell into has no file and is empty.
    """
    if (root, name) in _open:
        _open.move_to_end((root, name))
        return _open[root, name]
    if (path := local(root)) is not None:
        data = np.memmap(f"{path}/{name}", np.uint8, "r") if os.path.exists(f"{path}/{name}") else np.zeros(0, np.uint8)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(root)
        there = store.get_file_info(f"{path}/{name}").type == fs.FileType.File
        data = np.frombuffer(store.open_input_file(f"{path}/{name}").read() if there else b"", np.uint8)
        while len(_open) >= IN_MEMORY:
            _open.popitem(last=False)
    _open[root, name] = data
    return data


def put_table(root: str, table: str, part: int, keys: np.ndarray, values: np.ndarray) -> None:
    """``values`` is a structured array beside the sorted ``keys``."""
    put(root, f"{table}/{part // 1000}/{part}", keys.tobytes() + values.tobytes())


def looked_up(root: str, table: str, kind: np.dtype, part: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The values of the keys (sorted within each part), zeros where there are none."""
    out = np.zeros(len(keys), kind)
    order = np.argsort(part, kind="stable")
    bounds = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        mine = order[lo:hi]
        data = get(root, f"{table}/{part[mine[0]] // 1000}/{part[mine[0]]}")
        n = len(data) // (8 + kind.itemsize)
        if n:
            there = data[: 8 * n].view(np.uint64)
            at = np.minimum(np.searchsorted(there, keys[mine]), n - 1)
            hit = there[at] == keys[mine]
            out[mine[hit]] = data[8 * n :].view(kind)[at[hit]]
    return out


RAW = np.dtype([("n", "<i8")])
GRAM = np.dtype([("n", "<f4")])
CONTEXT = np.dtype([("total", "<f4"), ("spare", "<f4")])


# ---- packed columns --------------------------------------------------------------------------------------------


def rows(kind: str, part: np.ndarray, columns: list[np.ndarray]) -> Iterator[dict]:
    """One packed row for each part, sorted by the columns in turn."""
    order = np.lexsort([*columns[::-1], part])
    bounds = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        mine = order[lo:hi]
        yield {"kind": kind, "part": int(part[mine[0]]), "blob": c.packed([x[mine].astype(np.uint64) for x in columns]), "figures": None}


def arrow_rows(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("blob", pa.binary()), ("figures", pa.list_(pa.int64()))])
    held, size = [], 0
    for row in found:
        held.append(row)
        size += len(row["blob"] or b"")
        if size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


# ---- words -----------------------------------------------------------------------------------------------------


@dataclass
class Tokens:
    """``columns[j]`` is the j-th word before each token (0: itself); text k of the slice has at[k] .. at[k + 1] - 1."""

    first: int  # row of the first text
    at: np.ndarray
    columns: list[np.ndarray]
    ended: bool  # False: the last text goes on in the next one


def tokens(batch: pa.RecordBatch, order: int) -> Iterator[Tokens]:
    row = 0
    for part in c.pieces(batch):
        data, at = c.buffer(part.column("text"))
        if part.num_rows > 1 or len(data) <= c.PIECE:
            yield Tokens(row, *columns_of(data, at, True, None, order), True)
        else:
            gaps = np.flatnonzero(~c.NOT_SPACE[data])
            start, before = 0, None
            while start < len(data):
                k = np.searchsorted(gaps, start + c.PIECE)
                stop = int(gaps[k]) + 1 if k < len(gaps) else len(data)
                ended = stop == len(data)
                found, columns = columns_of(data[start:stop], np.array([0, stop - start]), ended, before, order)
                yield Tokens(row, found, columns, ended)
                before = np.r_[np.full(order, BEGIN) if before is None else before, columns[0][-order:]][-order:]
                start = stop
        row += part.num_rows


def columns_of(data: np.ndarray, at: np.ndarray, ended: bool, before: np.ndarray | None, order: int):
    lower = c.FOLD[data]
    start, stop, first = c.words(lower, at, c.NOT_SPACE)
    word = (c.span_hash(c.prefix_hash(lower), start, stop) >> np.uint64(64 - 8 * ID_BYTES)) | np.uint64(4)
    count = np.diff(first) + ended
    base = np.r_[0, np.cumsum(count + order - 1)]
    line = np.full(base[-1], BEGIN)
    if before is not None and order > 1:
        line[: order - 1] = before[-(order - 1) :]
    line[c.expand(base[:-1] + order - 1, np.diff(first))] = word
    if ended:
        line[base[1:] - 1] = END
    here = c.expand(base[:-1] + order - 1, count)
    return np.r_[0, np.cumsum(count)], [line[here - j] for j in range(order)]


def key_of(columns: list[np.ndarray]) -> np.ndarray:
    """Identifier of the words, newest first in ``columns``."""
    key = c.mix(columns[-1])
    for x in columns[-2::-1]:
        key = c.pair(key, x)
    return key


def part_of(columns: list[np.ndarray], parts: int, hot: np.ndarray) -> np.ndarray:
    """Part of an n-gram: by its context, by the whole n-gram if the context ends in a hot word."""
    key = key_of(columns)
    if len(columns) > 1:
        key = np.where(np.isin(columns[1], hot), key, key_of(columns[1:]))
    return (c.mix(key) % np.uint64(parts)).astype(np.int64)


def summed(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` with sums of ``values``, by rising key; and the keys."""
    key = key_of(columns)
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    one = order[heads]
    return [x[one] for x in columns], [np.add.reduceat(v[order], heads) if len(heads) else v[:0] for v in values], key[one]


# ---- counting --------------------------------------------------------------------------------------------------


def counted(docs: DataFrame, order: int, parts: int, hot: np.ndarray, block: int) -> DataFrame:
    """Packed n-gram counts of blocks of about ``block`` tokens."""

    def flush(held: list[list[np.ndarray]]) -> Iterator[dict]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        columns, (n,), _ = summed(columns, [np.ones(len(columns[0]), np.int64)])
        # Oldest word first, so that the n-grams of a context lie together.
        yield from rows("grams", part_of(columns, parts, hot), [*columns[::-1], n])

    def found(batches) -> Iterator[dict]:
        held, size = [], 0
        for batch in batches:
            for t in tokens(batch, order):
                held.append(t.columns)
                size += len(t.columns[0])
                if size >= block:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return docs.select("text").mapInArrow(lambda batches: arrow_rows(found(batches)), PACKED)


def added_up(packed_rows: DataFrame, kind: str, columns: int, parts: int, fn) -> DataFrame:
    """``fn(part, columns)`` for the columns of all packed rows of a kind and part; it gives packed rows."""

    def found(batches) -> Iterator[dict]:
        part, held = None, []
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if p != part and held:
                    yield from fn(part, [np.concatenate(x) for x in zip(*held, strict=True)])
                    held = []
                part = p
                held.append(c.unpacked(blob, columns))
        if held:
            yield from fn(part, [np.concatenate(x) for x in zip(*held, strict=True)])

    mine = packed_rows.where(F.col("kind") == kind).select("part", "blob").repartition(parts, "part").sortWithinPartitions("part")
    return mine.mapInArrow(lambda batches: arrow_rows(found(batches)), PACKED)


def figures(done: DataFrame, width: int) -> list[int]:
    """Sums of the parts' figures."""
    sums = [F.coalesce(F.sum(F.col("figures")[i]), F.lit(0)) for i in range(width)]
    return list(done.where("kind = 'figures'").agg(*sums).first())


def raw_counts(spark: SparkSession, docs: DataFrame, root: str, parts: int, block: int) -> tuple[int, int, np.ndarray]:
    """Files of the tokens' counts; N, V and the hot tokens."""

    def write(part: int, columns: list[np.ndarray]) -> Iterator[dict]:
        (word,), (n,), keys = summed(columns[:1], [columns[1].astype(np.int64)])
        put_table(root, "raw", part, keys, n.astype(RAW))
        yield {"kind": "figures", "part": part, "blob": None, "figures": [int(n.sum()), len(n)]}
        top = np.argsort(-n, kind="stable")[:HOT]
        for w, k in zip(word[top].tolist(), n[top].tolist(), strict=True):
            yield {"kind": "top", "part": part, "blob": None, "figures": [w, k]}

    done = added_up(counted(docs, 1, parts, np.zeros(0, np.uint64), block), "grams", 2, parts, write)
    done = durable(spark, done, "tokens")
    total, distinct = figures(done, 2)
    frequent = done.where((F.col("kind") == "top") & (F.col("figures")[1] * HOT >= total)).select(F.col("figures")[0]).collect()
    return total, distinct, np.array([r[0] for r in frequent], np.uint64)  # at most HOT of them


def discounts(once: int, twice: int, thrice: int, four: int) -> np.ndarray:
    """Chen and Goodman's three discounts; fixed ones where a count of counts is missing or one is not within (0, count)."""
    if once and twice and thrice and four:
        y = once / (once + 2 * twice)
        found = np.array([0, 1 - 2 * y * twice / once, 2 - 3 * y * thrice / twice, 3 - 4 * y * four / thrice])
        if (found[1:] > 0).all() and (found[1:] < [1, 2, 3]).all():
            return found
    return np.array([0, 0.5, 1.0, 1.5])


def one_order(spark: SparkSession, grams: DataFrame, model: Model, size: int) -> DataFrame:
    """Write the files of one order; the packed rows of the next lower one."""
    root, parts, hot = model.root, model.parts, model.hot

    def write(part: int, columns: list[np.ndarray]) -> Iterator[dict]:
        words, (n,), keys = summed(columns[-2::-1], [columns[-1].astype(np.int64)])
        put_table(root, f"grams{size}", part, keys, n.astype(GRAM))
        yield {"kind": "figures", "part": part, "blob": None, "figures": [len(n), int(n.sum()), *(int((n == k).sum()) for k in (1, 2, 3, 4))]}
        if size > 1:
            of = key_of(words[1:])
            context, inverse = np.unique(of, return_inverse=True)
            sums = [np.bincount(inverse, w, len(context)).astype(np.int64) for w in (n, n == 1, n == 2, n > 2)]
            yield from rows("contexts", (c.mix(context) % np.uint64(parts)).astype(np.int64), [context, *sums])
            shorter, (before,), _ = summed(words[:-1], [np.ones(len(n), np.int64)])
            yield from rows("grams", part_of(shorter, parts, hot), [*shorter[::-1], before])

    done = durable(spark, added_up(grams, "grams", size + 1, parts, write), f"order{size}")
    many, total, once, twice, *more = figures(done, 6)
    cut = model.discounts[size] = discounts(once, twice, *more)
    if size == 1:
        model.first_total = total
        model.first_spare = float(cut @ [0, once, twice, many - once - twice]) / total if total else 1.0
        return done

    def write_contexts(part: int, columns: list[np.ndarray]) -> Iterator[dict]:
        order = np.argsort(columns[0], kind="stable")
        heads = np.flatnonzero(np.diff(columns[0][order], prepend=~columns[0][order[:1]]))
        total, *n = (np.add.reduceat(x[order].astype(np.int64), heads) for x in columns[1:])
        values = np.zeros(len(heads), CONTEXT)
        values["total"], values["spare"] = total, (cut[1] * n[0] + cut[2] * n[1] + cut[3] * n[2]) / total
        put_table(root, f"contexts{size}", part, columns[0][order[heads]], values)
        yield {"kind": "figures", "part": part, "blob": None, "figures": [len(heads)]}

    figures(added_up(done, "contexts", 5, parts, write_contexts), 1)
    return done


def fit(spark: SparkSession, docs: DataFrame, order: int = ORDER) -> Model:
    """A model of n-grams up to ``order`` words from all texts of ``docs``."""
    docs = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, size // PART_BYTES)
    root = work_path(spark, "ngrams")
    model = Model(root, parts, order, *raw_counts(spark, docs, root, parts, BLOCK))
    grams = counted(docs, order, parts, model.hot, BLOCK)
    for k in range(order, 0, -1):
        grams = one_order(spark, grams, model, k)
    return model


# ---- scoring ---------------------------------------------------------------------------------------------------


def values_of(model: Model, table: str, kind: np.dtype, columns: list[np.ndarray], hot: np.ndarray | None) -> np.ndarray:
    """The table's value for each token's words; ``hot`` None: parts by the key alone."""
    key, one, back = np.unique(key_of(columns), return_index=True, return_inverse=True)
    if hot is None:
        part = (c.mix(key) % np.uint64(model.parts)).astype(np.int64)
    else:
        part = part_of([x[one] for x in columns], model.parts, hot)
    return looked_up(model.root, table, kind, part, key)[back]


def log_probabilities(model: Model, columns: list[np.ndarray]) -> np.ndarray:
    """log10 of each token's probability after the words before it."""
    p = np.full(len(columns[0]), 1 / (model.distinct + 1))
    if model.tokens:
        n = values_of(model, "grams1", GRAM, columns[:1], model.hot)["n"].astype(float)
        p = (n - cut(model, 1, n)) / model.first_total + model.first_spare * p
        for k in range(2, model.order + 1):
            n = values_of(model, f"grams{k}", GRAM, columns[:k], model.hot)["n"].astype(float)
            around = values_of(model, f"contexts{k}", CONTEXT, columns[1:k], None)
            known = around["total"] > 0
            share = (n - cut(model, k, n)) / np.where(known, around["total"], 1).astype(float)
            p = np.where(known, share + around["spare"].astype(float) * p, p)
    return np.log10(p)


def cut(model: Model, size: int, n: np.ndarray) -> np.ndarray:
    return model.discounts[size][np.minimum(n, 3).astype(np.int64)]


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """Each text's n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (log10) and perplexity."""
    shared = spark.sparkContext.broadcast(model)
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches):
        model: Model = shared.value
        floor = np.log10(model.tokens + model.distinct + 1)
        for batch in batches:
            out = np.zeros((4, batch.num_rows))
            for t in tokens(batch, model.order):
                n = values_of(model, "raw", RAW, t.columns[:1], model.hot)["n"] if model.tokens else np.zeros(len(t.columns[0]))
                each = np.vstack([np.ones(len(n)), n > 0, np.log10(n + 1.0) - floor, log_probabilities(model, t.columns)])
                texts = np.repeat(np.arange(t.first, t.first + len(t.at) - 1), np.diff(t.at))
                for total, values in zip(out, each, strict=True):
                    total += np.bincount(texts, values, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(out[0].astype(np.int64)),
                    pa.array(out[1].astype(np.int64)),
                    pa.array(np.full(batch.num_rows, model.tokens, np.int64)),
                    pa.array(out[2]),
                    pa.array(out[3]),
                ],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    found = c.documents(docs).mapInArrow(run, schema)
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
