"""Helpers shared by the operators: clean inputs, byte buffers of Arrow batches, word and hash arrays.

The numpy helpers run inside Spark tasks and see one Arrow batch at a time, in pieces of about
``PIECE`` bytes, so their memory does not grow with the table.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.session import durable

PIECE = 1 << 20
BATCH_BYTES = 4 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = b" \t\n\x0b\x0c\r"


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, a null text as an empty one; other columns cannot clash with ours."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(column: str) -> Column:
    """``crc32`` of the decimal text of an id; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` for a function from one batch to a dict of columns (or several of them)."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                for columns in fn(part):
                    arrays = [as_arrow(columns[f.name], f.type) for f in arrow]
                    if len(arrays[0]):
                        yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give memory that a worker no longer uses back to the machine; it stays alive between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(fn):
    def run(batch: pa.RecordBatch):
        yield from fn(batch)
        release()

    return run


def bounded(spark: SparkSession) -> None:
    """From now on an Arrow batch ends at BATCH_BYTES, so ten thousand long texts don't fill executor and worker at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.array(values, type=kind)


def pieces(batch: pa.RecordBatch, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``PIECE`` bytes of text each; a longer text makes a slice of its own."""
    if name not in batch.schema.names or batch.num_rows == 0:
        yield batch
        return
    ends = np.cumsum(lengths(batch.column(name)))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def lengths(texts: pa.Array) -> np.ndarray:
    return np.diff(offsets(texts))


def offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    return np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts as one array, and where each text starts (and the last one ends)."""
    at = offsets(texts)
    data = texts.buffers()[2]
    if data is None or at[0] == at[-1]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """Ids as int64; a null id becomes the smallest value (see ``hide_null``)."""
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


NULL_ID = -(1 << 63)


def hide_null(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Null ids as the smallest long, so that joins and arrays can carry them."""
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(NULL_ID)))


def show_null(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.nullif(F.col(n), F.lit(NULL_ID)) for n in names})


def random_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


LETTERS = random_table(20240101)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of the ordered pair (a, b)."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + (b ^ np.uint64(0xD6E8FEB86659FD93)))


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), PIECE + (1 << 17))
        with np.errstate(over="ignore"):
            up, down = np.full(size, BASE), np.full(size, INVERSE)
            up[0] = down[0] = 1
            _powers, _inverses = np.cumprod(up), np.cumprod(down)
    return _powers[:n], _inverses[:n]


def prefix_hash(codes: np.ndarray, table: np.ndarray = LETTERS) -> np.ndarray:
    """Running sums of table[code] * BASE**position; ``span_hash`` takes strings out of them."""
    up, _ = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(table[codes] * up[: len(codes)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings [start, stop)."""
    _, down = powers(len(sums))
    return mix((sums[stop] - sums[start]) * down[start])


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and the first word of each text (and the number of words last).

    ``inside`` says for each byte value whether it belongs to a word; words end with their text.
    """
    n = len(data)
    mask = np.zeros(n + 1, bool)
    mask[:n] = inside[data]
    begins = mask[:n].copy()
    begins[1:] &= ~mask[: n - 1]
    heads = at[:-1][at[:-1] < at[1:]]
    begins[heads] = mask[heads]
    ends = mask[1:].copy()
    np.logical_not(ends, out=ends)
    ends[heads[1:] - 1] = True
    ends &= mask[:n]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, stop, np.searchsorted(start, at)


def split_on(separators: bytes) -> np.ndarray:
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


NOT_SPACE = split_on(SPACE)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers start .. start + count - 1 of every run, one after the other."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    if total == 0:
        return out
    out[0] = starts[0]
    heads = np.cumsum(counts)[:-1]
    out[heads] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(out)


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit integers, the first one sorted, by byte planes."""
    planes = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T for x in planes]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    out = [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes]
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_each(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents with unique ids, and how to show them (None: as they are).

    Rows equal in id and text are one document. Several texts under one id are documents of their own,
    ordered by their digest; then, and only then, all get new ids in the old order. A null id comes first.
    """
    base = hide_null(documents(docs))
    if not base.groupBy("doc_id").count().where("count > 1").limit(1).collect():
        return base, None
    base = base.withColumn("digest", F.sha2("text", 256)).dropDuplicates(["doc_id", "digest"])
    rows = base.select("doc_id", "digest").sort("doc_id", "digest").rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    named = durable(spark, spark.createDataFrame(rows, "shown long, digest string, doc_id long"), "ids")
    base = base.withColumnRenamed("doc_id", "shown").join(named, ["shown", "digest"]).select("doc_id", "text")
    return durable(spark, base, "documents"), named.select("doc_id", "shown")


def shown(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """The given id columns as ``one_each`` found them."""
    columns = columns or ("doc_id",)
    for name in columns if names is not None else ():
        order = df.columns
        other = names.select(F.col("doc_id").alias(name), F.col("shown").alias("_shown"))
        df = df.join(other, name, "left").drop(name).withColumnRenamed("_shown", name).select(*order)
    return show_null(df, *columns)
