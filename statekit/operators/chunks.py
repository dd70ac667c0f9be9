"""Ordered per-key computations that survive a key holding a third of all rows.

A window partitioned by key sorts all rows of a key in one task. Here a *hot* key is cut into
chunks of ``width`` neighbouring sequence numbers. Each (key, chunk) is sorted by its own task,
one summary row per chunk is carried to the later chunks of that key, and the carry is joined
back on (key, chunk), for which the rows are already partitioned. Keys that are not hot keep one
chunk and pay for nothing but the check.

``seq`` must be unique within a key, so a chunk never holds more than ``width`` rows of it.
Which keys count as hot changes the layout only, never the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "_chunk"


@dataclass(frozen=True)
class ChunkSpec:
    """``width``: most rows of one key that a task sorts. ``sample``: one row in so many is
    counted when hot keys are looked for. A key is hot from about ``hot_rows`` rows on (by default
    ``width``), so there are at most rows/hot_rows hot keys and they can be broadcast."""

    width: int = 1 << 22
    sample: int = 1 << 10
    hot_rows: int | None = None

    @classmethod
    def of(cls, spark: SparkSession) -> "ChunkSpec":
        return cls(
            int(spark.conf.get("spark.statekit.chunk.width", str(cls.width))),
            int(spark.conf.get("spark.statekit.chunk.sample", str(cls.sample))),
        )


def hot_keys(df: DataFrame, keys: list[str], seq: str, spec: ChunkSpec) -> DataFrame:
    """Keys with about ``hot_rows`` rows or more, from a hash sample that a recomputation repeats."""
    least = max(1, (spec.hot_rows or spec.width) // spec.sample)
    return (
        df.where(F.pmod(F.xxhash64(seq), F.lit(spec.sample)) == 0)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= least)
        .select(*keys)
    )


def chunk_of(seq: str, spec: ChunkSpec) -> Column:
    """Integer division, which keeps the order of any BIGINT (the chunk around zero is twice as wide)."""
    return F.expr(f"`{seq}` div {spec.width}")


def chunked(
    df: DataFrame,
    keys: list[str],
    seq: str,
    few_keys: bool = False,
    spec: ChunkSpec | None = None,
    base: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(all rows, rows of hot keys), both with ``_chunk``: null for ordinary keys, else ``seq div width``.

    ``few_keys`` says that the key has so few values that all of them are hot (a metric series,
    a database), which saves the look for hot keys. An empty key list means one global sequence.

    ``base`` is what the second result and the look for hot keys are taken from instead of ``df``: give
    it when ``df`` is itself the result of a shuffle and the same keys can be had from a plain scan.

    The rows of hot keys come from an inner join with the same broadcast, so when no key is hot,
    adaptive execution drops that branch and every join with it before it reads anything.
    """
    spec = spec or ChunkSpec.of(df.sparkSession)
    if few_keys or not keys:
        # The chunks are the only parallelism here, so they are narrower than those of single hot keys.
        chunk = chunk_of(seq, replace(spec, width=max(1, spec.width // 16)))
        rows = df.withColumn(CHUNK, chunk)
        return rows, rows if base is None else base.withColumn(CHUNK, chunk)
    source = df if base is None else base
    hot = F.broadcast(hot_keys(source, keys, seq, spec).withColumn("_hot", F.lit(True)))
    flagged = key_join(df, hot, keys, "left")
    rows = flagged.withColumn(CHUNK, F.when(F.col("_hot"), chunk_of(seq, spec))).drop("_hot")
    only_hot = key_join(source, hot, keys, "inner").withColumn(CHUNK, chunk_of(seq, spec)).drop("_hot")
    return rows, only_hot


def within(keys: list[str], *order: str) -> WindowSpec:
    """Rows of one key and chunk, in order."""
    w = Window.partitionBy(*keys, CHUNK)
    return w.orderBy(*order) if order else w


def carry(
    hot: DataFrame,
    keys: list[str],
    per_chunk: dict[str, Column],
    across: Callable[[WindowSpec], dict[str, Column]],
) -> DataFrame:
    """One row per hot (key, chunk) with what the earlier chunks of the key hand over.

    ``per_chunk`` aggregates a chunk (with map-side combine); ``across`` gets the window over all
    earlier chunks of the key, which is sorted in one task: at most seq range / width rows.
    """
    summary = hot.groupBy(*keys, CHUNK).agg(*[c.alias(n) for n, c in per_chunk.items()])
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return summary.select(*keys, CHUNK, *[c.alias(n) for n, c in across(earlier).items()])


def key_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, *plain: str) -> DataFrame:
    """Join on keys of which a null is a value like others, and on ``plain`` columns of which it is none."""
    other = {k: f"_right_{k}" for k in [*keys, *plain]}
    on = [F.col(k).eqNullSafe(F.col(other[k])) for k in keys] + [F.col(k) == F.col(other[k]) for k in plain]
    return left.join(right.withColumnsRenamed(other), reduce(and_, on), how).drop(*other.values())


def attach(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    return key_join(rows, carried, keys, "left", CHUNK)


def running_sum(
    df: DataFrame,
    keys: list[str],
    seq: str,
    sums: dict[str, Column],
    few_keys: bool = False,
    spec: ChunkSpec | None = None,
) -> DataFrame:
    """Add inclusive running sums per key in ``seq`` order; nulls count as nothing."""
    rows, hot = chunked(df, keys, seq, few_keys, spec)
    upto = within(keys, seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", *[F.sum(c).over(upto).alias(n) for n, c in sums.items()])
    before = carry(
        hot,
        keys,
        {f"_t_{n}": F.sum(c) for n, c in sums.items()},
        lambda w: {f"_c_{n}": F.sum(f"_t_{n}").over(w) for n in sums},
    )
    out = attach(local, before, keys)
    both = [
        F.coalesce(F.col(n) + F.col(f"_c_{n}"), F.col(n), F.col(f"_c_{n}")).alias(n) for n in sums
    ]
    return out.select(*df.columns, *both)


def previous(
    df: DataFrame,
    keys: list[str],
    seq: str,
    values: dict[str, Column],
    when: Column | None = None,
    tie: str | None = None,
    few_keys: bool = False,
    spec: ChunkSpec | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Add values of an earlier row of the key, strictly before the row itself.

    Without ``when``: the last non-null of each value. With it: all values of the last row for which
    ``when`` holds, nulls included. ``tie`` is a second order column for rows that share ``seq`` on
    purpose; the rows that give values must not share one.
    """
    rows, hot = chunked(df, keys, seq, few_keys, spec, base)
    before = within(keys, *([seq, tie] if tie else [seq])).rowsBetween(Window.unboundedPreceding, -1)
    if when is None:
        local = rows.select(
            "*", *[F.last(c, ignorenulls=True).over(before).alias(n) for n, c in values.items()]
        )
        handed = carry(
            hot,
            keys,
            {f"_t_{n}": F.max_by(c, F.when(c.isNotNull(), F.col(seq))) for n, c in values.items()},
            lambda w: {f"_c_{n}": F.last(f"_t_{n}", ignorenulls=True).over(w) for n in values},
        )
        out = attach(local, handed, keys)
        return out.select(*df.columns, *[F.coalesce(n, f"_c_{n}").alias(n) for n in values])
    row = F.when(when, F.struct(*[c.alias(n) for n, c in values.items()]))
    local = rows.select("*", F.last(row, ignorenulls=True).over(before).alias("_l"))
    # One max_by per value instead of one over a struct keeps the aggregation in the hash path.
    at = F.when(when, F.col(seq))
    whole = F.when(
        F.col("_t_at").isNotNull(), F.struct(*[F.col(f"_t_{n}").alias(n) for n in values])
    )
    handed = carry(
        hot,
        keys,
        {"_t_at": F.max(at), **{f"_t_{n}": F.max_by(c, at) for n, c in values.items()}},
        lambda w: {"_c": F.last(whole, ignorenulls=True).over(w)},
    )
    out = attach(local, handed, keys).withColumn("_r", F.coalesce("_l", "_c"))
    return out.select(*df.columns, *[F.col("_r")[n].alias(n) for n in values])


def earlier_max(
    df: DataFrame,
    keys: list[str],
    seq: str,
    values: dict[str, Column],
    few_keys: bool = False,
    spec: ChunkSpec | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Add the maximum of each value over all rows strictly before, per key (or over all rows)."""
    rows, hot = chunked(df, keys, seq, few_keys, spec, base)
    before = within(keys, seq).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[F.max(c).over(before).alias(n) for n, c in values.items()])
    handed = carry(
        hot,
        keys,
        {f"_t_{n}": F.max(c) for n, c in values.items()},
        lambda w: {f"_c_{n}": F.max(f"_t_{n}").over(w) for n in values},
    )
    out = attach(local, handed, keys)
    return out.select(*df.columns, *[F.greatest(n, f"_c_{n}").alias(n) for n in values])


def key_max(
    df: DataFrame,
    keys: list[str],
    seq: str,
    values: dict[str, Column],
    spec: ChunkSpec | None = None,
) -> DataFrame:
    """Add the maximum of each value over all rows of the key."""
    rows, hot = chunked(df, keys, seq, spec=spec)
    local = rows.select("*", *[F.max(c).over(within(keys)).alias(n) for n, c in values.items()])
    summary = hot.groupBy(*keys, CHUNK).agg(*[F.max(c).alias(f"_t_{n}") for n, c in values.items()])
    whole = Window.partitionBy(*keys)
    handed = summary.select(
        *keys, CHUNK, *[F.max(f"_t_{n}").over(whole).alias(f"_c_{n}") for n in values]
    )
    out = attach(local, handed, keys)
    return out.select(*df.columns, *[F.greatest(n, f"_c_{n}").alias(n) for n in values])
