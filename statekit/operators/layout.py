"""Where keys live: counts, sizes and checks per key group, shard and owner.

Rows are counted per key first (map-side combine); routing is then computed once per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statekit.functions import routing as r


def keyed_count(df: DataFrame, key: str = "key") -> DataFrame:
    """Final value of a per-key counter."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def routed(
    keyed: DataFrame, groups: int = r.GROUPS, parallelism: int = 4, shards: int = r.SHARDS
) -> DataFrame:
    """Add ``key_group``, ``shard`` and ``owner`` to rows with a ``key``."""
    return (
        keyed.withColumn("key_group", r.key_group("key", groups))
        .withColumn("shard", r.shard("key_group", groups, shards))
        .withColumn("owner", r.owner("key_group", groups, parallelism))
    )


def size_by(keyed: DataFrame, column: str, rows: str = "n") -> DataFrame:
    """Keys and rows per value of a routing column."""
    return keyed.groupBy(column).agg(
        F.count(F.lit(1)).alias("keys"), F.sum(rows).cast("bigint").alias("rows")
    )


def range_report(keyed: DataFrame, groups: int, parallelism: int) -> DataFrame:
    """Range of every subtask next to what it really holds."""
    ranges = r.subtask_ranges(keyed.sparkSession, groups, parallelism)
    held = keyed.groupBy(r.owner("key_group", groups, parallelism).alias("subtask")).agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("n").cast("bigint").alias("rows"),
        F.min("key_group").alias("first_group"),
        F.max("key_group").alias("last_group"),
    )
    return ranges.join(held, "subtask", "left").fillna(0, ["keys", "rows"])


def tiling_check(ranges: DataFrame, groups: int) -> DataFrame:
    """Mark every range that leaves a gap to, or overlaps, the one before it; the last must end at groups-1.

    ``ranges`` has one row per subtask, so the unpartitioned window sorts at most 32,768 rows.
    """
    by_lo = Window.partitionBy(F.lit(0)).orderBy("lo")
    before = F.coalesce(F.lag("hi").over(by_lo), F.lit(-1))
    after = F.coalesce(F.lead("lo").over(by_lo), F.lit(groups))
    return ranges.select(
        "*",
        (F.col("lo") - before - 1).alias("gap_before"),
        ((F.col("lo") == before + 1) & (after == F.col("hi") + 1)).alias("tiles"),
    )


def ownership_check(keyed: DataFrame, groups: int, parallelisms: list[int]) -> DataFrame:
    """Per parallelism: keys outside [0, groups) or outside the range of their owner; one pass over the keys."""
    kg = F.col("key_group")
    counts = [F.count(F.lit(1)).alias("keys")]
    counts.append(F.count(F.when(~kg.between(0, groups - 1), 1)).alias("out_of_bounds"))
    for p in parallelisms:
        o = r.owner(kg, groups, p)
        inside = kg.between(r.range_lo(o, groups, p), r.range_hi(o, groups, p))
        counts.append(F.count(F.when(~inside, 1)).alias(f"_m{p}"))
    per = [
        F.struct(F.lit(p).alias("parallelism"), F.col(f"_m{p}").alias("misplaced"))
        for p in parallelisms
    ]
    return keyed.agg(*counts).select("keys", "out_of_bounds", F.inline(F.array(*per)))


def owned_shards(spark: SparkSession, groups: int, parallelism: int, shards: int) -> DataFrame:
    """(subtask, shard, groups_held, openers) for every shard of which a subtask holds any group.

    Ranges and shards are expanded to key groups, so the overlap is an aggregation, not a range join.
    """
    held = (
        r.expand_groups(r.subtask_ranges(spark, groups, parallelism))
        .groupBy("subtask", r.shard("key_group", groups, shards).alias("shard"))
        .agg(F.count(F.lit(1)).alias("groups_held"))
    )
    openers = F.count(F.lit(1)).over(Window.partitionBy("shard"))
    return held.withColumn("openers", openers)


def reshard_map(
    spark: SparkSession, groups: int, shards: int, old: int, new: int
) -> DataFrame:
    """First owner of every shard before and after a change of parallelism."""
    per = groups // shards
    ids = spark.range(shards, numPartitions=1).select(F.col("id").cast("int").alias("shard"))
    first = F.col("shard") * per
    return ids.select(
        "shard",
        r.owner(first, groups, old).alias("old_owner"),
        r.owner(first, groups, new).alias("new_owner"),
    ).withColumn("moved", F.col("old_owner") != F.col("new_owner"))


def encoded_order(keyed: DataFrame, groups: int = r.GROUPS, state_id: str = "s") -> DataFrame:
    """Per key group: first and last encoded key, and keys whose encoding breaks (group, key) order.

    Keys are range-partitioned by (group, key), so each task checks an equal, sorted slice as it streams
    past; only one row per slice and group goes on to the check across slices.
    """

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            for group, part in pdf.groupby("key_group", sort=False):
                codes = part["encoded"].to_numpy()
                back = int((codes[1:] <= codes[:-1]).sum())
                if last is not None and last[0] == group:
                    back += codes[0] <= last[1]
                last = (group, codes[-1])
                yield pd.DataFrame(
                    {"key_group": [group], "n": [len(codes)], "first": [codes[0]], "last": [codes[-1]], "back": [back]}
                )

    enc = keyed.select(
        "key_group", "key", r.encoded_key("key_group", "key", groups, state_id).alias("encoded")
    )
    in_order = enc.repartitionByRange("key_group", "key").sortWithinPartitions("key_group", "key")
    parts = in_order.select("key_group", "encoded").mapInPandas(
        slices, "key_group int, n long, first binary, last binary, back long"
    )
    # Slices that overlap would show up as a slice that starts before the one below it ends.
    by_first = Window.partitionBy("key_group").orderBy("first")
    crossed = (F.lag("last").over(by_first) >= F.col("first")).cast("long")
    return parts.withColumn("_crossed", F.coalesce(crossed, F.lit(0))).groupBy("key_group").agg(
        F.sum("n").alias("keys"),
        F.hex(F.min("first")).alias("first_encoded"),
        F.hex(F.max("last")).alias("last_encoded"),
        F.sum(F.col("back") + F.col("_crossed")).alias("inversions"),
    )
