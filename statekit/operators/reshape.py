"""Split, merge and rescale of state, and the proof that no key was lost, doubled or misplaced.

State rows carry ``key`` and ``key_group``; handles say which inclusive group range a subtask holds.
Ranges are expanded to key groups (at most 32,768 rows), so every overlap is an equality join with
a table of proven size, never a join of state on ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statekit.functions import routing as r


def handles(spark: SparkSession, db_id: str, checkpoint_id: str, groups: int, parallelism: int) -> DataFrame:
    """Handles ``(db_id, checkpoint_id, subtask, lo, hi)`` left by a job at a parallelism."""
    ranges = r.subtask_ranges(spark, groups, parallelism)
    return ranges.select(
        F.lit(db_id).alias("db_id"), F.lit(checkpoint_id).alias("checkpoint_id"), "subtask", "lo", "hi"
    )


def overlaps(old: DataFrame, groups: int, parallelism: int) -> DataFrame:
    """(old_subtask, new_subtask, lo, hi, overlap) for every pair of ranges that meet."""
    by_group = r.expand_groups(old).select(
        F.col("subtask").alias("old_subtask"),
        r.owner("key_group", groups, parallelism).alias("new_subtask"),
        "key_group",
    )
    return by_group.groupBy("old_subtask", "new_subtask").agg(
        F.min("key_group").alias("lo"),
        F.max("key_group").alias("hi"),
        F.count(F.lit(1)).alias("overlap"),
    )


def with_base(pairs: DataFrame) -> DataFrame:
    """Mark the source that each new subtask adopts: the largest overlap, the lowest range on a tie."""
    best = Window.partitionBy("new_subtask").orderBy(F.desc("overlap"), "lo")
    return pairs.withColumn("is_base", F.row_number().over(best) == 1)


def rescale_plan(old: DataFrame, groups: int, parallelism: int) -> DataFrame:
    """Per new subtask: number of sources, the base, and how many groups must be copied into it."""
    pairs = with_base(overlaps(old, groups, parallelism))
    base = F.col("is_base")
    return pairs.groupBy("new_subtask").agg(
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.count(F.lit(1)).alias("sources"),
        F.max(F.when(base, F.col("old_subtask"))).alias("base_subtask"),
        F.max(F.when(base, F.col("overlap"))).alias("base_overlap"),
        F.coalesce(F.sum(F.when(~base, F.col("overlap"))), F.lit(0)).alias("copied_groups"),
    )


def group_moves(old: DataFrame, groups: int, parallelism: int) -> DataFrame:
    """(key_group, old_subtask, new_subtask, copied): what happens to each group; at most 32,768 rows."""
    r.check_parallelism(groups, parallelism)
    pairs = with_base(overlaps(old, groups, parallelism))
    return pairs.select(
        F.explode(F.sequence("lo", "hi")).alias("key_group"),
        "old_subtask",
        "new_subtask",
        (~F.col("is_base")).alias("copied"),
    )


def rescale(state: DataFrame, old: DataFrame, groups: int, parallelism: int) -> DataFrame:
    """State rows with their old and new subtask, and whether they are copied or adopted with the base.

    The plan is broadcast (proven size), so the state is neither shuffled nor sorted here; write the
    result with :func:`statekit.sources.files.write_by` to lay it out by owner.
    """
    return state.join(F.broadcast(group_moves(old, groups, parallelism)), "key_group")


def next_handles(rescaled: DataFrame, groups: int, parallelism: int) -> DataFrame:
    """Handles after a rescale, for the next one in the chain."""
    return handles(rescaled.sparkSession, "rescaled", f"p{parallelism}", groups, parallelism)


def verify_partition(gen: DataFrame, truth: DataFrame, groups: int, parallelism: int) -> DataFrame:
    """Five checks of a generation ``(key, value, subtask)`` against ``truth (key, value)``, as one row."""
    right = F.col("subtask") == r.owner(r.key_group("key", groups), groups, parallelism)
    per_key = gen.groupBy("key").agg(
        F.count(F.lit(1)).alias("_copies"),
        F.min("value").alias("_lo"),
        F.max("value").alias("_hi"),
        F.bool_and(right).alias("_right"),
    )
    both = per_key.withColumn("_g", F.lit(1)).join(
        truth.select("key", F.col("value").alias("_v"), F.lit(1).alias("_t")), "key", "full"
    )
    found = F.col("_g").isNotNull()
    known = F.col("_t").isNotNull()
    intact = F.col("_lo").eqNullSafe(F.col("_v")) & F.col("_hi").eqNullSafe(F.col("_v"))
    count = lambda c: F.count(F.when(c, 1))
    return both.agg(
        count(found).alias("keys"),
        (count(found & ~known) == 0).alias("no_foreign_key"),
        (count(F.col("_copies") > 1) == 0).alias("no_duplicate"),
        (count(known & ~found) == 0).alias("no_loss"),
        (count(found & known & ~intact) == 0).alias("values_intact"),
        (count(found & ~F.col("_right")) == 0).alias("right_owner"),
    )


def split(state: DataFrame, boundary: Column, column: str = "key") -> tuple[DataFrame, DataFrame]:
    """State below the boundary, and from the boundary on."""
    return state.where(F.col(column) < boundary), state.where(F.col(column) >= boundary)


def check_adjacent(ranges: DataFrame) -> None:
    """Raise unless the ``(db_id, lo, hi)`` ranges touch without overlap; one row per source."""
    by_lo = Window.partitionBy(F.lit(0)).orderBy("lo")
    wrong = ranges.withColumn("_before", F.lag("hi").over(by_lo)).where(
        F.col("_before").isNotNull() & (F.col("lo") != F.col("_before") + 1)
    )
    bad = wrong.select("db_id", "lo", "hi").first()
    if bad is not None:
        raise ValueError(f"source {bad['db_id']} [{bad['lo']}, {bad['hi']}] is not adjacent to the range before it")


def union_shards(sources: list[DataFrame], ranges: DataFrame) -> DataFrame:
    """Merge sources of adjacent, non-overlapping ranges into one state; nothing is copied until written."""
    check_adjacent(ranges)
    merged = sources[0]
    for s in sources[1:]:
        merged = merged.unionByName(s)
    return merged


def duplicates_across(tables: DataFrame, table: str = "db_id", key: str = "key") -> DataFrame:
    """Keys held by more than one table."""
    held = tables.select(table, key).distinct()
    return held.groupBy(key).agg(F.count(F.lit(1)).alias("tables")).where("tables > 1")


def reconcile(expected: DataFrame, actual: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row: keys that match, are missing, are extra or have another value. Both sides unique by key."""
    e = expected.select(key, F.struct(value).alias("_e"))
    a = actual.select(key, F.struct(value).alias("_a"))
    count = lambda c: F.count(F.when(c, 1))
    both = F.col("_e").isNotNull() & F.col("_a").isNotNull()
    same = F.col(f"_e.{value}").eqNullSafe(F.col(f"_a.{value}"))
    return e.join(a, key, "full").agg(
        count(both & same).alias("matching"),
        count(both & ~same).alias("wrong"),
        count(F.col("_a").isNull()).alias("missing"),
        count(F.col("_e").isNull()).alias("extra"),
    )


def no_loss(before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """Keys on one side only, with the side that lacks them."""
    b, a = before.select(key).distinct(), after.select(key).distinct()
    lost = b.join(a, key, "left_anti").select(key, F.lit("lost").alias("what"))
    return lost.unionByName(a.join(b, key, "left_anti").select(key, F.lit("new").alias("what")))


def max_across_generations(counts: DataFrame) -> DataFrame:
    """True counter of a key over the tables ``(generation, key, n)`` of successive jobs; counts only grow."""
    return counts.groupBy("key").agg(
        F.max("n").alias("n"), F.max_by("generation", F.struct("n", "generation")).alias("generation")
    )


def shard_merge_stats(counts: DataFrame) -> DataFrame:
    """Per key over ``(shard, key, n)``: the sum and the number of shards that hold it."""
    per = counts.groupBy("key", "shard").agg(F.sum("n").alias("_n"))
    return per.groupBy("key").agg(
        F.sum("_n").cast("bigint").alias("total"), F.count(F.lit(1)).alias("shards")
    )


def distinct_generations(names: DataFrame, name: str, seq: str) -> DataFrame:
    """Each recorded name once, with the position of its first mention to order by."""
    return names.groupBy(name).agg(F.min(seq).alias("first_seq"))


def scope_check(reads: DataFrame, truth: DataFrame) -> DataFrame:
    """Per database: reads ``(db_id, key, got)`` that are right, wrong, or show another scope's value.

    The owners of a (key, value) are summarised before the join, so scopes are never paired up.
    """
    owners = truth.groupBy("key", F.col("value").alias("got")).agg(
        F.min("db_id").alias("_first"), F.max("db_id").alias("_last")
    )
    seen = reads.join(owners, ["key", "got"], "left").join(
        truth.select("db_id", "key", F.col("value").alias("_own")), ["db_id", "key"], "left"
    )
    right = F.col("got").eqNullSafe(F.col("_own"))
    foreign = ~right & ((F.col("_first") != F.col("db_id")) | (F.col("_last") != F.col("db_id")))
    return seen.groupBy("db_id").agg(
        F.count(F.lit(1)).alias("reads"),
        F.count(F.when(right, 1)).alias("right_value"),
        F.count(F.when(foreign, 1)).alias("mixed"),
        F.count(F.when(~right, 1)).alias("wrong"),
    )


def value_probe(reads: DataFrame, pattern: Column) -> DataFrame:
    """Per database: reads ``(db_id, key, own, got)`` that found nothing, the own value, another scope's value (one that
    matches ``pattern``), or something else."""
    same, like = F.col("got") == F.col("own"), F.rlike(F.col("got"), pattern)
    return reads.groupBy("db_id").agg(
        F.count(F.lit(1)).alias("reads"),
        F.count_if(F.col("got").isNull()).alias("missing"),
        F.count_if(same).alias("right_value"),
        F.count_if(~same & like).alias("mixed"),
        F.count_if(~same & ~like).alias("garbled"),
    )


def seeded(df: DataFrame, seq: str, seed: int) -> DataFrame:
    """Add ``place``, by which rows are in an order that depends on the seed alone: a hash of seed and position.

    The first 15 digits of it make a whole number; two rows share a place about once in 10**9 rows of a key.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(seq).cast("string")).cast("binary"))
    return df.withColumn("place", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
