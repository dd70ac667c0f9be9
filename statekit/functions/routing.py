"""Key groups, owners, shards and order-keeping key encodings, as column expressions.

A key belongs to one of G key groups for good. Owners (subtasks) and shards are contiguous
runs of key groups, so both follow from the group number by arithmetic and never need a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS = 128
SHARDS = 16
MAX_GROUPS = 1 << 15


def check_groups(groups: int) -> None:
    if not 1 <= groups <= MAX_GROUPS:
        raise ValueError(f"key groups must be within 1..{MAX_GROUPS}, got {groups}")


def check_parallelism(groups: int, parallelism: int) -> None:
    check_groups(groups)
    if not 1 <= parallelism <= groups:
        raise ValueError(f"parallelism must be within 1..{groups}, got {parallelism}")


def key_group(key: Column | str, groups: int = GROUPS) -> Column:
    """Group of a key: the first 32 bits of its MD5, modulo the number of groups."""
    check_groups(groups)
    key = F.col(key) if isinstance(key, str) else key
    head = F.substring(F.md5(key.cast("string").cast("binary")), 1, 8)
    return (F.conv(head, 16, 10).cast("bigint") % F.lit(groups)).cast("int")


def owner(group: Column | str, groups: int, parallelism: int) -> Column:
    """Subtask owning a key group at the given parallelism."""
    check_parallelism(groups, parallelism)
    group = F.col(group) if isinstance(group, str) else group
    return F.floor(group * F.lit(parallelism) / F.lit(groups)).cast("int")


def range_lo(subtask: Column, groups: int, parallelism: int) -> Column:
    return F.ceil(subtask * F.lit(groups) / F.lit(parallelism)).cast("int")


def range_hi(subtask: Column, groups: int, parallelism: int) -> Column:
    return (range_lo(subtask + 1, groups, parallelism) - 1).cast("int")


def shard(group: Column | str, groups: int = GROUPS, shards: int = SHARDS) -> Column:
    """Fixed bucket of groups/shards neighbouring key groups."""
    if groups % shards:
        raise ValueError(f"{groups} key groups do not divide into {shards} shards")
    group = F.col(group) if isinstance(group, str) else group
    return F.floor(group / F.lit(groups // shards)).cast("int")


def subtask_ranges(spark: SparkSession, groups: int, parallelism: int) -> DataFrame:
    """One row (subtask, lo, hi) per subtask; inclusive ranges that tile 0..groups-1."""
    check_parallelism(groups, parallelism)
    ids = spark.range(parallelism, numPartitions=1).select(F.col("id").cast("int").alias("subtask"))
    return ids.select(
        "subtask",
        range_lo(F.col("subtask"), groups, parallelism).alias("lo"),
        range_hi(F.col("subtask"), groups, parallelism).alias("hi"),
    )


def expand_groups(ranges: DataFrame) -> DataFrame:
    """One row per key group of every inclusive ``[lo, hi]`` range.

    Turns range overlap into equality on ``key_group``. At most 32,768 rows per set of tiling ranges.
    """
    return ranges.select("*", F.explode(F.sequence("lo", "hi")).alias("key_group"))


def group_width(groups: int) -> int:
    """Bytes of the group prefix."""
    return 1 if groups <= 128 else 2


def encoded_key(
    group: Column | str,
    key: Column | str,
    groups: int = GROUPS,
    state_id: str = "",
    namespace: Column | None = None,
) -> Column:
    """Binary key ``[group, big-endian][state id][key][namespace]``; byte order equals (group, key) order."""
    check_groups(groups)
    group = F.col(group) if isinstance(group, str) else group
    key = F.col(key) if isinstance(key, str) else key
    prefix = F.unhex(F.lpad(F.hex(group), 2 * group_width(groups), "0"))
    parts = [prefix, F.lit(state_id).cast("binary"), key.cast("string").cast("binary")]
    if namespace is not None:
        parts.append(namespace.cast("string").cast("binary"))
    return F.concat(*parts)


def fixed_width(prefix: str, number: Column, digits: int) -> Column:
    """Text key whose text order is the numeric order, such as ``key-000042``."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), digits, "0"))


def checkpoint_number(name: str) -> Column:
    """The number N of a checkpoint called ``chk-N``, null for other names."""
    return F.regexp_extract(name, r"^chk-([0-9]{1,18})$", 1).try_cast("long")


def format_handle(db_id: Column, checkpoint_id: Column, lo: Column, hi: Column) -> Column:
    """State handle as text ``db|checkpoint|lo|hi``."""
    return F.concat_ws("|", db_id, checkpoint_id, lo.cast("string"), hi.cast("string"))


def parse_handle(handle: Column) -> Column:
    """Inverse of :func:`format_handle`; the database name may itself hold ``|``."""
    parts = F.split(handle, r"\|")
    n = F.size(parts)
    return F.struct(
        F.array_join(F.slice(parts, 1, n - 3), "|").alias("db_id"),
        F.element_at(parts, n - 2).alias("checkpoint_id"),
        F.element_at(parts, n - 1).cast("int").alias("lo"),
        F.element_at(parts, n).cast("int").alias("hi"),
    )
