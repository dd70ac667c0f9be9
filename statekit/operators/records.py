"""Read-modify-write of nested records: add to a number, append to a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statekit.operators import chunks


def record_rmw(updates: DataFrame, key: str = "key", amount: str = "amount", tag: str = "tag", seq: str = "seq") -> DataFrame:
    """Record after all updates: balance, number of tags, first and last tag, all with map-side combine.

    The tag list itself may be as long as the input; :func:`record_tags` gives it in long form.
    """
    return updates.groupBy(key).agg(
        F.sum(amount).alias("balance"),
        F.count(tag).alias("tags"),
        F.min_by(tag, seq).alias("first_tag"),
        F.max_by(tag, seq).alias("last_tag"),
    )


def record_tags(updates: DataFrame, key: str = "key", tag: str = "tag", seq: str = "seq") -> DataFrame:
    """The appended list, one row per element with its position; a list of any length fits."""
    return chunks.running_sum(
        updates.select(key, seq, tag), [key], seq, {"pos": F.lit(1).cast("bigint")}
    ).select(key, "pos", tag)


def apply_updates(state: DataFrame, updates: DataFrame, key: str = "key") -> DataFrame:
    """Stored ``record STRUCT<balance, owner, tags>`` plus a batch of ``(key, amount, tag, seq)`` updates.

    The batch is added up per key before it meets the state. Its tags become one array per key, which
    suits a micro-batch; rebuild a whole history with :func:`record_rmw` and :func:`record_tags`.
    """
    batch = updates.groupBy(key).agg(
        F.sum("amount").alias("_add"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "tag"))), lambda s: s["tag"]).alias("_tags"),
    )
    none = F.array().cast("array<string>")
    record = F.struct(
        (F.coalesce("record.balance", F.lit(0)) + F.coalesce("_add", F.lit(0))).cast("bigint").alias("balance"),
        F.col("record.owner").alias("owner"),
        F.concat(F.coalesce("record.tags", none), F.coalesce("_tags", none)).alias("tags"),
    )
    return state.join(batch, key, "full").select(key, record.alias("record"))


def record(balance: Column, owner: Column, *tags: Column) -> Column:
    return F.struct(
        balance.cast("bigint").alias("balance"), owner.alias("owner"), F.array(*tags).alias("tags")
    )


def appended(tags: str, tag: Column) -> Column:
    """A list with one element more; a null list counts as an empty one."""
    return F.array_append(F.coalesce(F.col(tags), F.array().cast("array<string>")), tag)
