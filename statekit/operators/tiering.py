"""Hot and cold tiers by event time, over tables.

A key that nobody touches for ``window_ms`` is demoted to the cold tier and promoted again by its
next touch. Two clocks decide whether the demotion came before that touch:

- ``gap``: only the key's own times count: next touch - last touch > window;
- ``watermark``: the largest time of any earlier arrival, less 1 ms, had reached last touch + window.

Touches arrive in ``seq`` order. Counts are the same in both modes; the demotion trail may differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statekit.operators import chunks


def millis(ms: int) -> Column:
    return F.expr(f"INTERVAL '{ms // 1000}.{ms % 1000:03d}' SECOND")


def with_last_touch(events: DataFrame, key: str = "key", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Add ``prev_ts``, the time of the key's touch before this one."""
    return chunks.previous(events, [key], seq, {"prev_ts": F.col(ts)})


def touch_gaps(events: DataFrame, window_ms: int, key: str = "key", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Per touch: the touch before it, the gap in microseconds and whether the key had been demoted."""
    touched = with_last_touch(events, key, ts, seq)
    return touched.withColumn("gap_us", F.timestamp_diff("MICROSECOND", "prev_ts", ts)).withColumn(
        "promoted", F.coalesce(F.col(ts) > F.col("prev_ts") + millis(window_ms), F.lit(False))
    )


def trail(
    events: DataFrame, window_ms: int, mode: str = "gap", key: str = "key", ts: str = "ts", seq: str = "seq"
) -> DataFrame:
    """Add ``prev_ts`` and ``promoted`` to every touch, in the given mode."""
    if mode == "gap":
        return touch_gaps(events, window_ms, key, ts, seq).drop("gap_us")
    if mode != "watermark":
        raise ValueError(f"tiering mode must be gap or watermark, got {mode!r}")
    clock = chunks.earlier_max(
        with_last_touch(events, key, ts, seq), [], seq, {"_seen": F.col(ts)}, base=events
    )
    reached = F.col("_seen") - millis(1) >= F.col("prev_ts") + millis(window_ms)
    return clock.withColumn("promoted", F.coalesce(reached, F.lit(False))).drop("_seen")


def tier_batch(
    events: DataFrame, window_ms: int, mode: str = "gap", key: str = "key", ts: str = "ts", seq: str = "seq"
) -> DataFrame:
    """Per key: touches, promotions and demotions; after the last event every key is demoted."""
    marked = trail(events, window_ms, mode, key, ts, seq)
    promoted = F.count(F.when(F.col("promoted"), 1))
    return marked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), promoted.alias("promotions"), (promoted + 1).alias("demotions")
    )


def demotions(events: DataFrame, window_ms: int, key: str = "key", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """(key, demote_ts) of every demotion in gap mode: last touch + window."""
    marked = trail(events, window_ms, "gap", key, ts, seq)
    between = marked.where("promoted").select(key, F.col("prev_ts").alias("_last"))
    final = events.groupBy(key).agg(F.max_by(ts, seq).alias("_last"))
    return between.unionByName(final).select(key, (F.col("_last") + millis(window_ms)).alias("demote_ts"))


def demotion_buckets(demoted: DataFrame, bucket_s: int) -> DataFrame:
    """Demotions per timer bucket: one timer per bucket end instead of one per key."""
    start = F.window("demote_ts", f"{bucket_s} seconds")
    # A demotion that falls on a boundary fires with that boundary, not one bucket later.
    end = F.when(start["start"] == F.col("demote_ts"), start["start"]).otherwise(start["end"])
    return demoted.groupBy(end.alias("fire_ts")).agg(F.count(F.lit(1)).alias("keys"))


def hot_wins(hot: DataFrame, cold: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row per key: the hot value where there is one, else the cold one, however new that looks."""
    h = hot.select(key, F.struct(value).alias("_h"))
    c = cold.select(key, F.struct(value).alias("_c"))
    is_hot = F.col("_h").isNotNull()
    return h.join(c, key, "full").select(
        key,
        F.when(is_hot, F.col(f"_h.{value}")).otherwise(F.col(f"_c.{value}")).alias(value),
        F.when(is_hot, "hot").otherwise("cold").alias("tier"),
    )


def write_through(state: DataFrame, now: Column, ttl_ms: int, ts: str = "create_ts") -> DataFrame:
    """Every write goes to both tiers: cold keeps all, hot is what was written less than the TTL ago."""
    fresh = F.col(ts) + millis(ttl_ms) > now
    return state.withColumn("in_hot", fresh)


def by_tier(counts: DataFrame, last_touch: str, now: Column, window_ms: int) -> DataFrame:
    """Tier of every key at a moment."""
    hot = F.col(last_touch) + millis(window_ms) >= now
    return counts.withColumn("tier", F.when(hot, "hot").otherwise("cold"))
