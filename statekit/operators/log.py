"""Change logs: newest value, folds, points in time, fencing, expiry, replay.

A change log has the columns ``db_id, key, op, value, seq, writer_epoch, create_ts, expire_ts``;
``op`` is put, delete, merge or get (a get is a read and changes nothing). ``(db_id, key, seq)``
is unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FractionalType, IntegralType, LongType

from statekit.operators import chunks
from statekit.session import durable

KEYS = ["db_id", "key"]
STATE = ["db_id", "key", "value", "seq", "create_ts", "expire_ts"]


def is_base() -> Column:
    """A put or delete: it settles the value whatever came before."""
    return F.col("op").isin("put", "delete")


def duplicate_positions(changelog: DataFrame) -> DataFrame:
    """Positions that a key uses more than once; the other operators rely on there being none."""
    used = changelog.groupBy(*KEYS, "seq").agg(F.count(F.lit(1)).alias("rows"))
    return used.where("rows > 1")


def checkpoint(
    changelog: DataFrame, checkpoint_id: str, flushed: Column | None = None, expire_ts: Column | None = None
) -> DataFrame:
    """Pin the log as it is: one row per database with the newest durable and the newest flushed position.

    ``flushed`` is the position up to which the manifest has caught up (default: all of it).
    """
    hi = F.max("seq")
    return changelog.groupBy("db_id").agg(
        F.lit(checkpoint_id).alias("checkpoint_id"),
        hi.alias("seq_hi"),
        F.least(hi, hi if flushed is None else flushed).alias("manifest_seq_hi"),
        F.max("create_ts").alias("create_ts"),
        (F.lit(None).cast("timestamp_ntz") if expire_ts is None else expire_ts).alias("expire_ts"),
    )


def upto(changelog: DataFrame, seq_hi: Column | int) -> DataFrame:
    """The log as a checkpoint at ``seq_hi`` saw it; a plain filter, so it reaches the scan."""
    return changelog.where(F.col("seq") <= seq_hi)


def latest(changelog: DataFrame) -> DataFrame:
    """Newest put per key; a newer delete hides the key, merges are left out.

    One aggregation with map-side combine, so a hot key shrinks to a row per task before the shuffle.
    """
    newest = (
        changelog.where(is_base())
        .groupBy(*KEYS)
        .agg(
            F.max_by(F.col("op") == "put", "seq").alias("_live"),
            F.max_by("value", "seq").alias("value"),
            F.max("seq").alias("_seq"),
            F.max_by("create_ts", "seq").alias("create_ts"),
            F.max_by("expire_ts", "seq").alias("expire_ts"),
        )
    )
    return newest.where("_live").withColumnRenamed("_seq", "seq").select(*STATE)


def resolve(
    changelog: DataFrame, as_of: Column | int | None = None, now: Column | None = None, ttl: str = "lazy"
) -> DataFrame:
    """State at a point of the log, with expired rows hidden or (``lazy``) still shown."""
    if as_of is not None:
        changelog = upto(changelog, as_of)
    return ttl_view(latest(changelog), now, ttl)


def ttl_view(state: DataFrame, now: Column | None, mode: str) -> DataFrame:
    """``read_filter`` hides rows with ``expire_ts <= now``; ``lazy`` leaves them until compaction."""
    if mode not in ("read_filter", "lazy"):
        raise ValueError(f"ttl mode must be read_filter or lazy, got {mode!r}")
    if mode == "lazy" or now is None:
        return state
    return state.where(F.col("expire_ts").isNull() | (F.col("expire_ts") > now))


def with_expiry(changelog: DataFrame, ttl_ms: Column, default_ms: int | None = None) -> DataFrame:
    """Set ``expire_ts`` from a per-row TTL; null takes the table default, a negative TTL never expires."""
    ms = F.coalesce(ttl_ms, F.lit(default_ms).cast("bigint"))
    due = F.col("create_ts") + F.make_dt_interval(secs=ms / F.lit(1000))
    return changelog.withColumn("expire_ts", F.when(ms >= 0, due))


def after_base(changelog: DataFrame) -> DataFrame:
    """Puts and merges that still count: those since the key's last put or delete.

    Adds ``base_seq``, the sequence number of that put or delete (null when there is none).
    """
    writes = changelog.where(F.col("op") != "get")
    based = chunks.key_max(writes, KEYS, "seq", {"base_seq": F.when(is_base(), F.col("seq"))})
    return based.where(
        (F.col("op") != "delete")
        & (F.col("base_seq").isNull() | (F.col("seq") >= F.col("base_seq")))
    )


def fold(changelog: DataFrame) -> DataFrame:
    """Value per key with merge operands added up: a put resets, a delete clears to zero.

    ``value`` is the base plus the sum of the operands after it, ``merges`` their number.
    """
    merge = F.col("op") == "merge"
    return (
        after_base(changelog)
        .groupBy(*KEYS)
        .agg(
            F.sum("value").alias("value"),
            F.count(F.when(merge, 1)).alias("merges"),
            F.max("seq").alias("seq"),
        )
    )


def sum_type(changelog: DataFrame) -> DataType:
    """Type of a sum of the log's values: as exact as the values themselves, and wide enough to go on adding."""
    kind = changelog.schema["value"].dataType
    if isinstance(kind, DecimalType):
        return DecimalType(min(38, kind.precision + (10 if kind.precision <= 18 else 0)), kind.scale)
    return LongType() if isinstance(kind, IntegralType) else DoubleType() if isinstance(kind, FractionalType) else kind


def squash(changelog: DataFrame) -> DataFrame:
    """A shorter log with the same fold: per key at most its last put or delete and one summed merge.

    Suits a part of a log that is kept only to be folded later; ``merges`` says how many operands a merge row
    stands for. The parts must not overlap in ``seq`` for any key: a put or delete of one part between two
    merges of another could not be placed any more.
    """
    writes = changelog.where(F.col("op") != "get")
    based = chunks.key_max(writes, KEYS, "seq", {"base_seq": F.when(is_base(), F.col("seq"))})
    merge = F.col("op") == "merge"
    total = sum_type(changelog)
    at_base = F.col("seq") == F.col("base_seq")
    counts = F.col("merges") if "merges" in changelog.columns else F.lit(1).cast("bigint")
    kept = (
        based.where(F.col("base_seq").isNull() | (F.col("seq") >= F.col("base_seq")))
        .groupBy(*KEYS)
        .agg(
            F.max("base_seq").alias("_bs"),
            F.max(F.when(at_base, F.col("op"))).alias("_op"),
            F.max(F.when(at_base, F.col("value"))).alias("_v"),
            F.sum(F.when(merge, F.col("value"))).cast(total).alias("_mv"),
            F.sum(F.when(merge, counts)).alias("_mn"),
            F.max(F.when(merge, F.col("seq"))).alias("_ms"),
        )
    )
    base = F.struct(
        F.col("_op").alias("op"), F.col("_v").cast(total).alias("value"), F.col("_bs").alias("seq"), F.lit(0).cast("bigint").alias("merges")
    )
    tail = F.struct(
        F.lit("merge").alias("op"), F.col("_mv").alias("value"), F.col("_ms").alias("seq"), F.col("_mn").alias("merges")
    )
    rows = F.filter(F.array(base, tail), lambda r: r["seq"].isNotNull())
    return kept.select(*KEYS, F.inline(rows))


def fold_squashed(log: DataFrame) -> DataFrame:
    """Fold a union of squashed logs; equal to folding the logs they came from."""
    return (
        after_base(log)
        .groupBy(*KEYS)
        .agg(F.sum("value").alias("value"), F.sum("merges").alias("merges"), F.max("seq").alias("seq"))
    )


def fold_with(changelog: DataFrame, fold: Callable[[pd.Series], float]) -> DataFrame:
    """User-defined merge of the values that still count; ``fold`` must be associative and commutative.

    Folded per Arrow batch before the shuffle, so a hot key travels as a few rows. Behind it the rows
    come sorted by key and are folded as they stream past, one open key at a time: no group is
    ever held in memory. Use :func:`fold` where a built-in sum will do.
    """
    schema = "db_id string, key string, value double"

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.groupby(KEYS, sort=False, dropna=False)["value"].agg(fold).reset_index()

    def sorted_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key = None
        for pdf in batches:
            if open_key is not None:
                pdf = pd.concat([open_key, pdf], ignore_index=True)
            done = pdf.groupby(KEYS, sort=False, dropna=False)["value"].agg(fold).reset_index()
            # The last key may go on in the next batch.
            yield done.iloc[:-1]
            open_key = done.iloc[-1:]
        if open_key is not None:
            yield open_key

    rows = after_base(changelog).select(*KEYS, F.col("value").cast("double").alias("value"))
    partial = rows.mapInPandas(per_batch, schema)
    return partial.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInPandas(sorted_stream, schema)


def newest_first(rows: DataFrame, level: str) -> DataFrame:
    """First hit over layers: the lowest ``level`` (0 = newest layer) wins, then the highest ``seq``."""
    per_level = (
        rows.where(is_base())
        .groupBy(*KEYS, level)
        .agg(
            F.max_by(F.col("op") == "put", "seq").alias("_live"),
            F.max_by("value", "seq").alias("_value"),
            F.max("seq").alias("_seq"),
        )
    )
    newest = -F.col(level)
    won = per_level.groupBy(*KEYS).agg(
        F.max_by("_live", newest).alias("_live"),
        F.max_by("_value", newest).alias("value"),
        F.max_by("_seq", newest).alias("seq"),
        F.min(level).alias(level),
    )
    return won.where("_live").drop("_live")


def fold_set(changelog: DataFrame, element: Column) -> DataFrame:
    """Set-union merge in long form: one row per key and element, so no set must fit in a task."""
    return after_base(changelog).select(*KEYS, element.alias("element")).distinct()


def fold_into(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Fold new log rows into a folded state; ``delta`` must start after the state's last row."""
    stored = state.select(*KEYS, F.lit("put").alias("op"), "value", "seq")
    news = delta.select(*KEYS, "op", "value", "seq")
    carried = state.select(*KEYS, F.col("merges").alias("_m"), F.col("seq").alias("_s"))
    based = after_base(stored.unionByName(news)).join(carried, KEYS, "left")
    merge = F.col("op") == "merge"
    kept = (F.col("seq") == F.col("_s")) & (F.col("op") == "put")
    return based.groupBy(*KEYS).agg(
        F.sum(F.col("value")).cast(sum_type(delta)).alias("value"),
        (F.count(F.when(merge, 1)) + F.coalesce(F.max(F.when(kept, F.col("_m"))), F.lit(0))).alias("merges"),
        F.max("seq").alias("seq"),
    )


def read_your_writes(oplog: DataFrame) -> DataFrame:
    """Answer every ``get`` of a log with the last put before it: null after a delete or if never written."""
    last = {"_put": F.col("op") == "put", "_value": F.col("value")}
    seen = chunks.previous(oplog, KEYS, "seq", last, when=is_base())
    return seen.where(F.col("op") == "get").select(
        *KEYS, "seq", F.when(F.col("_put"), F.col("_value")).alias("value")
    )


def running_count(df: DataFrame, keys: list[str], seq: str = "seq", out: str = "n") -> DataFrame:
    """Number each row of its key in order: the trail of a per-key counter."""
    return chunks.running_sum(df, keys, seq, {out: F.lit(1).cast("bigint")})


def asof_read(
    lookups: DataFrame,
    changelog: DataFrame,
    at: str = "at_seq",
    unique: bool = False,
    spec: chunks.ChunkSpec | None = None,
) -> DataFrame:
    """Value of a key as of a log position, per lookup row ``(db_id, key, at_seq, ...)``.

    ``unique`` promises that no two lookups ask for the same key and position; they then travel
    through one shuffle together with the log. Otherwise equal lookups are answered once, so that
    many of them on one key at one position cannot crowd a task, and the answers are joined back.
    """
    asked = lookups if unique else lookups.select(*KEYS, at).distinct()
    others = [c for c in asked.columns if c not in (*KEYS, at)]
    mark = [*KEYS, F.col(at).alias("seq"), F.lit(1).alias("_side"), *others]
    marks = asked.select(*mark)
    writes = changelog.where(is_base()).select(
        *KEYS, "seq", F.lit(0).alias("_side"), (F.col("op") == "put").alias("_live"), F.col("value").alias("_val")
    )
    both = writes.unionByName(marks, allowMissingColumns=True)
    # Which keys are hot can be told before equal lookups are made one, straight from the scans.
    scanned = writes.unionByName(lookups.select(*mark), allowMissingColumns=True)
    last = {"_put": F.col("_live"), "_value": F.col("_val"), "_at": F.col("seq")}
    seen = chunks.previous(both, KEYS, "seq", last, when=F.col("_side") == 0, tie="_side", spec=spec, base=scanned)
    seen = seen.where("_side = 1")
    answers = seen.select(
        *KEYS,
        F.col("seq").alias(at),
        *others,
        F.when(F.col("_put"), F.col("_value")).alias("value"),
        F.when(F.col("_put"), F.col("_at")).alias("value_seq"),
    )
    return answers if unique else chunks.key_join(lookups, answers, [*KEYS, at], "left")


def asof_time(
    lookups: DataFrame, changelog: DataFrame, at: str = "at_ts", unique: bool = False, chunk_s: int = 3600
) -> DataFrame:
    """Value of a key as of a time, inclusive; of several writes at one time the last one counts.

    The order is the time in microseconds. A hot key is cut into chunks of ``chunk_s`` seconds, so a
    task sorts what one key wrote and was asked in that long.
    """
    base = chunks.ChunkSpec.of(changelog.sparkSession)
    spec = chunks.ChunkSpec(chunk_s * 1_000_000, base.sample, base.width)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    one = (
        changelog.where(is_base())
        .groupBy(*KEYS, micros("create_ts").alias("_us"))
        .agg(F.max_by(F.col("op") == "put", "seq").alias("_p"), F.max_by("value", "seq").alias("value"))
    )
    timed = one.select(*KEYS, F.when(F.col("_p"), "put").otherwise("delete").alias("op"), "value", F.col("_us").alias("seq"))
    asked = lookups.withColumn("_at", micros(at))
    return asof_read(asked, timed, "_at", unique, spec).drop("_at", "value_seq")


def fence(changelog: DataFrame) -> DataFrame:
    """Add ``accepted``: false for a write of a writer epoch after a newer epoch has written.

    An epoch is closed by the first write of any newer epoch of its database; a null epoch is older than
    all others. There is one row per database and epoch, so that the log itself is only joined.
    """
    first = changelog.groupBy("db_id", "writer_epoch").agg(F.min("seq").alias("_first"))
    newer = Window.partitionBy("db_id").orderBy(F.asc_nulls_first("writer_epoch")).rowsBetween(1, Window.unboundedFollowing)
    closed = first.select("db_id", "writer_epoch", F.min("_first").over(newer).alias("_closed"))
    joined = chunks.key_join(changelog, closed, ["db_id", "writer_epoch"], "left")
    return joined.withColumn("accepted", F.col("_closed").isNull() | (F.col("seq") < F.col("_closed"))).select(*changelog.columns, "accepted")


def clone(changelog: DataFrame, manifest_seq_hi: Column | int, db_id: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """A new database from what a checkpoint caught, of all keys or of ``lo <= key < hi``.

    The clone has its own name, so that later rows of either database are no rows of the other.
    """
    rows = captured(changelog, manifest_seq_hi)
    rows = rows if lo is None else rows.where(F.col("key") >= lo)
    rows = rows if hi is None else rows.where(F.col("key") < hi)
    return rows.withColumn("db_id", F.lit(db_id))


def change_feed(changelog: DataFrame, seq_from: Column | int, seq_to: Column | int) -> DataFrame:
    """Log rows of an inclusive range of positions."""
    return changelog.where(F.col("seq").between(seq_from, seq_to))


def replay_dedupe(log: DataFrame, replay_after: Column | int) -> DataFrame:
    """Rows to apply on recovery: those after the captured position, each once."""
    return log.where(F.col("seq") > replay_after).dropDuplicates([*KEYS, "seq"])


def barrier_counts(df: DataFrame, stream: str, value: str, barrier: str, seq: str = "seq") -> DataFrame:
    """Counts per value at every in-band barrier of a stream.

    Rows ``(stream, epoch, value, n)``: ``n`` occurrences before the barrier that closes ``epoch``
    (1, 2, ...), given for the epochs in which the value occurred. Barriers are not counted, and
    neither are rows after the last barrier.
    """
    is_barrier = (F.col(value) == barrier).cast("int")
    cut = chunks.running_sum(
        df.select(stream, value, seq), [stream], seq, {"_b": is_barrier}
    )
    rows = cut.where(F.col(value) != barrier).select(
        stream, value, (F.coalesce("_b", F.lit(0)) + 1).alias("epoch")
    )
    per_epoch = rows.groupBy(stream, value, "epoch").agg(F.count(F.lit(1)).alias("_n"))
    barriers = df.where(F.col(value) == barrier).groupBy(stream).agg(F.count(F.lit(1)).alias("_last"))
    closed = per_epoch.join(barriers, stream).where(F.col("epoch") <= F.col("_last"))
    # Read several times below, so it is written once instead of being computed again each time.
    once = durable(df.sparkSession, closed.select(stream, value, "epoch", "_n"), "epochs")
    counted = chunks.running_sum(once, [stream, value], "epoch", {"n": F.col("_n")})
    return counted.select(stream, "epoch", value, "n")


def capture_report(rows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Durable is not captured: rows ``(db_id, i, seq)`` of a checkpoint that lie behind its flush point are lost."""
    caught = F.col("seq") <= F.col("manifest_seq_hi")
    marks = checkpoints.select("checkpoint_id", "db_id", "i", "manifest_seq_hi")
    return rows.join(marks, ["db_id", "i"]).groupBy("checkpoint_id", "db_id").agg(
        F.count(F.lit(1)).alias("durable_rows"),
        F.count(F.when(caught, 1)).alias("captured_rows"),
        F.count(F.when(~caught, 1)).alias("lost_rows"),
    )


def captured(changelog: DataFrame, manifest_seq_hi: Column | int) -> DataFrame:
    """What a checkpoint really holds: rows up to the last flush, not up to the last durable write."""
    return upto(changelog, manifest_seq_hi)


def newer_checkpoint(checkpoints: DataFrame, least: int) -> DataFrame:
    """Per checkpoint ``(checkpoint_id, db_id, i)``: the first newer one from ``least`` on, and the newest.

    The order is reversed so that "next" is "previous"; a database with very many checkpoints is
    cut into chunks like any other hot key.
    """
    back = checkpoints.select("checkpoint_id", "db_id", "i", (-F.col("i")).alias("_back"))
    ahead = chunks.previous(
        back, ["db_id"], "_back", {"next_i": F.when(F.col("i") >= least, F.col("i"))}, few_keys=True
    )
    newest = checkpoints.groupBy("db_id").agg(F.max("i").alias("newest_i"))
    return ahead.join(newest, "db_id").select("checkpoint_id", "i", "next_i", "newest_i")


def numbered(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints ``(checkpoint_id, number)`` of one database: is a name's place by text its place by number, and which
    one is the newest? One row per checkpoint, so one task sorts them."""
    by_number, by_text = Window.orderBy("number"), Window.orderBy("checkpoint_id")
    same = F.row_number().over(by_number) == F.row_number().over(by_text)
    newest = F.col("number") == F.max("number").over(Window.partitionBy())
    return checkpoints.select("checkpoint_id", "number", same.alias("same_as_text"), newest.alias("newest"))


def live_keys_at(changelog: DataFrame, checkpoints: DataFrame, every: int) -> DataFrame:
    """Live keys at each of the regular checkpoints ``(checkpoint_id, i, seq_hi)``, in one pass.

    A put of an absent key adds one and a delete of a present key takes one away; the changes are
    summed per checkpoint interval before they are added up over the checkpoints.
    """
    base = changelog.where(is_base()).select(*KEYS, "seq", "op")
    live = (F.col("op") == "put").cast("int")
    was = chunks.previous(base, KEYS, "seq", {"_p": live})
    before = F.coalesce("_p", F.lit(0))
    steps = was.groupBy("db_id", F.floor(F.col("seq") / every).cast("bigint").alias("i")).agg(
        F.sum(live - before).alias("_d")
    )
    joined = checkpoints.join(steps, ["db_id", "i"], "left").select(
        "checkpoint_id", "db_id", "i", "seq_hi", "_d"
    )
    total = chunks.running_sum(joined, ["db_id"], "i", {"live_keys": F.col("_d")}, few_keys=True)
    return total.select("checkpoint_id", "seq_hi", F.coalesce("live_keys", F.lit(0)).alias("live_keys"))


def drop_control(df: DataFrame, value: str, barrier: str) -> DataFrame:
    """Rows that are data, not in-band control records."""
    return df.where(F.col(value) != barrier)
