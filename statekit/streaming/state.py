"""Stateful streaming operators.

Counters are Spark's own streaming aggregation, which combines rows before the shuffle. Where a
custom state is needed (timers, two tiers, expiry), the rows are first combined per Arrow batch, so
that a key holding a third of the stream reaches its state as a few rows, not as a third of them.
The processors are built inside functions so that they travel to the workers by value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType


def counter(stream: DataFrame, key: str = "key") -> DataFrame:
    """Running count per key, in update mode."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def adder(stream: DataFrame, key: str = "key", n: str = "n") -> DataFrame:
    """Running sum per key of rows that already carry counts: new records (1) and a seed from older state."""
    return stream.groupBy(key).agg(F.sum(n).alias("n"))


def combine(stream: DataFrame, key: str = "key", ts: str = "ts", n: str | None = None) -> DataFrame:
    """Touches ``(key, ts)`` as ``(key, n, last_ts, last_ms)``, one row per key and Arrow batch.

    Each row counts as one, or as the number in the column ``n``; a count of 0 only moves the clock.
    """

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grouped = pdf.groupby("key", sort=False, dropna=False)
            yield grouped.agg(n=("n", "sum"), last_ts=("ts", "max"), last_ms=("ms", "max")).reset_index()

    at = F.col(ts).cast("timestamp")
    count = F.lit(1) if n is None else F.col(n)
    touches = stream.select(F.col(key).alias("key"), count.cast("long").alias("n"), at.alias("ts"), F.unix_millis(at).alias("ms"))
    return touches.mapInPandas(shrink, "key string, n long, last_ts timestamp, last_ms long")


def touches(rows: DataFrame, key: Column, ts: str = "ts") -> DataFrame:
    """Touches from an ordered log: rows of another lap than 0 only move the clock."""
    counted = rows.select(key.alias("key"), F.col(ts).alias("ts"), F.when(F.col("lap") == 0, 1).otherwise(0).alias("n"))
    return combine(counted, n="n")


BUCKETS = 64


def in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))


def plain(column: pd.Series) -> list:
    """Values of a pandas column, nulls as None."""
    return column.astype(object).where(column.notna(), None).tolist()


def seeded_counter(combined: DataFrame, seed: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Counter over combined touches with state of its own, which a seed ``(key, n)`` may preload.

    Keys share ``buckets`` groups, so that a call of the state moves many keys; the number is fixed by a query's first batch.
    """

    class Counter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.n = handle.getValueState("n", "key array<string>, n array<bigint>")

        def held(self) -> dict:
            held = self.n.get()
            return dict(zip(*held, strict=True)) if held else {}

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            held, touched = self.held(), {}
            for pdf in rows:
                for k, n in zip(plain(pdf["key"]), plain(pdf["n"]), strict=True):
                    held[k] = touched[k] = held.get(k, 0) + int(n)
            self.n.update((list(held), list(held.values())))
            yield pd.DataFrame({"key": pd.Series(list(touched), dtype=object), "n": list(touched.values())})

        def handleInitialState(self, key, initialState, timerValues) -> None:
            held = self.held()
            held.update(zip(plain(initialState["key"]), map(int, initialState["n"]), strict=True))
            self.n.update((list(held), list(held.values())))

        def close(self) -> None:
            pass

    return in_buckets(combined.select("key", "n"), buckets).groupBy("bucket").transformWithStateInPandas(
        Counter(),
        outputStructType="key string, n long",
        outputMode="Update",
        timeMode="None",
        initialState=None if seed is None else in_buckets(seed, buckets).groupBy("bucket"),
    )


def tier_seed(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Both tiers of a finished query, as its state reader gives them, as a seed ``(key, hot, last_ms, cold)``."""
    h = hot.select(F.col("key.key").alias("key"), F.col("value.n").alias("hot"), F.col("value.last_ms").alias("last_ms"), F.lit(None).cast("long").alias("cold"))
    c = cold.select(F.col("key.key").alias("key"), F.lit(None).cast("long").alias("hot"), F.lit(None).cast("long").alias("last_ms"), F.col("value.n").alias("cold"))
    return h.unionByName(c).groupBy("key").agg(*[F.max(x).alias(x) for x in ("hot", "last_ms", "cold")])


def tiers(combined: DataFrame, window_ms: int, delay: str = "0 seconds", seed: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Hot and cold state per key by event time, from :func:`combine`.

    A touch arms a timer at its time + window. When the watermark passes it and the key was not
    touched since, the count goes to the cold state first and the hot state is cleared after. A touch
    that finds no hot state takes the count up from the cold one. Emits ``(key, what, n, at_ms)`` with
    ``what`` one of touch, promote, demote. Rows with a count of 0 change nothing but the watermark.

    A ``seed`` (:func:`tier_seed`) brings in the tiers of another query; the timers of hot keys are armed again.

    Keys share ``buckets`` groups, so that a call of the state moves many keys; the number is fixed by a query's first batch.
    A bucket holds one timer, at the time its first key falls due.
    """

    class Tiers(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.hot = handle.getValueState("hot", "key array<string>, n array<bigint>, last_ms array<bigint>, due_ms array<bigint>")
            self.cold = handle.getValueState("cold", "key array<string>, n array<bigint>")
            self.timer = handle.getValueState("timer", "at_ms long")

        def keep(self, hot: dict, fired: int | None = None) -> None:
            n, last = [x[0] for x in hot.values()], [x[1] for x in hot.values()]
            self.hot.update((list(hot), n, last, [x + window_ms for x in last]))
            held, due = self.timer.get(), min(last, default=None)
            if held and held[0] not in (fired, None if due is None else due + window_ms):
                self.handle.deleteTimer(held[0])
            if due is None:
                self.timer.clear()
            elif held is None or held[0] != due + window_ms:
                self.handle.registerTimer(due + window_ms)
                self.timer.update((due + window_ms,))

        def held_hot(self) -> dict:
            held = self.hot.get()
            return dict(zip(held[0], zip(held[1], held[2], strict=True), strict=True)) if held else {}

        def held_cold(self) -> dict:
            held = self.cold.get()
            return dict(zip(*held, strict=True)) if held else {}

        def trail(self, rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["key", "what", "n", "at_ms"])

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            new: dict = {}
            for pdf in rows:
                pdf = pdf[(pdf["n"] > 0) & pdf["last_ms"].notna()]
                for k, n, ms in zip(plain(pdf["key"]), plain(pdf["n"]), plain(pdf["last_ms"]), strict=True):
                    had, at = new.get(k, (0, ms))
                    new[k] = (had + int(n), max(at, int(ms)))
            if not new:
                return
            hot, cold, out = self.held_hot(), None, []
            for k, (add, last) in new.items():
                if k in hot:
                    before, at = hot[k]
                    last = max(last, at)
                else:
                    cold = self.held_cold() if cold is None else cold
                    before = cold.get(k, 0)
                    if k in cold:
                        out.append((k, "promote", before, last))
                hot[k] = (before + add, last)
                out.append((k, "touch", before + add, last))
            self.keep(hot)
            yield self.trail(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            fired, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
            hot = self.held_hot()
            gone = [k for k, (_, last) in hot.items() if last + window_ms <= fired or last + window_ms < mark]
            if gone:
                cold = {**self.held_cold(), **{k: hot[k][0] for k in gone}}
                self.cold.update((list(cold), list(cold.values())))
                yield self.trail([(k, "demote", hot[k][0], hot[k][1] + window_ms) for k in gone])
            left = set(gone)
            self.keep({k: x for k, x in hot.items() if k not in left}, fired)

        def handleInitialState(self, key, initialState, timerValues) -> None:
            hot, cold = self.held_hot(), self.held_cold()
            columns = [plain(initialState[c]) for c in ("key", "hot", "last_ms", "cold")]
            for k, n, last, before in zip(*columns, strict=True):
                if before is not None:
                    cold[k] = int(before)
                if n is not None:
                    hot[k] = (int(n), int(last))
            if cold:
                self.cold.update((list(cold), list(cold.values())))
            if hot:
                self.keep(hot)

        def close(self) -> None:
            pass

    clocked = in_buckets(combined.withWatermark("last_ts", delay), buckets)
    return clocked.groupBy("bucket").transformWithStateInPandas(
        Tiers(),
        outputStructType="key string, what string, n long, at_ms long",
        outputMode="Update",
        timeMode="EventTime",
        initialState=None if seed is None else in_buckets(seed, buckets).groupBy("bucket"),
    )


def expiring(combined: DataFrame, ttl_ms: int) -> DataFrame:
    """Two counters per key, one whose state expires ``ttl_ms`` after its last write (wall clock) and
    one that stays; emits what each of them held before and after the rows."""

    class Expiring(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.short = handle.getValueState("short", "n long", ttlDurationMs=ttl_ms)
            self.kept = handle.getValueState("kept", "n long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            add = sum(row.n for row in rows)
            short, kept = self.short.get(), self.kept.get()
            s, k = (short[0] if short else 0), (kept[0] if kept else 0)
            self.short.update((s + add,))
            self.kept.update((k + add,))
            yield Row(key=key[0], short_before=s, kept_before=k, short=s + add, kept=k + add)

        def close(self) -> None:
            pass

    return combined.select("key", "n").groupBy("key").transformWithState(
        Expiring(),
        outputStructType="key string, short_before long, kept_before long, short long, kept long",
        outputMode="Update",
        timeMode="ProcessingTime",
    )


def dedupe(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each record once, as long as its copies come within ``delay`` of event time."""
    clocked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return clocked.dropDuplicatesWithinWatermark(keys)


def enrich(stream: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Stream-static lookup; an absent key gives null. Only the table may be large: it is read per batch."""
    return stream.join(table, on, "left")


def enrich_batches(
    df: DataFrame, lookup: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Lookups in an outside service, one call per Arrow batch; only for reads, never for read-modify-write."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield lookup(pdf)

    return df.mapInPandas(call, schema)


def set_operands(ops: DataFrame, element: Column) -> DataFrame:
    """Log rows as operands of a set ``(db_id, key, element, seq, base)``, combined per Arrow batch.

    A put or merge adds its element at its position; a put or delete first clears what came before, which is a row of its
    own with the position in ``base``. A null element is none.
    """

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            adds = pdf[pdf["adds"] & pdf["element"].notna()].groupby(["db_id", "key", "element"], sort=False, dropna=False)["seq"].max().reset_index()
            bases = pdf[pdf["clears"]].groupby(["db_id", "key"], sort=False, dropna=False)["seq"].max().reset_index(name="base")
            out = pd.concat([adds, bases]).reindex(columns=["db_id", "key", "element", "seq", "base"])
            yield out.astype({"seq": "Int64", "base": "Int64"})

    rows = ops.where("op <> 'get'").select(
        "db_id", "key", element.cast("string").alias("element"), "seq", F.col("op").isin("put", "merge").alias("adds"), F.col("op").isin("put", "delete").alias("clears")
    )
    return rows.mapInPandas(shrink, "db_id string, key string, element string, seq long, base long")


def live_set(operands: DataFrame, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The set of every key as stream state, from :func:`set_operands`: one entry per element, so no set must fit in a row.

    An element lives while its newest position is not before the key's newest base, so rows may come in any order and any
    number of times. With ``ttl_ms`` an element goes that long after its last write (wall clock), each by itself. Emits
    ``(db_id, key, element, live)`` for elements that come and go; the state reader shows the sets (``elements``). Keys share
    ``buckets`` groups, fixed by a query's first batch: a group's entries are read together, and only those that change written.
    """

    class LiveSet(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.base = handle.getValueState("base", "db_id array<string>, key array<string>, seq array<bigint>")
            self.elements = handle.getMapState("elements", "db_id string, key string, element string", "seq long", ttlDurationMs=ttl_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            held = self.base.get()
            before = dict(zip(zip(held[0], held[1], strict=True), held[2], strict=True)) if held else {}
            base, newest = dict(before), {}
            for pdf in rows:
                columns = [plain(pdf[c]) for c in ("db_id", "key", "element", "seq", "base")]
                for d, k, element, seq, cleared in zip(*columns, strict=True):
                    if cleared is not None:
                        base[d, k] = max(int(cleared), base.get((d, k), int(cleared)))
                    else:
                        newest[d, k, element] = max(int(seq), newest.get((d, k, element), int(seq)))
            if base != before:
                self.base.update(([x[0] for x in base], [x[1] for x in base], list(base.values())))
            out, known = [], {tuple(e): at[0] for e, at in self.elements.iterator()}
            moved = {x for x, at in base.items() if before.get(x) != at}
            for e, at in known.items():
                if e[:2] in moved and max(at, newest.get(e, at)) < base[e[:2]]:
                    self.elements.removeKey(e)
                    out.append((*e, False))
            for e, seq in newest.items():
                if seq < base.get(e[:2], seq):
                    continue
                if e not in known or known[e] < seq:
                    self.elements.updateValue(e, (seq,))
                if e not in known:
                    out.append((*e, True))
            yield pd.DataFrame(out, columns=["db_id", "key", "element", "live"])

        def close(self) -> None:
            pass

    numbers = {c: F.col(c).cast("string") for c in ("seq", "base")}  # pandas turns whole numbers beside nulls into floats
    grouped = operands.withColumns(numbers).withColumn("bucket", F.pmod(F.xxhash64("db_id", "key"), F.lit(buckets)))
    return grouped.groupBy("bucket").transformWithStateInPandas(
        LiveSet(),
        outputStructType="db_id string, key string, element string, live boolean",
        outputMode="Update",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )


SHARD_WIDTH = 1 << 16


def seen_once(stream: DataFrame, columns: list[str], width: int = SHARD_WIDTH) -> DataFrame:
    """Each position ``(db_id, seq)`` once, however far apart its copies arrive: no clock and no delay to be set.

    The state of a shard of ``width`` neighbouring positions is the set of intervals that have been seen, so a shard that is
    complete takes one interval and any other one more for each gap. They are one row of arrays, read and written by one call
    each and bounded by ``width``. Shards are cut by position, so a hot key is spread over them.
    ``columns`` come out; a row without a position has no copies and passes.
    """
    import numpy as np

    def merged(lo, hi, seqs):
        lo, hi = np.concatenate([lo, seqs]), np.concatenate([hi, seqs])
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
        first = np.ones(len(lo), bool)
        first[1:] = lo[1:] > hi[:-1] + 1
        starts = np.flatnonzero(first)
        return lo[starts], hi[np.r_[starts[1:] - 1, len(lo) - 1]] if len(lo) else hi

    class SeenOnce(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.spans = handle.getValueState("spans", "lo array<bigint>, hi array<bigint>")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            if not key[1]:
                for pdf in rows:
                    yield pdf[columns]
                return
            held = self.spans.get() or ([], [])
            lo, hi = (np.array(x, np.int64) for x in held)
            before = lo, hi
            for pdf in rows:
                pdf = pdf.drop_duplicates("place")
                seqs = pdf["place"].to_numpy(np.int64)
                at = np.searchsorted(lo, seqs, "right") - 1
                known = at >= 0
                known[known] = seqs[known] <= hi[at[known]]
                lo, hi = merged(lo, hi, seqs[~known])
                yield pdf[~known][columns]
            if not (np.array_equal(lo, before[0]) and np.array_equal(hi, before[1])):
                self.spans.update((lo.tolist(), hi.tolist()))

        def close(self) -> None:
            pass

    # pandas turns whole numbers beside nulls into floats, in keys too: keys are never null, other columns travel as text.
    kinds = stream.select(*columns).schema
    text = {f.name: F.col(f.name).cast("string") for f in kinds if isinstance(f.dataType, IntegralType)}
    schema = ", ".join(f"`{f.name}` {'string' if f.name in text else f.dataType.simpleString()}" for f in kinds)
    placed = stream.select("*", F.col("seq").isNotNull().alias("placed"), F.coalesce("seq", F.lit(0)).cast("long").alias("place"))
    sharded = placed.withColumns(text).withColumn("shard", F.floor(F.col("place") / width)).select("db_id", "placed", "shard", "place", *[c for c in columns if c != "db_id"])
    once = sharded.groupBy("db_id", "placed", "shard").transformWithStateInPandas(SeenOnce(), outputStructType=schema, outputMode="Append", timeMode="None")
    return once.withColumns({c: F.col(c).cast(kinds[c].dataType) for c in text})
