"""Sources, sinks and runs of streaming queries.

A run reads everything that is there (``availableNow``), commits offsets and state together in its
checkpoint folder, and writes each micro-batch under ``batch=<id>``, so that a batch repeated
after a failure replaces its own output.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import ArrayType, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_partitions(spark: SparkSession, rows: int, per_partition: int = 1 << 20) -> int:
    """State partitions for a stream of about so many rows, however many cores there are just now."""
    return max(min(2, spark.sparkContext.defaultParallelism), rows // per_partition)


def state_buckets(rows: int) -> int:
    """Groups of keys for a stream of about so many rows, so that the keys of one are some thousands."""
    return max(64, rows >> 14)


def stream_session(spark: SparkSession, partitions: int) -> SparkSession:
    """A session of the same application with its own settings for stateful queries.

    The number of state partitions is fixed by a query's first batch.
    """
    own = spark.newSession()
    for name, value in {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }.items():
        own.conf.set(name, value)
    for name in ("spark.statekit.chunk.width", "spark.statekit.chunk.sample"):
        if spark.conf.get(name, None):
            own.conf.set(name, spark.conf.get(name))
    return own


def stage(df: DataFrame, path: str, seq: str, lo: int, hi: int) -> None:
    """Append the rows with ``lo <= seq < hi`` to a source folder; later calls give later files."""
    df.where((F.col(seq) >= lo) & (F.col(seq) < hi)).write.mode("append").parquet(path)


def cuts(df: DataFrame, seq: str, parts: int) -> list[tuple[int, int]]:
    """``parts`` neighbouring ranges of ``seq`` that cover all rows."""
    row = df.agg(F.min(seq).alias("lo"), F.max(seq).alias("hi")).first()
    if row["lo"] is None:
        return []
    lo, width = row["lo"], -(-(row["hi"] - row["lo"] + 1) // parts)
    return [(lo + i * width, lo + (i + 1) * width) for i in range(parts)]


def row_cuts(df: DataFrame, seq: str, parts: int, most_rows: int = 100_000_000) -> list[tuple[int, int]]:
    """Neighbouring ranges of ``seq`` with about equal numbers of rows: ``parts`` of them, more if a range
    would hold over ``most_rows``."""
    row = df.agg(F.min(seq).alias("lo"), F.max(seq).alias("hi"), F.count(seq).alias("n")).first()
    if row["lo"] is None:
        return []
    parts = max(parts, -(-row["n"] // most_rows))
    inner = df.approxQuantile(seq, [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    edges = sorted({row["lo"], row["hi"] + 1, *(int(x) for x in inner)})
    return list(zip(edges[:-1], edges[1:], strict=True))


def replayable(spark: SparkSession, path: str, schema, per_batch: int | None = None, bytes_per_batch: int | None = None) -> DataFrame:
    """File stream that resumes after the last committed file; at most ``per_batch`` files, or about so many
    bytes, a batch. Files of one batch come in no order; see :mod:`statekit.streaming.ordered` where that matters."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", str(per_batch))
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", str(bytes_per_batch))
    return reader.parquet(path)


def event_time(stream: DataFrame, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """Watermark on an event time; a time without zone is read in the session zone (UTC)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def start(
    stream: DataFrame,
    checkpoint: str,
    each_batch: Callable[[DataFrame, int], None],
    mode: str = "update",
    to_end: bool = True,
) -> StreamingQuery:
    """Start a query; with ``to_end`` it ends when the input that is there now is processed."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each_batch)
    return (writer.trigger(availableNow=True) if to_end else writer.trigger(processingTime="0 seconds")).start()


def drain(query: StreamingQuery) -> StreamingQuery:
    """Wait until all input is processed and committed; a failure is raised with its cause."""
    query.awaitTermination()
    return query


def with_restarts(begin: Callable[[], StreamingQuery], restarts: int = 3) -> StreamingQuery:
    """Run to the end, starting again from the last commit after a failure."""
    for attempt in range(restarts + 1):
        try:
            return drain(begin())
        except StreamingQueryException:
            if attempt == restarts:
                raise
    raise AssertionError("unreachable")


def cause(failure: StreamingQueryException) -> str:
    """The message of the Python error that ended a query, without the layers around it."""
    errors = re.findall(r"^(?:\w+\.)*\w*(?:Error|Exception): (.*)$", str(failure), re.MULTILINE)
    return errors[-1] if errors else str(failure)


def batch_writer(path: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """Sink that may repeat a batch without doubling it."""

    def write(df: DataFrame, batch_id: int) -> None:
        out = shape(df) if shape else df
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def checkpoint_writer(data: str, checkpoints: str, db_id: str, seq: str = "seq") -> Callable[[DataFrame, int], None]:
    """Sink that follows every written batch with a checkpoint row ``(checkpoint_id, db_id, seq_hi, rows)``.

    The data goes first: a checkpoint never names rows that are not there. ``rows`` counts what the batch took
    from the source, which :func:`checkpoint_offsets` adds up to the position to go on from.
    """
    write, pin = batch_writer(data), batch_writer(checkpoints)

    def both(df: DataFrame, batch_id: int) -> None:
        write(df, batch_id)
        written = df.sparkSession.read.schema(df.schema).parquet(f"{data}/batch={batch_id}")  # not computed twice
        row = written.agg(F.max(seq).alias("seq_hi"), F.count(F.lit(1)).alias("rows")).select(
            F.lit(f"chk-{batch_id}").alias("checkpoint_id"), F.lit(db_id).alias("db_id"), "seq_hi", "rows"
        )
        pin(row, batch_id)

    return both


def checkpoint_offsets(spark: SparkSession, checkpoints: str) -> DataFrame:
    """Checkpoints with ``source_offset``: the source rows that all batches up to theirs have taken."""
    upto = Window.partitionBy("db_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return spark.read.parquet(checkpoints).withColumn("source_offset", F.sum("rows").over(upto))


def failing_after(write: Callable[[DataFrame, int], None], batch_id: int) -> Callable[[DataFrame, int], None]:
    """The same sink with one induced failure: after the data of a batch is written, before its commit."""
    failures: list[int] = []

    def write_then_fail(df: DataFrame, number: int) -> None:
        write(df, number)
        if not failures and number >= batch_id:
            failures.append(number)
            raise RuntimeError(f"induced failure after batch {number}")

    write_then_fail.failures = failures
    return write_then_fail


def simple_sink(
    stream: DataFrame, kind: str, checkpoint: str, name: str | None = None, mode: str = "append", to_end: bool = True
) -> StreamingQuery:
    """``console``, ``noop`` or ``memory`` (a temporary view, for tests)."""
    if kind not in ("console", "noop", "memory"):
        raise ValueError(f"unknown sink {kind!r}")
    writer = stream.writeStream.format(kind).outputMode(mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(availableNow=True) if to_end else writer.trigger(processingTime="0 seconds")).start()


def newest_batch(spark: SparkSession, path: str, keys: list[str], values: list[str]) -> DataFrame:
    """Last written row per key of an update-mode sink."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(*[F.max_by(v, "batch").alias(v) for v in values])


def state_of(
    spark: SparkSession,
    checkpoint: str,
    batch_id: int | None = None,
    variable: str | None = None,
) -> DataFrame:
    """State that a query left in its checkpoint folder, at its newest batch or an earlier one."""
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", str(batch_id))
    if variable is not None:
        reader = reader.option("stateVarName", variable)
    return by_key(reader.load(checkpoint))


def by_key(rows: DataFrame) -> DataFrame:
    """State of buckets, which holds its keys and their values as arrays, as a row for each key; other state as it is."""
    value = rows.schema["value"].dataType if "value" in rows.columns else None
    names = value.fieldNames() if isinstance(value, StructType) else []
    if "key" not in names or not all(isinstance(f.dataType, ArrayType) for f in value):
        return rows
    at = rows.select("partition_id", F.explode(F.arrays_zip(*[F.col(f"value.{n}") for n in names])).alias("at"))
    held = F.struct(*[F.col(f"at.{n}").alias(n) for n in names if n != "key"])
    return at.select(F.struct(F.col("at.key").alias("key")).alias("key"), held.alias("value"), "partition_id")


def collection(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """The entries of a collection that a query keeps as state, one row each: the grouping key's columns, ``entry`` and ``at``.

    Those of a map are its key and value; a collection kept as arrays has the whole entry for both.
    """
    rows = spark.read.format("statestore").option("stateVarName", variable).option("flattenCollectionTypes", "true").load(checkpoint)
    if "value" in rows.columns:
        arrays = F.arrays_zip(*[F.col(f"value.{n}") for n in rows.schema["value"].dataType.fieldNames()])
        return rows.select("key.*", F.explode(arrays).alias("entry")).withColumn("at", F.col("entry"))
    outer = rows.schema["key"].dataType.fieldNames()
    inner = [F.col(f"user_map_key.{n}") for n in ("db_id", "key") if n not in outer and n in rows.schema["user_map_key"].dataType.fieldNames()]
    return rows.select("key.*", *inner, F.col("user_map_key").alias("entry"), F.col("user_map_value").alias("at"))


def pending_timers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, due_ms) of every key that waits for its time in the tiers that a query left in its checkpoint folder."""
    return state_of(spark, checkpoint, variable="hot").select(F.col("key.key").alias("key"), F.col("value.due_ms").alias("due_ms"))


def state_metadata(spark: SparkSession, checkpoint: str) -> DataFrame:
    return spark.read.format("state-metadata").load(checkpoint)


def state_changes(spark: SparkSession, checkpoint: str, first: int, last: int | None = None) -> DataFrame:
    """Every change of the state between two batches."""
    reader = (
        spark.read.format("statestore").option("readChangeFeed", "true").option("changeStartBatchId", str(first))
    )
    if last is not None:
        reader = reader.option("changeEndBatchId", str(last))
    return reader.load(checkpoint)


def last_batch(query: StreamingQuery) -> int:
    """Number of the newest committed batch of a drained query."""
    return query.lastProgress["batchId"]


class Progress(StreamingQueryListener):
    """Keeps every progress report of a session's queries; a query itself remembers the newest hundred only."""

    def __init__(self, spark: SparkSession):
        self.reports: list = []
        self.ended: set[str] = set()
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.reports.append(json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def of(self, query: StreamingQuery, seconds: float = 60) -> list[dict]:
        """All reports of a query, once its end has been heard of."""
        until = time.monotonic() + seconds
        while str(query.runId) not in self.ended:
            if time.monotonic() > until:
                raise TimeoutError("the end of the query was not reported")
            time.sleep(0.05)
        return [p for p in self.reports if p["id"] == str(query.id)]


def progress_metrics(spark: SparkSession, reports: list[dict]) -> DataFrame:
    """Metrics rows from progress reports."""
    rows = []
    for p in reports:
        labels = {"batch": str(p["batchId"])}
        rows.append((p["timestamp"], "input_rows", labels, "counter", float(p["numInputRows"])))
        for i, op in enumerate(p["stateOperators"]):
            at = {**labels, "operator": str(i)}
            rows.append((p["timestamp"], "state_rows", at, "gauge", float(op["numRowsTotal"])))
            rows.append((p["timestamp"], "late_rows", at, "counter", float(op["numRowsDroppedByWatermark"])))
    return spark.createDataFrame(rows, "ts string, name string, labels map<string,string>, kind string, value double")


def no_late_rows(reports: list[dict]) -> None:
    """Fail if a watermark has dropped rows: the delay is then too short for the source."""
    late = sum(op["numRowsDroppedByWatermark"] for p in reports for op in p["stateOperators"])
    if late:
        raise ValueError(f"{late} rows came after the watermark and were dropped")
