"""A stored log as a stream in the order of its sequence numbers, by row groups.

``arrange`` sorts a log once over many files, with row groups of a set number of rows, and keeps an index of them taken
from the footers: neighbouring row groups make a *batch*. ``stream`` delivers one batch per micro-batch. Its offset is the
number of deliveries, a restarted query goes on after the last one it had planned, and a task opens the row groups of
its batch and nothing else: over a whole run every row group is read once.

Batches are disjoint and ascending: row groups that share a sequence number are never in two of them. The source adds
the column ``lap``: 0 for a first delivery, see ``stream`` for the others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from statekit.sources import stores
from statekit.streaming import runs

FILE_ROWS = 1_000_000
GROUPS_A_BATCH = 8
INDEX = "batch int, file string, row_group int, rows long, lo long, hi long, min_us long, max_us long"


@dataclass(frozen=True)
class Log:
    """An arranged log: its rows below ``path/data``, its row groups in ``path/index``."""

    path: str
    schema: str  # as JSON
    batches: int
    rows: int


def arrange(df: DataFrame, path: str, seq: str, parts: int, ts: str | None = None) -> Log:
    """Write ``df`` in the order of ``seq``, to be delivered in ``parts`` batches or a few more.

    Files are cut at exact ranks, so that each holds whole row groups and batches are those of a single sorted file, while a
    task sorts less than twice ``FILE_ROWS`` rows: a row group of more rows is cut into files of its own, which stay in one batch. The log is
    read once for its rows and, if it needs several files, for its sequence numbers. Every row needs one. ``ts`` names the event time whose bounds the index keeps.
    """
    spark = df.sparkSession
    rows = df.count()
    per_batch = max(1, rows // parts)
    per_group = max(1, per_batch // GROUPS_A_BATCH)
    split = -(-per_group // FILE_ROWS)
    step = per_group * max(1, -(-FILE_ROWS // per_group))
    part = -(-per_group // split) if split > 1 else step
    cuts = at_ranks(df, f"{path}/ranks", seq, step, part, rows)
    by_file = df.withColumn("_file", file_of(cuts)(F.col(seq))).repartitionById(len(cuts) + 1, F.col("_file")) if cuts else df.coalesce(1)
    sorted_ = by_file.sortWithinPartitions(seq).drop("_file")
    sorted_.write.option("parquet.block.row.count.limit", min(part, per_group)).parquet(f"{path}/data")
    groups = stores.row_groups(spark, f"{path}/data", [seq] + ([ts] if ts else []))
    times = [F.col(f"{ts}.{c}") if ts else F.lit(None).cast("long") for c in ("lo", "hi")]
    groups = groups.select("file", "row_group", "rows", f"{seq}.lo", f"{seq}.hi", F.col(f"{seq}.nulls").alias("nulls"), times[0].alias("min_us"), times[1].alias("max_us"))
    # One row per row group, so one task sorts them all: 100 TB in groups of 128 MB are 800,000 rows.
    order = Window.orderBy("lo", "file", "row_group")
    before = F.sum("rows").over(order) - F.col("rows")
    fresh = F.coalesce(F.col("lo") > F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    begun = F.floor(before / per_group) * per_group if split > 1 else before  # the files of one row group go together
    numbered = groups.select("*", F.floor(begun / per_batch).alias("_at"), fresh.alias("_fresh"))
    # A row group that shares a number with the one before stays in its batch.
    batch = F.max(F.when(F.col("_fresh"), F.col("_at"))).over(order)
    numbered = numbered.withColumn("_batch", batch).withColumn("batch", F.dense_rank().over(Window.orderBy("_batch")) - 1)
    index = numbered.select("batch", "file", "row_group", "rows", "lo", "hi", "min_us", "max_us", "nulls")
    index.coalesce(1).write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    found = index.agg(F.max("batch").alias("top"), F.sum("rows").alias("rows"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls")).first()
    if found["nulls"]:
        raise ValueError(f"{found['nulls']} rows have no {seq}, so they have no place in the order")
    return Log(path, df.schema.json(), 0 if found["top"] is None else found["top"] + 1, found["rows"] or 0)


def at_ranks(df: DataFrame, path: str, seq: str, step: int, part: int, rows: int) -> list[int]:
    """The sequence numbers at the ranks ``step``, 2 ``step``, ... of the order, and at every ``part`` ranks after each of these;
    their sorted numbers lie below ``path``."""
    if rows <= part:
        return []
    spark = df.sparkSession
    df.where(F.col(seq).isNotNull()).select(seq).repartitionByRange(-(-rows // part), seq).sortWithinPartitions(seq).write.parquet(path)
    groups = stores.row_groups(spark, path, [seq]).select("file", "row_group", "rows", f"{seq}.lo", f"{seq}.hi")
    before = F.sum("rows").over(Window.orderBy("lo", "hi", "file", "row_group")) - F.col("rows")
    wanted = groups.select("file", "row_group", "rows", before.alias("before"), (F.floor(before / step) * step).alias("first"))
    wanted = wanted.withColumn("base", F.explode(F.sequence(F.col("first"), F.col("before") + F.col("rows") - 1, F.lit(step))))
    wanted = wanted.withColumn("rank", F.explode(F.sequence(F.col("base"), F.col("base") + step - 1, F.lit(part))))
    wanted = wanted.where("rank > 0 AND rank >= before AND rank < before + rows").select("file", "row_group", "rank", "before")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (file, group), some in pdf.groupby(["file", "row_group"]):
                numbers = stores.parquet(file).read_row_group(int(group), columns=[seq]).column(seq).to_numpy()
                yield pd.DataFrame({"cut": numbers[(some["rank"] - some["before"]).to_numpy()]})

    # As many numbers as there are files.
    return sorted({r["cut"] for r in wanted.mapInPandas(read, "cut long").collect()})


def file_of(cuts: list[int]):
    @F.pandas_udf("int")
    def number(seqs: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, seqs.to_numpy(), "right").astype(np.int32))

    edges = np.array(cuts)
    return number


def index(spark: SparkSession, log: Log) -> DataFrame:
    return spark.read.parquet(f"{log.path}/index").drop("nulls")


def delay(spark: SparkSession, log: Log) -> str:
    """Watermark delay for the log: by how much event time goes back from one batch to a later one."""
    per_batch = index(spark, log).groupBy("batch").agg(F.min("min_us").alias("lo"), F.max("max_us").alias("hi"), F.count_if(F.col("min_us").isNull()).alias("blank"))
    top = F.max("hi").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))  # a row per batch
    back = per_batch.withColumn("top", top).agg(F.max(F.col("top") - F.col("lo")).alias("us"), F.sum("blank").alias("blank")).first()
    if back["blank"]:
        raise ValueError("the files have no bounds of the event time")
    return f"{-(-max(0, back['us'] or 0) // 1000)} milliseconds"


class RowGroups(InputPartition):
    """One row group of a file, delivered for the ``lap``-th time."""

    def __init__(self, file: str, row_group: int, lap: int):
        self.file, self.row_group, self.lap = file, row_group, lap


class OrderedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        first, until = int(options["first"]), int(options["until"])
        lead = [(first - 1, -1)] if options.get("lead") == "true" and first > 0 else []
        laps = [(b, lap) for lap in range(int(options["laps"])) for b in range(first, until)]
        last = int(options["laps"])
        ticks = [(until - 1, last + k) for k in range(int(options["ticks"]) if until > first else 0)]
        self.deliveries = lead + laps + ticks
        self.planned = 0
        self.groups = None

    def initialOffset(self) -> dict:
        return {"delivered": 0}

    def latestOffset(self) -> dict:
        return {"delivered": min(self.planned + 1, len(self.deliveries))}

    def partitions(self, start: dict, end: dict) -> list[RowGroups]:
        # A restarted query asks for an empty range first, which tells how far it had come.
        self.planned = max(self.planned, end["delivered"])
        if self.groups is None:
            store, path = stores.opened(f"{self.path}/index")
            table = pq.read_table(path, filesystem=store, columns=["batch", "file", "row_group"]).to_pydict()
            self.groups = {}
            for batch, file, group in zip(table["batch"], table["file"], table["row_group"], strict=True):
                self.groups.setdefault(batch, []).append((file, group))
        due = self.deliveries[start["delivered"] : end["delivered"]]
        return [RowGroups(file, group, lap) for batch, lap in due for file, group in self.groups[batch]]

    def read(self, partition: RowGroups) -> Iterator[pa.RecordBatch]:
        for batch in stores.parquet(partition.file).iter_batches(row_groups=[partition.row_group]):
            yield batch.append_column("lap", pa.array([partition.lap] * batch.num_rows, pa.int32()))


class OrderedLog(DataSource):
    """Streaming source over an arranged log; see :func:`stream`."""

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["columns"])).add("lap", IntegerType())

    def streamReader(self, schema: StructType) -> OrderedReader:
        return OrderedReader(dict(self.options))


def registered(own: SparkSession) -> str:
    """Make the source known to a session; its name there.

    Spark refuses a name that the thread's active session knows and the given one does not, so each session has its own.
    """
    name = own.conf.get("spark.statekit.ordered.name", None) or f"ordered_log_{uuid.uuid4().hex[:12]}"
    own.conf.set("spark.statekit.ordered.name", name)
    own.dataSource.register(type("OrderedLog", (OrderedLog,), {"name": classmethod(lambda cls: name)}))
    return name


def stream(own: SparkSession, log: Log, first: int = 0, until: int | None = None, laps: int = 1, lead: bool = False, ticks: int = 0) -> DataFrame:
    """The batches ``first .. until - 1`` of a log, one each micro-batch, with the column ``lap``.

    ``laps``: the whole of them so many times over, lap 0, 1, ... ``lead``: the batch before the first one comes ahead as lap
    -1, so that a query that takes over has the clock of the one before. ``ticks``: the last batch comes so many times more
    in laps of its own, so that timers due by its time fire. Rows of other laps than 0 are copies; what they mean is the
    reader's business (see :func:`statekit.streaming.state.touches`).
    """
    options = {"path": log.path, "columns": log.schema, "first": first, "until": log.batches if until is None else until, "laps": laps, "lead": lead, "ticks": ticks}
    reader = own.readStream.format(registered(own))
    for name, value in options.items():
        reader = reader.option(name, str(value).lower() if isinstance(value, bool) else value)
    return reader.load()


def drained(begin: Callable[[], StreamingQuery], restarts: int = 3) -> StreamingQuery:
    """Run a query over an ordered log to its end, starting again from the last commit after a failure.

    ``begin`` starts it with :func:`statekit.streaming.runs.start` and ``to_end=False``: the source gives one batch at a
    time, and the query is stopped when there is none left.
    """

    def run() -> StreamingQuery:
        query = begin()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return query

    return runs.with_restarts(run, restarts)
