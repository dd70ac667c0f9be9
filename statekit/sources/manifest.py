"""Tables of files with a manifest: what was committed is what a manifest names, not what lies in the folder.

Below the root of a table lie ``data`` (files, by write and shard), ``manifest`` (for each version the files it consists of)
and ``checkpoints`` (versions that someone still needs, each with an expiry). A commit writes data first and its manifest
after it; a crash in between leaves files that no manifest names. Readers open the files of one version and nothing else, so
they see neither such leftovers nor a commit that happens meanwhile.

One writer at a time: a version is written once, and a second writer of the same version fails. What a crashed commit
left of its manifest counts as no version; the next commit takes the number after it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from statekit.operators import upkeep
from statekit.session import durable
from statekit.sources import files, stores

FILE_BYTES = 128 << 20
ENTRY = "file string, shard int, rows long, bytes long, lo long, hi long, changed timestamp, batch long"


def entries(spark: SparkSession, place: str, seq: str) -> DataFrame:
    """The files below a folder as manifest entries, from listing and footers alone."""
    shard = F.regexp_extract("file", "/shard=([0-9]+)/", 1).cast("int")
    groups = stores.row_groups(spark, place, [seq])
    per_file = groups.groupBy("file", "file_bytes", "changed").agg(
        F.sum("rows").alias("rows"), F.min(f"{seq}.lo").alias("lo"), F.max(f"{seq}.hi").alias("hi")
    )
    return per_file.select("file", shard.alias("shard"), "rows", F.col("file_bytes").alias("bytes"), "lo", "hi", "changed", F.lit(None).cast("long").alias("batch"))


def write(rows: DataFrame, root: str, seq: str = "seq", splits: Column | None = None) -> DataFrame:
    """Write rows by their column ``shard`` without committing them; the entries of the new files. ``splits``: see
    :func:`statekit.sources.files.write_by`."""
    place = f"{root}/data/write={uuid.uuid4().hex}"
    files.write_by(rows, place, "shard", splits=splits)
    return entries(rows.sparkSession, place, seq)


def versions(root: str) -> tuple[list[int], int]:
    """Committed versions, and the highest number that any commit has tried."""
    store, path = stores.opened(f"{root}/manifest")
    found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    of = lambda x: int(x.split("version=")[1].split("/")[0])
    tried = [of(f.path) for f in found if "version=" in f.path]
    whole = {of(f.path) for f in found if f.path.endswith(".parquet") and "/_temporary/" not in f.path}
    return sorted(whole), max(tried, default=0)


def newest(root: str) -> int | None:
    return max(versions(root)[0], default=None)


def live(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The files of a version (default: the newest committed one)."""
    version = newest(root) if version is None else version
    if version is None:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(f"{root}/manifest/version={version}")


def commit(spark: SparkSession, root: str, added: DataFrame, replaced: DataFrame | None = None) -> int:
    """Make the next version: the newest one without ``replaced`` files and with the ``added`` ones.

    It is one file, renamed into place when it is complete: there is no state in which half of it counts.
    """
    now = live(spark, root)
    if replaced is not None:
        now = now.join(replaced.select("file"), "file", "left_anti")
    version = versions(root)[1] + 1
    now.unionByName(added).select(*[c.split()[0] for c in ENTRY.split(", ")]).coalesce(1).write.parquet(f"{root}/manifest/version={version}")
    return version


def read(spark: SparkSession, root: str, schema: StructType, version: int | None = None, only: Column | None = None) -> DataFrame:
    """The rows of a version, from the files it names; ``only`` picks files by their entries (shard, lo, hi).

    The driver gets the names of the files, as it does when it lists a folder.
    """
    named = live(spark, root, version)
    names = [r["file"] for r in (named if only is None else named.where(only)).select("file").collect()]
    whole = schema if "shard" in schema.names else StructType([*schema.fields]).add("shard", IntegerType())
    if not names:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", f"{root}/data").parquet(*names).select(*whole.names)


def pin(spark: SparkSession, root: str, checkpoint_id: str, version: int, expire_ts: Column) -> None:
    """Keep the files of a version until ``expire_ts`` (null: for good)."""
    row = spark.range(1).select(F.lit(checkpoint_id).alias("checkpoint_id"), F.lit(version).alias("version"), expire_ts.cast("timestamp").alias("expire_ts"))
    row.write.parquet(f"{root}/checkpoints/{checkpoint_id}")


PINS = "checkpoint_id string, version int, expire_ts timestamp"


def pins(spark: SparkSession, root: str) -> DataFrame:
    store, path = stores.opened(f"{root}/checkpoints")
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return spark.createDataFrame([], PINS)
    return spark.read.schema(PINS).option("recursiveFileLookup", "true").parquet(f"{root}/checkpoints")


def judged(spark: SparkSession, root: str, now: Column, min_age_s: int, seq: str = "seq") -> DataFrame:
    """Every file that lies in the table's folder, with its status as in :func:`statekit.operators.upkeep.orphans`.

    A checkpoint's files are those of the version that it pins. Files younger than ``min_age_s`` may belong to a commit
    that is under way.
    """
    named = lambda df: df.withColumn("db_id", F.lit(root)).withColumnRenamed("file", "file_id")
    there = named(entries(spark, f"{root}/data", seq)).withColumnRenamed("changed", "create_ts")
    held = pins(spark, root)
    whole = versions(root)[0]
    every = spark.read.schema(ENTRY + ", version int").parquet(f"{root}/manifest").where(F.col("version").isin(whole)) if whole else None
    refs = spark.createDataFrame([], ENTRY + ", checkpoint_id string") if every is None else every.join(held, "version")
    status = upkeep.orphans(there, named(live(spark, root)), named(refs), held.withColumn("db_id", F.lit(root)), now, min_age_s)
    return status.withColumnRenamed("file_id", "file").drop("db_id")


def sweep(spark: SparkSession, judgement: DataFrame) -> int:
    """Remove the files judged deletable, each in a task; a file that is gone already is no error. Their number.

    The judgement is written first, so that what is removed is what was judged.
    """
    gone = durable(spark, judgement.where("status = 'deletable'").select("file"), "sweep")

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names in batches:
            for uri in names["file"]:
                store, path = stores.opened(uri)
                if store.get_file_info(path).type != fs.FileType.NotFound:
                    store.delete_file(path)
            yield pd.DataFrame({"n": [len(names)]})

    return gone.mapInPandas(remove, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def compact(spark: SparkSession, root: str, schema: StructType, keep: Callable[[DataFrame], DataFrame], most_files: int, seq: str = "seq") -> tuple[int, int]:
    """Rewrite the shards that consist of more than ``most_files`` files; the versions before and after.

    Only files of those shards are read, and only they are replaced; all others stay under their names. ``keep`` says
    what remains of a shard's rows. A shard comes out as one file, a large one as several, but never over ``most_files``.
    """
    before = newest(root)
    named = live(spark, root, before)
    crowded = named.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") > most_files)
    sizes = {r["shard"]: min(most_files, 1 + r["bytes"] // FILE_BYTES) for r in crowded.collect()}  # as many as there are shards
    shards = list(sizes)
    if not shards:
        return before, before
    rows = read(spark, root, schema, before, F.col("shard").isin(shards))
    replaced = named.where(F.col("shard").isin(shards))
    newest_batch = named.agg(F.max("batch")).first()[0]
    splits = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("shard")]
    added = durable(spark, write(keep(rows), root, seq, splits).withColumn("batch", F.lit(newest_batch).cast("long")), "entries")
    return before, commit(spark, root, added, replaced)


def batch_sink(root: str, keep: Callable[[DataFrame], DataFrame], most_files: int, seq: str) -> Callable[[DataFrame, int], None]:
    """Sink that commits each micro-batch of a stream once and keeps the table small.

    Rows have a column ``shard``. A batch that was committed before a failure is known by its number and left out when it
    comes again. After a commit, shards of more than ``most_files`` files are rewritten to what ``keep`` leaves of them,
    so a reader opens a bounded number of files however long the stream has run.
    """

    def write_batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        done = live(spark, root).agg(F.max("batch")).first()[0]
        if done is not None and number <= done:
            return
        added = durable(spark, write(df, root, seq).withColumn("batch", F.lit(number).cast("long")), "entries")
        commit(spark, root, added)
        compact(spark, root, df.schema, keep, most_files, seq)

    return write_batch


def change_report(spark: SparkSession, root: str, before: int, after: int) -> DataFrame:
    """Per shard: files, rows and bytes of two versions, and how many files both of them have."""
    old, new = (live(spark, root, v).withColumn("side", F.lit(s)) for v, s in ((before, "before"), (after, "after")))
    both = old.unionByName(new).groupBy("shard", "file").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for s in ("before", "after") for c in ("rows", "bytes")])
    kept = F.col("rows_before").isNotNull() & F.col("rows_after").isNotNull()
    sums = [F.coalesce(F.sum(f"{c}_{s}"), F.lit(0)).alias(f"{c}_{s}") for s in ("before", "after") for c in ("rows", "bytes")]
    counts = [F.count(f"rows_{s}").alias(f"files_{s}") for s in ("before", "after")]
    return both.groupBy("shard").agg(*counts, *sums, F.count_if(kept).alias("files_kept"))
