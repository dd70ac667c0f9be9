"""Compaction, orphaned files, checkpoint retention, segment drops, lineage and write stalls."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statekit.operators import chunks, log
from statekit.session import durable
from statekit.sources import stores


def compact(changelog: DataFrame, now: Column) -> DataFrame:
    """What a full compaction keeps: the newest put per key that has not expired."""
    return log.ttl_view(log.latest(changelog), now, "read_filter")


def compact_report(changelog: DataFrame, now: Column) -> DataFrame:
    """Per database: rows before and after, and why each dropped row went, in one aggregation."""
    newest = (
        changelog.where(log.is_base())
        .groupBy(*log.KEYS)
        .agg(
            F.count(F.lit(1)).alias("_versions"),
            F.max_by(F.col("op") == "put", "seq").alias("_live"),
            F.max_by("expire_ts", "seq").alias("_expire"),
        )
    )
    expired = F.col("_live") & F.coalesce(F.col("_expire") <= now, F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    return newest.groupBy("db_id").agg(
        F.sum("_versions").alias("rows_before"),
        count(F.col("_live") & ~expired).alias("rows_after"),
        F.sum(F.col("_versions") - 1).alias("hidden_versions"),
        count(~F.col("_live")).alias("tombstones"),
        count(expired).alias("expired"),
    )


def orphans(
    files: DataFrame,
    manifest_refs: DataFrame,
    checkpoint_refs: DataFrame,
    checkpoints: DataFrame,
    now: Column,
    min_age_s: int,
    low_watermark: Column | None = None,
) -> DataFrame:
    """Classify every file: ``live`` (in the manifest), ``pinned`` (held by a checkpoint that has not
    expired), ``too_young``, or ``deletable``.

    References are made distinct per file before they are joined, so a file held by most
    checkpoints is no hot key; files and checkpoints are named within their database. A file newer than ``low_watermark`` may belong to a running commit
    and counts as too young.
    """
    alive = checkpoints.where(F.col("expire_ts").isNull() | (F.col("expire_ts") > now))
    pinned = (
        checkpoint_refs.join(alive.select("db_id", "checkpoint_id"), ["db_id", "checkpoint_id"], "left_semi")
        .select("db_id", "file_id")
        .distinct()
        .withColumn("_pinned", F.lit(True))
    )
    live = manifest_refs.select("db_id", "file_id").distinct().withColumn("_live", F.lit(True))
    young = F.col("create_ts") > now - F.expr(f"INTERVAL '{min_age_s}' SECOND")
    if low_watermark is not None:
        young = young | (F.col("create_ts") >= low_watermark)
    name = ["db_id", "file_id"]
    return files.join(live, name, "left").join(pinned, name, "left").select(
        *files.columns,
        F.when(F.col("_live"), "live")
        .when(F.col("_pinned"), "pinned")
        .when(young, "too_young")
        .otherwise("deletable")
        .alias("status"),
    )


def orphan_files(files: DataFrame, manifest_refs: DataFrame, checkpoint_refs: DataFrame) -> DataFrame:
    """Files in neither the manifest nor any checkpoint, whatever their age."""
    name = ["db_id", "file_id"]
    return files.join(manifest_refs.select(*name), name, "left_anti").join(checkpoint_refs.select(*name), name, "left_anti")


def checkpoint_retention(
    checkpoints: DataFrame, retained: DataFrame, keep: int, now: Column
) -> DataFrame:
    """Status of every checkpoint, given those that jobs still refer to.

    ``unrestorable``: referred to but expired. ``referenced``: keep. ``newest``: among the newest
    ``keep`` of its database. ``leak``: nobody refers to it and it never expires. ``expired``: already
    free. ``deletable``: safe to delete now.
    """
    recent = Window.partitionBy("db_id").orderBy(F.desc("create_ts"), F.desc("checkpoint_id"))
    # The row_number <= keep filter is pushed below the shuffle, so a database sends `keep` rows per task.
    newest = (
        checkpoints.select("db_id", "checkpoint_id", "create_ts")
        .withColumn("_rn", F.row_number().over(recent))
        .where(F.col("_rn") <= keep)
        .select("db_id", "checkpoint_id", F.lit(True).alias("_newest"))
    )
    name = ["db_id", "checkpoint_id"]
    refs = retained.select(*name).distinct().withColumn("_ref", F.lit(True))
    gone = F.coalesce(F.col("expire_ts") <= now, F.lit(False))
    both = checkpoints.join(refs, name, "left").join(newest, name, "left")
    return both.select(
        *checkpoints.columns,
        F.when(F.col("_ref") & gone, "unrestorable")
        .when(F.col("_ref"), "referenced")
        .when(F.col("_newest"), "newest")
        .when(F.col("expire_ts").isNull(), "leak")
        .when(gone, "expired")
        .otherwise("deletable")
        .alias("status"),
    )


def refresh(checkpoints: DataFrame, checkpoint_id: str, expire_ts: Column) -> DataFrame:
    """Give one checkpoint a new expiry."""
    hit = F.col("checkpoint_id") == checkpoint_id
    return checkpoints.withColumn("expire_ts", F.when(hit, expire_ts).otherwise(F.col("expire_ts")))


def drop_segment(spark: SparkSession, table: str, column: str, value: int) -> None:
    """Drop one segment of a partitioned catalog table: a change of metadata, no row is rewritten.

    The files of an external table stay behind when its partition goes; they are removed after it.
    """
    at = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"]
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({column} = {int(value)})")
    store, path = stores.opened(f"{at}/{column}={int(value)}")
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)


def range_tombstones(state: DataFrame, in_range: Column, seq: Column) -> DataFrame:
    """Deletes for the live keys of a range, as log rows at one commit: there is no range delete."""
    return state.where(in_range).select(
        "db_id",
        "key",
        F.lit("delete").alias("op"),
        F.lit(None).cast(state.schema["value"].dataType).alias("value"),
        seq.cast("bigint").alias("seq"),
    )


def clone_chain(lineage: DataFrame, child: str = "db_id", parent: str = "parent_id") -> DataFrame:
    """Depth and root of every clone, from ``(child, parent)`` with a null parent at a root.

    Every round doubles the distance that an ancestor pointer spans, so a chain of depth d takes
    log2(d) joins. Finished rows leave the loop; each round is cut by a written table. The looked-up
    side is unique, so when many clones share an ancestor, adaptive execution splits their side.
    """
    spark = lineage.sparkSession
    edges = lineage.select(F.col(child).alias("db"), F.col(parent).alias("up"))
    total = edges.count()
    roots = edges.where("up IS NULL").select("db", F.lit(0).alias("depth"), F.col("db").alias("root"))
    open_ = durable(spark, edges.where("up IS NOT NULL").withColumn("hops", F.lit(1)), "lineage")
    done = durable(spark, roots, "lineage-done")
    while not open_.isEmpty():
        # One lookup table per round: what an ancestor knows, whether it is finished or still open.
        known = done.select(
            F.col("db").alias("up"), F.col("depth").alias("_depth"), "root", F.lit(None).cast("string").alias("_up"), F.lit(0).alias("_hops")
        ).unionByName(
            open_.select(
                F.col("db").alias("up"), F.lit(None).cast("int").alias("_depth"), F.lit(None).cast("string").alias("root"),
                F.col("up").alias("_up"), F.col("hops").alias("_hops"),
            )
        )
        step = durable(spark, open_.join(known, "up", "left"), "lineage-step")
        if not step.where("_depth IS NULL AND _up IS NULL").isEmpty():
            raise ValueError("lineage names a parent that is not in the table")
        new = step.where("_depth IS NOT NULL").select(
            "db", (F.col("hops") + F.col("_depth")).alias("depth"), "root"
        )
        done = durable(spark, done.unionByName(new), "lineage-done")
        open_ = step.where("_depth IS NULL").select(
            "db", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops")
        )
        if not open_.where(F.col("hops") > total).isEmpty():
            raise ValueError("lineage has a cycle")
    children = edges.where("up IS NOT NULL").groupBy(F.col("up").alias("db")).agg(F.count(F.lit(1)).alias("clones"))
    return done.join(children, "db", "left").fillna(0, ["clones"])


def level_log(files: DataFrame, fan_in: int, lag: int) -> DataFrame:
    """(db_id, seq, ts, delta) of the L0 count: +1 at a flush, -fan_in when a group of files is merged.

    Files ``(db_id, file_no, create_ts)`` are merged in groups of ``fan_in``, ``lag`` flushes after the
    last file of the group.
    """
    flush = files.select("db_id", (F.col("file_no") * 2).alias("seq"), F.col("create_ts").alias("ts"), F.lit(1).alias("delta"))
    merged_at = F.col("file_no") - lag
    due = (merged_at >= fan_in - 1) & (F.pmod(merged_at + 1, F.lit(fan_in)) == 0)
    merge = files.where(due).select(
        "db_id", (F.col("file_no") * 2 + 1).alias("seq"), F.col("create_ts").alias("ts"), F.lit(-fan_in).alias("delta")
    )
    return flush.unionByName(merge)


def write_stall(levels: DataFrame, limit: int) -> DataFrame:
    """Per database: highest L0 count and seconds spent above the limit at which writers pause."""
    counted = chunks.running_sum(levels, ["db_id"], "seq", {"l0": F.col("delta")}, few_keys=True)
    before = chunks.previous(
        counted, ["db_id"], "seq", {"_ts": F.col("ts"), "_l0": F.col("l0")}, few_keys=True
    )
    held = F.timestamp_diff("MICROSECOND", "_ts", "ts")
    return before.groupBy("db_id").agg(
        F.max("l0").alias("max_l0"),
        F.count(F.when(F.col("l0") > limit, 1)).alias("changes_above"),
        F.coalesce(F.sum(F.when(F.col("_l0") > limit, held)), F.lit(0)).alias("us_above"),
    )
