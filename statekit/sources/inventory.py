"""File tables of a state database, derived from the events: one L0 file per 100 events, one sorted
run per ten L0 files; every checkpoint pins the L0 files of the group it was taken in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.functions.routing import fixed_width
from statekit.sources import tables as t

PER_FILE, PER_RUN = 100, 10


def l0_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.events(spark, sf_dir)
    no = F.floor(F.col("seq") / PER_FILE).cast("bigint")
    return e.groupBy(no.alias("file_no")).agg(
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.octet_length("props")).cast("bigint").alias("bytes"),
        F.max("ts").alias("create_ts"),
    ).withColumn("db_id", F.lit("events"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    l0 = l0_files(spark, sf_dir)
    runs = l0.groupBy("db_id", F.floor(F.col("file_no") / PER_RUN).cast("bigint").alias("file_no")).agg(
        F.min("min_key").alias("min_key"),
        F.max("max_key").alias("max_key"),
        F.sum("rows").cast("bigint").alias("rows"),
        F.sum("bytes").cast("bigint").alias("bytes"),
        F.max("create_ts").alias("create_ts"),
    )
    named = lambda df, level: df.select(
        "db_id",
        fixed_width(f"{level}-", F.col("file_no"), 20).alias("file_id"),
        F.lit(level).alias("level"),
        "file_no", "min_key", "max_key", "rows", "bytes", "create_ts",
    )
    return named(l0, "L0").unionByName(named(runs, "SR"))


def last_group(spark: SparkSession, sf_dir: str):
    top = t.table(spark, sf_dir, "events").agg(F.max("event_id")).scalar()
    return F.floor(top / (PER_FILE * PER_RUN))


def manifest_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest manifest: the runs of all full groups, and the L0 files of the last one."""
    f = files(spark, sf_dir)
    group = F.when(F.col("level") == "SR", F.col("file_no")).otherwise(F.floor(F.col("file_no") / PER_RUN))
    last = last_group(spark, sf_dir)
    return f.where(
        ((F.col("level") == "SR") & (group < last)) | ((F.col("level") == "L0") & (group == last))
    ).select("db_id", "file_id")


def checkpoint_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L0 files that a checkpoint holds: those of its group up to its flush point."""
    cps = t.checkpoints(spark, sf_dir)
    upto = F.floor(F.col("manifest_seq_hi") / PER_FILE)
    first = F.floor(upto / PER_RUN) * PER_RUN
    return cps.select(
        "db_id", "checkpoint_id", F.explode(F.sequence(first, upto)).alias("file_no")
    ).select("db_id", "checkpoint_id", fixed_width("L0-", F.col("file_no"), 20).alias("file_id"))
