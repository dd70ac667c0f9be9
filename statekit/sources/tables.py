"""The driver's tables, and the logs and states that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.operators import log as slog

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def row_count(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery: no join and no job before the query runs."""
    return df.agg(F.count(F.lit(1))).scalar()


def as_events(df: DataFrame) -> DataFrame:
    """Event rows, batch or stream, as keyed rows ``(key, seq, ts, event_type, value, props)``."""
    return df.select(
        F.col("user_id").cast("string").alias("key"),
        F.col("event_id").alias("seq"),
        "ts",
        "event_type",
        F.col("value").cast("decimal(18,2)").alias("value"),
        "props",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"))


def op_of(event_type: Column) -> Column:
    return (
        F.when(event_type == "signup", "put")
        .when(event_type == "error", "delete")
        .when(event_type == "view", "get")
        .otherwise("merge")
    )


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_op_log(events(spark, sf_dir))


def as_op_log(e: DataFrame) -> DataFrame:
    """Change log over the events: signup puts, error deletes, view reads, the rest merges.

    Keys of users divisible by three expire after seven days.
    """
    expires = F.pmod(F.col("key").cast("bigint"), F.lit(3)) == 0
    return e.select(
        F.lit("events").alias("db_id"),
        "key",
        op_of(F.col("event_type")).alias("op"),
        "value",
        "seq",
        F.col("ts").alias("create_ts"),
        F.when(expires, F.col("ts") + F.expr("INTERVAL '7' DAY")).alias("expire_ts"),
        "event_type",
        "props",
    )


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op log with two writers: epoch 2 takes over halfway, epoch 1 keeps trying every tenth row."""
    logged = op_log(spark, sf_dir)
    half = F.floor(row_count(table(spark, sf_dir, "events")) / 2)
    epoch = F.when(F.col("seq") < half, 1).when(F.pmod(F.col("seq"), F.lit(10)) == 0, 1).otherwise(2)
    return logged.withColumn("writer_epoch", epoch)


def half_way(spark: SparkSession, sf_dir: str) -> Column:
    """Log position of a checkpoint taken after half of the events."""
    return F.floor(row_count(table(spark, sf_dir, "events")) / 2) - 1


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slog.latest(op_log(spark, sf_dir))


def user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user: the truth table of the routing and rescale checks."""
    return events(spark, sf_dir).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.max("seq").alias("seq")
    )


CHECKPOINT_EVERY = 500


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint per 500 events: the flush point lies 20 rows behind the durable point.

    Even ones expire 900 s after they were taken, odd ones never.
    """
    e = table(spark, sf_dir, "events")
    i = F.floor(F.col("event_id") / CHECKPOINT_EVERY).cast("bigint")
    taken = e.groupBy(i.alias("i")).agg(F.max("event_id").alias("seq_hi"), F.max("ts").alias("create_ts"))
    return taken.select(
        F.concat(F.lit("chk-"), F.col("i").cast("string")).alias("checkpoint_id"),
        F.lit("events").alias("db_id"),
        "i",
        "seq_hi",
        (F.col("seq_hi") - 20).alias("manifest_seq_hi"),
        "create_ts",
        F.when(
            F.pmod(F.col("i"), F.lit(2)) == 0, F.col("create_ts") + F.expr("INTERVAL '900' SECOND")
        ).alias("expire_ts"),
    )
