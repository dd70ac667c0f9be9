"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def suggested_conf(input_bytes: int) -> dict[str, str]:
    """Settings for a job over so many bytes: shuffle partitions of about 128 MB before adaptive
    execution joins small ones, larger scan splits, and skewed joins split even at an extra shuffle."""
    mb = 1 << 20
    return {
        **CONF,
        "spark.sql.shuffle.partitions": str(max(200, input_bytes // (128 * mb))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }


def local_session(cores: int | str = "*", **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster job brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("statekit")
    conf = {**CONF, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", **extra}
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only on a local master."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        root = context.getCheckpointDir()
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{checkpoint_root(spark).rstrip('/')}/statekit/{name}-{uuid.uuid4().hex[:12]}"


def durable(spark: SparkSession, df, name: str = "cut"):
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage so that a table read several times is computed once, and so that a lost
    executor costs a re-read instead of a recomputation.
    """
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
