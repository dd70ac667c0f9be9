"""Writers with a codec, partitioned state, mixed-codec reads and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statekit.functions import routing as r

CODECS = {"None": "none", "Snappy": "snappy", "Zlib": "gzip", "Lz4": "lz4_raw", "Zstd": "zstd"}  # fixed values


def rounds(keys: DataFrame, n: int) -> DataFrame:
    """Every row ``n`` times: a source without an offset that replays all of its input."""
    return keys.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(n))))


def sequence(spark: SparkSession, lo: int, hi: int) -> DataFrame:
    """Longs ``lo..hi``, both included."""
    return spark.range(lo, hi + 1)


def codec_option(codec: str) -> str:
    """Parquet codec for a codec name; the names are case-sensitive."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}, expected one of {', '.join(CODECS)}")
    return CODECS[codec]


def write_state(df: DataFrame, path: str, codec: str = "None", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", codec_option(codec)).parquet(path)


def write_by(df: DataFrame, path: str, column: str, codec: str = "Zstd", mode: str = "errorifexists", splits: Column | None = None) -> None:
    """Write state partitioned by a routing column, sorted by key inside each file.

    The rebalance hint lets Spark split a large shard over several tasks (and files) instead of
    handing all of it to one, and join small ones. It is void without adaptive execution, as in a stateful stream,
    where a shard is then one file. ``splits`` deals a shard by key over at most so many files, whatever the settings.
    """
    if splits is not None:
        placed = df.repartition(column, F.pmod(F.xxhash64("key"), splits))
    elif df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        placed = df.hint("rebalance", column)
    else:
        placed = df.repartition(column)
    (
        placed
        .sortWithinPartitions(column, "key")
        .write.mode(mode)
        .option("compression", codec_option(codec))
        .partitionBy(column)
        .parquet(path)
    )


def read_shards(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All shards as one table; shards that were never written are simply not there."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_mixed(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of different codecs as one table; each file carries its own codec."""
    return spark.read.parquet(*paths)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, changed) of every data file, without reading any content."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listing.select(
        F.substring_index("path", "/", -1).alias("file"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("changed"),
        "path",
    )


def file_rows(df: DataFrame, key: str, *by: str) -> DataFrame:
    """Inventory with contents: rows and key range of every file that a scan reads."""
    return df.groupBy(
        *by, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
    ).agg(
        F.count(F.lit(1)).alias("rows"), F.min(key).alias("min_key"), F.max(key).alias("max_key")
    )


def group_range(rows: DataFrame, lo: int, hi: int, groups: int = r.GROUPS, shards: int = r.SHARDS) -> DataFrame:
    """Rows of an inclusive group range: whole shards are pruned by partition, the edges by row group."""
    per = groups // shards
    return rows.where(
        F.col("shard").between(lo // per, hi // per) & F.col("key_group").between(lo, hi)
    )
