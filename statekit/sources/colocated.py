"""State tables stored by hash of their key, so that a join with them moves the other side only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from statekit.session import work_path


def store(df: DataFrame, name: str, keys: list[str], buckets: int, path: str) -> None:
    """Write a catalog table of ``buckets`` files, dealt by a hash of the keys and sorted by them.

    One shuffle now, none on this side at any later join, aggregation or window by these keys. ``buckets`` should leave
    files of about 100 MB to 1 GB and be the same for tables that are joined with each other.
    """
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)


@contextmanager
def stored(df: DataFrame, keys: list[str], buckets: int) -> Iterator[str]:
    """A table as by :func:`store` in the shared folder; its name leaves the catalog at the end."""
    spark, name = df.sparkSession, f"colocated_{uuid.uuid4().hex[:12]}"
    store(df, name, keys, buckets, work_path(spark, "colocated"))
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def lookup(batch: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a batch, or of a stream, with what the table holds for their keys; null where there is nothing.

    Merged rather than broadcast: the batch goes to the buckets, the table stays where it is.
    """
    return batch.join(table.hint("merge"), keys, "left")
