"""Files in the shared folder, opened by path inside a task or a source: footers and single row groups of Parquet files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.sources import files

GROUPS = "file string, file_bytes long, changed timestamp, row_group int, rows long, bytes long"
BOUNDS = "lo long, hi long, nulls long"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without scheme is local."""
    if uri.startswith("file:"):
        uri = uri.removeprefix("file:").replace("///", "/", 1)
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def parquet(uri: str) -> pq.ParquetFile:
    store, path = opened(uri)
    return pq.ParquetFile(store.open_input_file(path))


def as_long(value) -> int:
    """A bound as a number: whole numbers as they are, times as microseconds since 1970."""
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).value // 1000
    return int(value)


def row_groups(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A row per row group below ``path``: file (with its size and time), row_group, rows, bytes, and a struct ``(lo, hi, nulls)`` for each column.

    Only footers are read, each by the task that got the file's name. A bound is null where the writer left no figures;
    ``nulls`` is null where it did not count them. Columns are whole numbers or times.
    """
    bounds = ", ".join(f"`{c}` struct<{BOUNDS.replace(" ", ": ").replace(",: ", ", ")}>" for c in columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names in batches:
            for uri, size, changed in zip(names["path"], names["bytes"], names["changed"], strict=True):
                meta = parquet(uri).metadata
                at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                out = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    row = {"file": uri, "file_bytes": size, "changed": changed, "row_group": g, "rows": group.num_rows, "bytes": group.total_byte_size}
                    for name in columns:
                        found = group.column(at[name]).statistics
                        known = found is not None and found.has_min_max
                        row[name] = {
                            "lo": as_long(found.min) if known else None,
                            "hi": as_long(found.max) if known else None,
                            "nulls": found.null_count if found is not None and found.has_null_count else None,
                        }
                    out.append(row)
                yield pd.DataFrame(out, columns=["file", "file_bytes", "changed", "row_group", "rows", "bytes", *columns])

    names = files.file_inventory(spark, path).where(F.col("file").endswith(".parquet")).select("path", "bytes", "changed")
    return names.mapInPandas(read, f"{GROUPS}, {bounds}" if columns else GROUPS)
