"""Reads of a state table: point, range and prefix, and the checks on keys and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_LIMIT = 65_535  # fixed value: most bytes in a key
VALUE_LIMIT = 4 * 1024**3 - 1  # fixed value: most bytes in a value


def get(keys: DataFrame, state: DataFrame, on: list[str] | str = "key") -> DataFrame:
    """Look up many keys in one join; an absent key gives null, metadata columns come along."""
    return keys.join(state, on, "left")


def get_one(state: DataFrame, key: object, on: str = "key") -> DataFrame:
    """Rows of a single key, as a pushed-down filter. For many keys use :func:`get`."""
    return state.where(F.col(on) == F.lit(key))


def key_range(
    df: DataFrame,
    column: str,
    start: object | None = None,
    end: object | None = None,
    start_inclusive: bool = True,
    end_inclusive: bool = False,
) -> DataFrame:
    """Rows with a key in the range; None leaves that side open."""
    c = F.col(column)
    if start is not None:
        df = df.where(c >= F.lit(start) if start_inclusive else c > F.lit(start))
    if end is not None:
        df = df.where(c <= F.lit(end) if end_inclusive else c < F.lit(end))
    return df


def scan_prefix(
    df: DataFrame, column: str, prefix: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Rows whose text key starts with a prefix, optionally narrowed to suffixes in [start, end)."""
    rows = df.where(F.col(column).startswith(prefix))
    return key_range(
        rows,
        column,
        None if start is None else prefix + start,
        None if end is None else prefix + end,
    )


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """Total key order; a range exchange, so it is asked for only when the reader needs it."""
    return df.orderBy(*columns)


def limit_verdict(key: Column, value: Column) -> Column:
    """``ok``, ``empty_key``, ``key_too_long`` or ``value_too_long``."""
    return (
        F.when(key.isNull() | (F.octet_length(key) == 0), "empty_key")
        .when(F.octet_length(key) > KEY_LIMIT, "key_too_long")
        .when(F.octet_length(value).cast("bigint") > VALUE_LIMIT, "value_too_long")
        .otherwise("ok")
    )


def split_by_limits(df: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows within the limits, rows beyond them with the reason)."""
    judged = df.withColumn("verdict", limit_verdict(F.col(key), F.col(value)))
    return judged.where("verdict = 'ok'").drop("verdict"), judged.where("verdict <> 'ok'")
