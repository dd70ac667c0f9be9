"""Metrics as a table ``(ts, name, labels MAP<STRING,STRING>, kind, value)`` and the reports over it.

Metric names and label sets are few and each holds a large part of the rows, so everything here
first shrinks the rows with map-side combine, and running values are computed in chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statekit.operators import chunks

RETRYABLE = ["Unavailable", "Transaction"]  # fixed values
FATAL = ["Closed", "Data", "Internal"]  # fixed values


def series(labels: Column | str) -> Column:
    """A map as JSON text with sorted keys: maps can be neither grouped nor compared."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def metric_catalog(metrics: DataFrame) -> DataFrame:
    """Per metric: kind, label keys, number of series, and its largest value as a sample.

    Rows shrink to one per series by a hash aggregation; only then are label keys looked at.
    """
    per_series = metrics.groupBy("name", "kind", series("labels").alias("_s")).agg(F.max("value").alias("_v"))
    labels = F.map_keys(F.from_json("_s", "map<string,string>"))
    keys = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(labels)))), ",")
    return per_series.groupBy("name", "kind").agg(
        keys.alias("label_keys"), F.count(F.lit(1)).alias("series"), F.max("_v").alias("sample")
    )


def bucket_columns(value: Column, bounds: list[float]) -> dict[str, Column]:
    """Counts per histogram bucket: value <= bound, and the rest."""
    out, low = {}, None
    for b in bounds:
        inside = value <= F.lit(b) if low is None else (value <= F.lit(b)) & (value > F.lit(low))
        out[f"le_{b:g}".replace(".", "_")] = F.count(F.when(inside, 1))
        low = b
    out["le_inf"] = F.count(F.when(value > F.lit(low), 1))
    return out


def histogram(df: DataFrame, by: str, value: str, bounds: list[float]) -> DataFrame:
    """Count, sum, min, max and bucket counts per series."""
    v = F.col(value)
    return df.groupBy(by).agg(
        F.count(v).alias("count"),
        F.sum(v).alias("sum"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        *[c.alias(n) for n, c in bucket_columns(v, bounds).items()],
    )


def quantiles(df: DataFrame, by: str, value: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles of an integer column: the smallest value with at least p of the rows at or below it.

    Rows are first counted per value, the counts are added up in value order in chunks, so no
    series has to fit in a task.
    """
    per_value = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = chunks.running_sum(per_value, [by], value, {"_upto": F.col("_n")}, few_keys=True)
    total = per_value.groupBy(by).agg(F.sum("_n").alias("_total"))
    placed = chunks.key_join(upto, total, [by], "inner")
    at = [
        F.min(F.when(F.col("_upto") >= F.ceil(F.lit(p) * F.col("_total")), F.col(value))).alias(n)
        for n, p in points.items()
    ]
    return placed.groupBy(by).agg(*at)


def hit_ratio(accesses: DataFrame) -> DataFrame:
    """Accesses ``(kind, result)`` counted over every combination, with totals as null.

    Counted before the cube, which then multiplies a handful of rows instead of the log.
    """
    counted = accesses.groupBy("kind", "result").agg(F.count(F.lit(1)).alias("_n"))
    hits = F.sum(F.when(F.col("result") == "hit", F.col("_n")).otherwise(0))
    return counted.cube("kind", "result").agg(
        F.sum("_n").alias("accesses"), (hits / F.sum("_n")).alias("hit_ratio")
    )


def up_down_gauge(deltas: DataFrame, by: list[str], seq: str, delta: Column, out: str = "gauge") -> DataFrame:
    """Gauge after every change of a series."""
    return chunks.running_sum(deltas, by, seq, {out: delta}, few_keys=True)


def lag_seconds(metrics: DataFrame, by: str, ts: str, now: Column) -> DataFrame:
    """Seconds since the last row of each series."""
    last = metrics.groupBy(by).agg(F.max(ts).alias("last_ts"))
    return last.withColumn("lag_s", F.timestamp_diff("SECOND", "last_ts", now))


def error_class(error: Column | str) -> Column:
    """``retryable`` or ``fatal``; an unknown error is fatal."""
    error = F.col(error) if isinstance(error, str) else error
    return F.when(error.isin(RETRYABLE), "retryable").otherwise("fatal")


def error_triage(errors: DataFrame, error: str = "error") -> DataFrame:
    counted = errors.groupBy(error).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("class", error_class(error)).withColumn("known", F.col(error).isin(RETRYABLE + FATAL))


def rates(log: DataFrame, by: list[str], failed: Column) -> DataFrame:
    """Requests, errors and error rate per label set."""
    bad = F.count(F.when(failed, 1))
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), bad.alias("errors"), (bad / F.count(F.lit(1))).alias("error_rate")
    )


def throughput(runs: DataFrame, by: list[str], micros: str) -> DataFrame:
    """Operations, mean microseconds and operations per second of a run log."""
    total = F.sum(micros)
    n = F.count(F.lit(1))
    return runs.groupBy(*by).agg(
        n.alias("ops"),
        (total.cast("double") / n).alias("us_per_op"),
        (n * F.lit(1e6) / total.cast("double")).alias("ops_per_s"),
    )


def by_name(catalog: DataFrame) -> DataFrame:
    """The catalog with ``pos``, its place by name; a catalog has a row per metric name, so one task numbers it."""
    return catalog.withColumn("pos", F.row_number().over(Window.orderBy("name")).cast("long")).orderBy("name")
