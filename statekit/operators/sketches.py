"""Quantile sketches per series and interval, which are stored and merged later in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 200


def sketch(df: DataFrame, by: list[str], value: str, size: int = SIZE) -> DataFrame:
    """One sketch of a few kB for each group, whatever its size: a hot series is a sketch per task before the shuffle."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of many intervals, generations or jobs as one for each group."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def rows(sketch: str = "sketch") -> Column:
    return F.kll_sketch_get_n_double(sketch)


def quantiles(sketches: DataFrame, points: dict[str, float]) -> DataFrame:
    """The quantiles that each sketch estimates, as columns named in ``points``."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(p)) for name, p in points.items()})


def rank_error(size: int = SIZE) -> float:
    """The share of rows by which an estimate's rank is off, at most, in 99 of 100 cases."""
    return 2.296 / size**0.9021  # fixed values of this family of sketches


def ranks(df: DataFrame, estimates: DataFrame, by: str, value: str, names: list[str]) -> DataFrame:
    """Per series: its rows, and the shares of them below and not above each estimate, counted exactly."""
    joined = df.select(by, F.col(value).cast("double").alias("_v")).join(F.broadcast(estimates.select(by, *names)), by)  # a row per series
    n = F.count("_v")
    counts = [(F.count_if(F.col("_v") < F.col(x)) / n).alias(f"{x}_below") for x in names] + [(F.count_if(F.col("_v") <= F.col(x)) / n).alias(f"{x}_upto") for x in names]
    return joined.groupBy(by).agg(n.alias("n"), *counts)
