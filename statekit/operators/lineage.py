"""Clones that share their ancestors' rows: nothing is copied, a clone reads what its ancestors had written by then.

A lineage has a row per database: ``db_id``, ``parent_id`` (null at a root), ``cut_seq`` (the position of the parent's log at
which the clone was taken; positions count in one log for all databases) and, for clones of a key range, ``lo_key``
(included) and ``hi_key`` (not included), null where open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statekit.operators import log
from statekit.session import durable

VIEW = ["db_id", "ancestor", "hops", "upto", "lo_key", "hi_key"]


def tighter(a: str, b: str) -> list[Column]:
    """Bounds of a path from those of its two halves: the least cut, the greatest lower and the least upper key."""
    return [
        F.least(f"{a}.upto", f"{b}.upto").alias("upto"),
        F.greatest(f"{a}.lo_key", f"{b}.lo_key").alias("lo_key"),
        F.least(f"{a}.hi_key", f"{b}.hi_key").alias("hi_key"),
    ]


def with_range(lineage: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in ("lo_key", "hi_key") if c not in lineage.columns}
    return lineage.withColumns(missing) if missing else lineage


def views(lineage: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """What each target database (default: all) reads: itself and every ancestor, with the position up to which and the
    keys between which it is read.

    Both bounds hold along the whole path: a clone of an old checkpoint does not see what its parent's parent wrote later,
    although the parent does. Each round doubles the distance that a pointer spans, so a chain of depth d takes log2(d)
    rounds; each is cut by a written table. The pointers are one row per database, so an ancestor that most clones share
    is on the unique side of the join and adaptive execution splits the other one. A parent that is not in the lineage, or
    a cycle, is an error.
    """
    spark = lineage.sparkSession
    edges = durable(spark, with_range(lineage).select("db_id", F.col("parent_id").alias("ancestor"), F.col("cut_seq").alias("upto"), "lo_key", "hi_key"), "lineage")
    total, unknown = edges.count(), edges.where("ancestor IS NOT NULL").join(edges.select(F.col("db_id").alias("ancestor")), "ancestor", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("lineage names a parent that is not in the table")
    names = edges.select("db_id") if targets is None else targets.select("db_id").distinct()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("upto", "long"), ("lo_key", "string"), ("hi_key", "string"))]
    seen = durable(spark, names.select("db_id", F.col("db_id").alias("ancestor"), F.lit(0).alias("hops"), *none), "views")
    jumps, span = edges.where("ancestor IS NOT NULL"), 1
    while not jumps.isEmpty():
        if span > total:
            raise ValueError("lineage has a cycle")
        # From everything up to span - 1 hops away, one jump of span hops further.
        path, jump = seen.alias("p"), jumps.alias("j")
        further = path.join(jump, F.col("p.ancestor") == F.col("j.db_id")).select("p.db_id", "j.ancestor", (F.col("p.hops") + span).alias("hops"), *tighter("p", "j"))
        seen = durable(spark, seen.unionByName(further), "views")
        first, second = jumps.alias("p"), jumps.alias("j")
        longer = first.join(second, F.col("p.ancestor") == F.col("j.db_id")).select("p.db_id", "j.ancestor", *tighter("p", "j"))
        jumps, span = durable(spark, longer, "jumps"), 2 * span
    return seen.select(*VIEW)


def state(changelog: DataFrame, seen: DataFrame) -> DataFrame:
    """State of the databases that ``seen`` (:func:`views`) tells of, with ``source_db``, the database that wrote the value.

    What a nearer database has settled hides what an ancestor says, a delete included. One aggregation with map-side
    combine; a row counts once for each target that reads it, so ask for the clones that are needed.
    """
    wide = F.broadcast(seen) if seen.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else seen
    rows = changelog.where(log.is_base()).withColumnRenamed("db_id", "source_db").join(wide.withColumnRenamed("ancestor", "source_db"), "source_db")
    known = (F.col("upto").isNull() | (F.col("seq") <= F.col("upto"))) & inside()
    at = F.struct(-F.col("hops"), "seq")
    columns = ["value", "seq", "create_ts", "expire_ts", "source_db"]
    newest = rows.where(known).groupBy("db_id", "key").agg(F.max_by(F.struct(F.col("op"), *columns), at).alias("_r"))
    return newest.where("_r.op = 'put'").select("db_id", "key", *[f"_r.{c}" for c in columns])


MOST_BROADCAST = 100_000


def inside() -> Column:
    """The key lies between the bounds; a null key only where there are none."""
    low = F.col("lo_key").isNull() | F.coalesce(F.col("key") >= F.col("lo_key"), F.lit(False))
    return low & (F.col("hi_key").isNull() | F.coalesce(F.col("key") < F.col("hi_key"), F.lit(False)))


def shared(seen: DataFrame) -> DataFrame:
    """Per database that others read: how many do, how near the nearest is, and between which positions they cut it off.

    Its rows up to ``last_upto`` must stay as long as these clones live.
    """
    others = seen.where("hops > 0").groupBy(F.col("ancestor").alias("db_id"))
    return others.agg(F.count(F.lit(1)).alias("readers"), F.min("hops").alias("nearest"), F.min("upto").alias("first_upto"), F.max("upto").alias("last_upto"))
