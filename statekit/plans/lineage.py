"""Queries over clones that share their ancestors' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from statekit.operators import lineage
from statekit.plans.log import dbl
from statekit.plans.registry import LOG, query
from statekit.sources import tables as t

# Six databases, each cloned from the one before at the end of a sixth of the log, and a seventh cloned from the last at a
# position in the middle. In the i-th sixth the databases 0 to i write in turn, so parents go on after they were cloned.
FAMILY = f"""{LOG},
written AS (SELECT log.* EXCLUDE (db_id), CAST(seq % (seq * 6 // n + 1) AS INTEGER) AS no FROM log, cnt WHERE op IN ('put', 'delete')),
cuts AS (SELECT k AS no, CAST(CASE k WHEN 6 THEN n // 2 ELSE (k * n + 5) // 6 - 1 END AS BIGINT) AS cut FROM cnt, range(1, 7) r(k)),
seen AS (
  SELECT target, a, (SELECT min(cut) FROM cuts WHERE no > a AND no <= target) AS upto
  FROM (VALUES (5), (6)) v(target), range(0, 7) r(a) WHERE a <= target)"""


def family(spark, sf_dir):
    """The op log dealt to the databases db-0 to db-5, and the lineage of db-0 to db-6."""
    n = t.row_count(t.table(spark, sf_dir, "events"))
    ops = t.op_log(spark, sf_dir)
    name = lambda no: F.concat(F.lit("db-"), no.cast("int").cast("string"))
    written = ops.withColumn("db_id", name(F.pmod(F.col("seq"), F.floor(F.col("seq") * 6 / n) + 1)))
    no = F.col("id")
    cut = F.when(no == 6, F.floor(n / 2)).when(no > 0, F.floor((no * n + 5) / 6) - 1).cast("bigint")
    tree = spark.range(7).select(name(no).alias("db_id"), F.when(no > 0, name(no - 1)).alias("parent_id"), cut.alias("cut_seq"))
    return written, tree


@query(f"""WITH {FAMILY},
newest AS (
  SELECT target, key, op, value, seq, create_ts, expire_ts, no FROM written JOIN seen ON no = a
  WHERE upto IS NULL OR seq <= upto QUALIFY row_number() OVER (PARTITION BY target, key ORDER BY no DESC, seq DESC) = 1)
SELECT 'db-' || target AS db_id, key, CAST(value AS DOUBLE) AS value, seq, create_ts, expire_ts, 'db-' || no AS source_db
FROM newest WHERE op = 'put'""")
def clone_state(spark, sf_dir):
    """State of a clone five generations deep, and of a clone of an older position of it, without a copied row."""
    written, tree = family(spark, sf_dir)
    targets = tree.where("db_id IN ('db-5', 'db-6')")
    return dbl(lineage.state(written, lineage.views(tree, targets)))


CUT = "CAST((c_custkey * 7919) % 1000 AS BIGINT)"


@query(f"""WITH RECURSIVE seen AS (
  SELECT c_custkey AS db, c_custkey AS a, 0 AS hops, CAST(NULL AS BIGINT) AS upto FROM customer
  UNION ALL
  SELECT db, a // 4, hops + 1, least(upto, {CUT.replace('c_custkey', 'a')}) FROM seen WHERE a >= 4)
SELECT 'db-' || a AS db_id, count(*) AS readers, CAST(min(hops) AS INTEGER) AS nearest, min(upto) AS first_upto, max(upto) AS last_upto
FROM seen WHERE hops > 0 GROUP BY a""")
def clone_readers(spark, sf_dir):
    """Every customer is a database; number n was cloned from number n div 4. Who still reads which parent, and how far."""
    c = t.table(spark, sf_dir, "customer")
    name = lambda n: F.concat(F.lit("db-"), n.cast("bigint").cast("string"))
    parent = F.when(F.col("c_custkey") >= 4, name(F.floor(F.col("c_custkey") / 4)))
    cut = F.when(F.col("c_custkey") >= 4, F.pmod(F.col("c_custkey") * 7919, F.lit(1000))).cast("bigint")
    tree = c.select(name(F.col("c_custkey")).alias("db_id"), parent.alias("parent_id"), cut.alias("cut_seq"))
    return lineage.shared(lineage.views(tree))
