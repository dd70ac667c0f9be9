"""Queries over hot and cold tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from statekit.operators import log, tiering
from statekit.plans.log import HALF, NOW, dbl
from statekit.plans.registry import LOG, STATE, query
from statekit.sources import tables as t

DAY = 24 * 3600 * 1000

TOUCHES = """
touched AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, ts,
    lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_ts,
    max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM events),
marked AS (
  SELECT *, coalesce(ts > prev_ts + INTERVAL 1 DAY, FALSE) AS by_gap,
    coalesce(seen - INTERVAL 1 MILLISECOND >= prev_ts + INTERVAL 1 DAY, FALSE) AS by_mark
  FROM touched)"""


def touches(spark, sf_dir):
    return t.events(spark, sf_dir).select("key", "seq", "ts")


@query(f"""WITH {TOUCHES}
SELECT key, seq, ts, prev_ts, date_diff('microsecond', prev_ts, ts) AS gap_us, by_gap AS promoted FROM marked""")
def touch_gaps(spark, sf_dir):
    return tiering.touch_gaps(touches(spark, sf_dir), DAY)


def tier_sql(flag):
    return f"""WITH {TOUCHES} SELECT key, count(*) AS n, count(*) FILTER (WHERE {flag}) AS promotions,
  count(*) FILTER (WHERE {flag}) + 1 AS demotions FROM marked GROUP BY 1"""


@query(tier_sql("by_gap"))
def tier_gap(spark, sf_dir):
    return tiering.tier_batch(touches(spark, sf_dir), DAY, "gap")


@query(tier_sql("by_mark"))
def tier_watermark(spark, sf_dir):
    return tiering.tier_batch(touches(spark, sf_dir), DAY, "watermark")


@query(f"""WITH {TOUCHES},
last AS (
  SELECT prev_ts AS ts FROM marked WHERE by_gap
  UNION ALL SELECT arg_max(ts, seq) FROM marked GROUP BY key),
due AS (SELECT ts + INTERVAL 1 DAY AS d FROM last)
SELECT CASE WHEN time_bucket(INTERVAL 1 HOUR, d) = d THEN d
  ELSE time_bucket(INTERVAL 1 HOUR, d) + INTERVAL 1 HOUR END AS fire_ts, count(*) AS keys
FROM due GROUP BY 1""")
def demotion_buckets(spark, sf_dir):
    return tiering.demotion_buckets(tiering.demotions(touches(spark, sf_dir), DAY), 3600)


@query(f"""WITH {LOG}, {HALF},
hot AS (
  SELECT * FROM (
    SELECT * FROM log WHERE op IN ('put', 'delete') AND seq > (SELECT seq_hi FROM half)
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op = 'put')
SELECT coalesce(hot.key, o.key) AS key,
  CAST(CASE WHEN hot.key IS NOT NULL THEN hot.value ELSE o.value END AS DOUBLE) AS value,
  CASE WHEN hot.key IS NOT NULL THEN 'hot' ELSE 'cold' END AS tier
FROM hot FULL JOIN old_state o ON hot.key = o.key""")
def hot_wins(spark, sf_dir):
    """Cold tier from the first half of the log, hot tier from the second."""
    whole, half = t.op_log(spark, sf_dir), t.half_way(spark, sf_dir)
    cold = log.latest(log.upto(whole, half))
    hot = log.latest(whole.where(F.col("seq") > half))
    return dbl(tiering.hot_wins(hot, cold))


@query(f"""WITH {LOG}, {STATE}
SELECT key, CAST(value AS DOUBLE) AS value, create_ts, create_ts + INTERVAL 3 DAY > {NOW} AS in_hot FROM state""")
def write_through(spark, sf_dir):
    both = tiering.write_through(t.state(spark, sf_dir), t.now(), 3 * DAY)
    return dbl(both.select("key", "value", "create_ts", "in_hot"))


@query(f"""SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n,
  CASE WHEN max(ts) + INTERVAL 1 DAY >= {NOW} THEN 'hot' ELSE 'cold' END AS tier
FROM events GROUP BY 1""")
def tier_at(spark, sf_dir):
    """Counter and tier of every key at the closing time."""
    counts = touches(spark, sf_dir).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("_last")
    )
    return tiering.by_tier(counts, "_last", t.now(), DAY).drop("_last")
