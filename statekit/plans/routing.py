"""Queries over key groups, shards and owners."""

from __future__ import annotations

from pyspark.sql import functions as F

from statekit.functions import routing as r
from statekit.operators import layout, log
from statekit.plans.registry import LOG, STATE, USERS, group_sql, query, ranges_sql
from statekit.sources import tables as t

G, P, S = r.GROUPS, 4, r.SHARDS

ROUTED = f"""
routed AS (
  SELECT *, {group_sql('key')} AS key_group FROM users),
placed AS (
  SELECT *, CAST(key_group // 8 AS INTEGER) AS shard, CAST(key_group * 4 // 128 AS INTEGER) AS owner
  FROM routed)"""


def users(spark, sf_dir):
    return layout.routed(layout.keyed_count(t.events(spark, sf_dir)), G, P, S)


@query(f"WITH {USERS}, {ROUTED} SELECT key, n, key_group, shard, owner FROM placed")
def keyed_count(spark, sf_dir):
    return users(spark, sf_dir)


@query(
    "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, "
    "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events"
)
def running_count(spark, sf_dir):
    return log.running_count(t.events(spark, sf_dir).select("key", "seq"), ["key"])


@query(
    f"WITH {USERS}, {ROUTED} SELECT key_group, count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows "
    "FROM placed GROUP BY 1"
)
def key_group_histogram(spark, sf_dir):
    return layout.size_by(users(spark, sf_dir), "key_group")


@query(f"""WITH {USERS}, {ROUTED}, {ranges_sql('ranges', G, P)}
SELECT subtask, lo, hi, count(key) AS keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows,
  min(key_group) AS first_group, max(key_group) AS last_group
FROM ranges LEFT JOIN placed ON key_group BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def owner_counts(spark, sf_dir):
    return layout.range_report(users(spark, sf_dir), G, P)


@query(
    f"WITH {USERS}, {ROUTED} SELECT shard, count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows "
    "FROM placed GROUP BY 1"
)
def shard_counts(spark, sf_dir):
    return layout.size_by(users(spark, sf_dir), "shard")


@query(f"""WITH {USERS}, {ROUTED}, {ranges_sql('ranges', G, 3)},
held AS (
  SELECT subtask, g // 8 AS shard, count(*) AS groups_held
  FROM ranges, range({G}) q(g) WHERE g BETWEEN lo AND hi GROUP BY 1, 2),
sized AS (SELECT shard, count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows FROM placed GROUP BY 1)
SELECT subtask, CAST(held.shard AS INTEGER) AS shard, groups_held,
  count(*) OVER (PARTITION BY held.shard) AS openers,
  coalesce(keys, 0) AS keys, coalesce(rows, 0) AS rows
FROM held LEFT JOIN sized ON held.shard = sized.shard""")
def owned_shards(spark, sf_dir):
    sized = layout.size_by(users(spark, sf_dir), "shard")
    held = layout.owned_shards(spark, G, 3, S)
    return held.join(sized, "shard", "left").fillna(0, ["keys", "rows"])


@query(f"""WITH {USERS}, routed AS (SELECT *, {group_sql('key')} AS key_group FROM users),
placed AS (
  SELECT *, key_group // (128 // 16) AS shard, key_group * 8 // 128 AS subtask FROM routed)
SELECT CAST(subtask AS INTEGER) AS subtask, count(DISTINCT shard) AS instances, count(*) AS keys,
  CAST(sum(n) AS BIGINT) AS rows
FROM placed GROUP BY 1""")
def instances_per_subtask(spark, sf_dir):
    placed = layout.routed(layout.keyed_count(t.events(spark, sf_dir)), G, 8, S)
    per_shard = placed.groupBy(F.col("owner").alias("subtask"), "shard").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")
    )
    return per_shard.groupBy("subtask").agg(
        F.count(F.lit(1)).alias("instances"),
        F.sum("keys").cast("bigint").alias("keys"),
        F.sum("rows").cast("bigint").alias("rows"),
    )


@query(f"""WITH {USERS}, {ROUTED},
sized AS (SELECT shard, count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows FROM placed GROUP BY 1)
SELECT CAST(s AS INTEGER) AS shard, CAST(s * 8 * 2 // 128 AS INTEGER) AS old_owner,
  CAST(s * 8 * 4 // 128 AS INTEGER) AS new_owner,
  (s * 8 * 2 // 128) <> (s * 8 * 4 // 128) AS moved,
  coalesce(keys, 0) AS keys, coalesce(rows, 0) AS rows, CAST(0 AS BIGINT) AS rows_rewritten
FROM range({S}) q(s) LEFT JOIN sized ON s = shard""")
def reshard_map(spark, sf_dir):
    sized = layout.size_by(users(spark, sf_dir), "shard")
    plan = layout.reshard_map(spark, G, S, 2, 4).join(sized, "shard", "left")
    # A shard is handed over whole: its files are opened by another subtask, not written again.
    return plan.fillna(0, ["keys", "rows"]).withColumn("rows_rewritten", F.lit(0).cast("bigint"))


@query(f"""WITH {USERS}, {ROUTED}, {ranges_sql('ranges', G, 3)}
SELECT subtask, lo, hi, CAST(0 AS INTEGER) AS gap_before, TRUE AS tiles, count(key) AS keys
FROM ranges LEFT JOIN placed ON key_group BETWEEN lo AND hi GROUP BY 1, 2, 3""")
def tiling_check(spark, sf_dir):
    report = layout.range_report(users(spark, sf_dir), G, 3)
    return layout.tiling_check(report.select("subtask", "lo", "hi", "keys"), G)


@query(f"""WITH {USERS} SELECT CAST(p AS INTEGER) AS parallelism, count(*) AS keys,
  CAST(0 AS BIGINT) AS out_of_bounds, CAST(0 AS BIGINT) AS misplaced
FROM users, (VALUES (1), (3), (4), (128)) v(p) GROUP BY 1""")
def ownership_check(spark, sf_dir):
    return layout.ownership_check(users(spark, sf_dir), G, [1, 3, 4, 128])


@query(f"""WITH {USERS}, {ROUTED},
enc AS (SELECT key_group, key,
  printf('%02X', key_group) || upper(hex(encode('s' || key))) AS encoded FROM placed)
SELECT key_group, count(*) AS keys, min(encoded) AS first_encoded, max(encoded) AS last_encoded,
  CAST(0 AS BIGINT) AS inversions
FROM enc GROUP BY 1""")
def encoded_key_order(spark, sf_dir):
    return layout.encoded_order(users(spark, sf_dir), G)


@query(f"""WITH {LOG}, {STATE},
sized AS (
  SELECT CAST({group_sql('key')} * 4 // 128 AS INTEGER) AS owner, count(*) AS keys,
    CAST(sum(octet_length(encode(key)) + octet_length(encode(CAST(value AS VARCHAR)))) AS BIGINT) AS bytes
  FROM state GROUP BY 1)
SELECT owner, keys, bytes, CAST(keys AS DOUBLE) / (SELECT max(keys) FROM sized) AS load FROM sized""")
def state_size(spark, sf_dir):
    placed = layout.routed(t.state(spark, sf_dir), G, P, S)
    size = F.octet_length("key") + F.octet_length(F.col("value").cast("string"))
    sized = placed.groupBy("owner").agg(
        F.count(F.lit(1)).alias("keys"), F.sum(size).cast("bigint").alias("bytes")
    )
    most = sized.agg(F.max("keys")).scalar()
    return sized.withColumn("load", F.col("keys").cast("double") / most)
