"""Queries over compaction, files, checkpoints, segments and lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statekit import session
from statekit.functions import routing as r
from statekit.operators import layout, log, upkeep
from statekit.plans.log import NOW, ST, dbl
from statekit.plans.registry import CHECKPOINTS, LOG, STATE, group_sql, query
from statekit.sources import files, inventory
from statekit.sources import tables as t


@query(f"WITH {LOG}, {STATE} SELECT {ST} FROM state WHERE expire_ts IS NULL OR expire_ts > {NOW}")
def compacted_state(spark, sf_dir):
    """A compaction written shard by shard and read back."""
    kept = upkeep.compact(t.op_log(spark, sf_dir), t.now())
    path = session.work_path(spark, "compact")
    files.write_by(kept.withColumn("shard", r.shard(r.key_group("key"))), path, "shard")
    return dbl(files.read_shards(spark, path).drop("shard"))


@query(f"""WITH {LOG},
v AS (
  SELECT key, count(*) AS versions, arg_max(op, seq) AS op,
    arg_max(coalesce(expire_ts, TIMESTAMP '9999-01-01'), seq) AS expire_ts
  FROM log WHERE op IN ('put', 'delete') GROUP BY key)
SELECT 'events' AS db_id, CAST(sum(versions) AS BIGINT) AS rows_before,
  count(*) FILTER (WHERE op = 'put' AND expire_ts > {NOW}) AS rows_after,
  CAST(sum(versions - 1) AS BIGINT) AS hidden_versions,
  count(*) FILTER (WHERE op = 'delete') AS tombstones,
  count(*) FILTER (WHERE op = 'put' AND expire_ts <= {NOW}) AS expired FROM v""")
def compact_report(spark, sf_dir):
    return upkeep.compact_report(t.op_log(spark, sf_dir), t.now())


@query(f"WITH {LOG}, {STATE} SELECT {ST}, CAST({group_sql('key')} // 8 AS INTEGER) AS shard FROM state")
def all_shards_scan(spark, sf_dir):
    """State written as shards and reassembled by reading all of them."""
    path = session.work_path(spark, "shards")
    state = t.state(spark, sf_dir).withColumn("shard", r.shard(r.key_group("key")))
    files.write_by(state, path, "shard")
    return dbl(files.read_shards(spark, path, state.schema))


FILES = """
l0 AS (
  SELECT event_id // 100 AS file_no, min(CAST(user_id AS VARCHAR)) AS min_key,
    max(CAST(user_id AS VARCHAR)) AS max_key, count(*) AS rows,
    CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, max(ts) AS create_ts
  FROM events GROUP BY 1),
files AS (
  SELECT 'L0-' || lpad(CAST(file_no AS VARCHAR), 20, '0') AS file_id, 'L0' AS level, * FROM l0
  UNION ALL
  SELECT 'SR-' || lpad(CAST(file_no // 10 AS VARCHAR), 20, '0'), 'SR', file_no // 10, min(min_key),
    max(max_key), CAST(sum(rows) AS BIGINT), CAST(sum(bytes) AS BIGINT), max(create_ts)
  FROM l0 GROUP BY file_no // 10),
top AS (SELECT max(event_id) // 1000 AS g FROM events),
live AS (
  SELECT file_id FROM files, top WHERE (level = 'SR' AND file_no < g) OR (level = 'L0' AND file_no // 10 = g)),
refs AS (
  SELECT checkpoint_id, 'L0-' || lpad(CAST(f AS VARCHAR), 20, '0') AS file_id
  FROM (SELECT checkpoint_id,
    unnest(range(manifest_seq_hi // 100 // 10 * 10, manifest_seq_hi // 100 + 1)) AS f FROM checkpoints)),
pins AS (
  SELECT DISTINCT file_id FROM refs JOIN checkpoints USING (checkpoint_id)
  WHERE expire_ts IS NULL OR expire_ts > now)"""
FILES_NOW = "TIMESTAMP '2024-01-30 12:00:00'"
FILES_SQL = FILES.replace("> now)", f"> {FILES_NOW})")


@query(f"""WITH {CHECKPOINTS}, {FILES_SQL}
SELECT file_id, level, rows, bytes, create_ts,
  CASE WHEN file_id IN (SELECT file_id FROM live) THEN 'live'
    WHEN file_id IN (SELECT file_id FROM pins) THEN 'pinned'
    WHEN create_ts > {FILES_NOW} - INTERVAL 6 HOUR THEN 'too_young' ELSE 'deletable' END AS status
FROM files""")
def orphans(spark, sf_dir):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    judged = upkeep.orphans(
        inventory.files(spark, sf_dir),
        inventory.manifest_refs(spark, sf_dir),
        inventory.checkpoint_refs(spark, sf_dir),
        t.checkpoints(spark, sf_dir),
        now,
        6 * 3600,
    )
    return judged.select("file_id", "level", "rows", "bytes", "create_ts", "status")


@query(f"""WITH {CHECKPOINTS}, {FILES_SQL}
SELECT level, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM files
WHERE file_id NOT IN (SELECT file_id FROM live) AND file_id NOT IN (SELECT file_id FROM refs) GROUP BY 1""")
def orphan_bytes(spark, sf_dir):
    """Files that neither the manifest nor any checkpoint names."""
    gone = upkeep.orphan_files(
        inventory.files(spark, sf_dir),
        inventory.manifest_refs(spark, sf_dir),
        inventory.checkpoint_refs(spark, sf_dir),
    )
    return gone.groupBy("level").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").cast("bigint").alias("bytes")
    )


@query(f"""WITH {CHECKPOINTS}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY create_ts DESC, checkpoint_id DESC) AS rn FROM checkpoints)
SELECT checkpoint_id, create_ts, expire_ts,
  CASE WHEN i % 3 = 0 AND coalesce(expire_ts <= {NOW}, FALSE) THEN 'unrestorable'
    WHEN i % 3 = 0 THEN 'referenced' WHEN rn <= 3 THEN 'newest'
    WHEN expire_ts IS NULL THEN 'leak' WHEN expire_ts <= {NOW} THEN 'expired'
    ELSE 'deletable' END AS status
FROM ranked""")
def checkpoint_retention(spark, sf_dir):
    """Jobs still refer to every third checkpoint; the three newest stay in any case."""
    cps = t.checkpoints(spark, sf_dir)
    retained = cps.where(F.pmod(F.col("i"), F.lit(3)) == 0)
    judged = upkeep.checkpoint_retention(cps, retained, 3, t.now())
    return judged.select("checkpoint_id", "create_ts", "expire_ts", "status")


@query(f"""WITH {CHECKPOINTS}
SELECT a.checkpoint_id, a.i, min(b.i) AS next_i, max(c.m) AS newest_i
FROM checkpoints a LEFT JOIN checkpoints b ON b.i > a.i AND b.i >= 2, (SELECT max(i) AS m FROM checkpoints) c
GROUP BY 1, 2""")
def newest_checkpoint(spark, sf_dir):
    """For every checkpoint the first newer one (not counting the first two) and the newest of all."""
    return log.newer_checkpoint(t.checkpoints(spark, sf_dir), least=2)


@query(f"WITH {LOG}, {STATE} SELECT {ST} FROM state WHERE CAST({group_sql('key')} // 8 AS INTEGER) <> 5")
def drop_segment(spark, sf_dir):
    """State as a partitioned table from which segment 5 is dropped."""
    name = f"segments_{uuid.uuid4().hex[:12]}"
    state = t.state(spark, sf_dir).withColumn("shard", r.shard(r.key_group("key")))
    (
        state.hint("rebalance", "shard")
        .write.partitionBy("shard")
        .option("path", session.work_path(spark, "segments"))
        .saveAsTable(name)
    )
    upkeep.drop_segment(spark, name, "shard", 5)
    rest = session.durable(spark, spark.table(name).drop("shard"), "rest")
    spark.sql(f"DROP TABLE {name}")
    return dbl(rest)


@query(f"WITH {LOG}, {STATE} SELECT {ST} FROM state WHERE NOT (key >= '2' AND key < '5')")
def range_tombstones(spark, sf_dir):
    """State after the keys of a range were deleted one by one."""
    whole = t.op_log(spark, sf_dir)
    in_range = (F.col("key") >= "2") & (F.col("key") < "5")
    after = t.row_count(t.table(spark, sf_dir, "events"))
    deletes = upkeep.range_tombstones(log.latest(whole), in_range, after)
    return dbl(log.latest(whole.unionByName(deletes, allowMissingColumns=True)))


@query("""WITH RECURSIVE chain AS (
  SELECT c_custkey AS db, 0 AS depth, c_custkey AS root FROM customer WHERE c_custkey < 4
  UNION ALL
  SELECT c.c_custkey, depth + 1, root FROM customer c JOIN chain ON c.c_custkey // 4 = db AND c.c_custkey >= 4),
kids AS (SELECT c_custkey // 4 AS db, count(*) AS clones FROM customer WHERE c_custkey >= 4 GROUP BY 1)
SELECT 'db-' || db AS db, CAST(depth AS INTEGER) AS depth, 'db-' || root AS root,
  coalesce(clones, 0) AS clones FROM chain LEFT JOIN kids USING (db)""")
def clone_chain(spark, sf_dir):
    """Every customer is a database; number n was cloned from number n div 4, the first four are roots."""
    c = t.table(spark, sf_dir, "customer")
    name = lambda n: F.concat(F.lit("db-"), n.cast("bigint").cast("string"))
    parent = F.when(F.col("c_custkey") >= 4, name(F.floor(F.col("c_custkey") / 4)))
    return upkeep.clone_chain(c.select(name(F.col("c_custkey")).alias("db_id"), parent.alias("parent_id")))


@query("""WITH l0 AS (SELECT event_id // 100 AS no, max(ts) AS ts FROM events GROUP BY 1),
steps AS (
  SELECT no * 2 AS seq, ts, 1 AS d FROM l0
  UNION ALL SELECT no * 2 + 1, ts, -10 FROM l0 WHERE no - 4 >= 9 AND (no - 3) % 10 = 0),
run AS (SELECT seq, ts, sum(d) OVER (ORDER BY seq) AS l0 FROM steps),
held AS (SELECT *, lag(l0) OVER (ORDER BY seq) AS p, lag(ts) OVER (ORDER BY seq) AS pts FROM run)
SELECT 'events' AS db_id, CAST(max(l0) AS BIGINT) AS max_l0, count(*) FILTER (WHERE l0 > 8) AS changes_above,
  CAST(coalesce(sum(date_diff('microsecond', pts, ts)) FILTER (WHERE p > 8), 0) AS BIGINT) AS us_above FROM held""")
def write_stall(spark, sf_dir):
    """L0 files merged ten at a time, four flushes late, against a limit of eight."""
    levels = upkeep.level_log(inventory.l0_files(spark, sf_dir), inventory.PER_RUN, 4)
    return upkeep.write_stall(levels, 8)


@query("""SELECT count(*) AS rows, min(event_id) AS min_key, max(event_id) AS max_key, TRUE AS sized FROM events""")
def file_inventory(spark, sf_dir):
    """Rows and key range per data file, added up; every file has a size."""
    per_file = files.file_rows(t.table(spark, sf_dir, "events"), "event_id")
    return per_file.agg(
        F.sum("rows").alias("rows"),
        F.min("min_key").alias("min_key"),
        F.max("max_key").alias("max_key"),
        F.bool_and(F.col("bytes") > 0).alias("sized"),
    )


@query("""SELECT doc_id, lang, md5(text) AS text_md5, CASE WHEN doc_id % 2 = 0 THEN 'Zstd' ELSE 'Snappy' END AS codec
FROM documents""")
def mixed_codec_read(spark, sf_dir):
    """Documents written half with one codec and half with another, read as one table."""
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    path = session.work_path(spark, "codecs")
    for rest, codec in ((0, "Zstd"), (1, "Snappy")):
        half = docs.where(F.pmod(F.col("doc_id"), F.lit(2)) == rest)
        files.write_state(half, f"{path}/codec={codec}", codec)
    both = files.read_mixed(spark, path)
    return both.select("doc_id", "lang", F.md5("text").alias("text_md5"), "codec")


@query("""SELECT codec, (SELECT count(*) FROM documents) AS rows, codec <> 'None' AS smaller, TRUE AS known_ratio
FROM (VALUES ('None'), ('Snappy'), ('Zlib'), ('Lz4'), ('Zstd')) v(codec)""")
def compression_report(spark, sf_dir):
    """Stored bytes per codec for the same documents, compared with no codec (figures: ``compression_sizes``)."""
    report = compression_sizes(spark, sf_dir)
    right = (F.col("ratio") == 1) == (F.col("codec") == "None")
    return report.select("codec", "rows", (F.col("ratio") > 1).alias("smaller"), right.alias("known_ratio"))


def compression_sizes(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    path = session.work_path(spark, "sizes")
    for codec in files.CODECS:
        files.write_state(docs, f"{path}/codec={codec}", codec)
    per_file = files.file_rows(files.read_mixed(spark, path), "doc_id", "codec")
    sizes = session.durable(spark, per_file.groupBy("codec").agg(
        F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files")
    ), "sizes")
    plain = sizes.where("codec = 'None'").agg(F.max("bytes")).scalar()
    return sizes.withColumn("ratio", plain / F.col("bytes"))


@query(f"""WITH {LOG}, {STATE}, placed AS (SELECT *, {group_sql('key')} AS key_group FROM state)
SELECT key_group, key, CAST(value AS DOUBLE) AS value FROM placed WHERE key_group BETWEEN 43 AND 85""")
def group_range_read(spark, sf_dir):
    """Rows of one subtask's group range, read from shards that do not line up with it."""
    path = session.work_path(spark, "groups")
    placed = layout.routed(t.state(spark, sf_dir))
    files.write_by(placed, path, "shard")
    rows = files.read_shards(spark, path, placed.schema)
    return dbl(files.group_range(rows, 43, 85).select("key_group", "key", "value"))
