"""Queries over change logs and point-in-time state."""

from __future__ import annotations

from pyspark.sql import functions as F

from statekit import session
from statekit.operators import log, records, scans
from statekit.plans.registry import CHECKPOINTS, LOG, STATE, query
from statekit.sources import tables as t


def dbl(df, *columns):
    """Decimals as doubles, the form in which results leave a query."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns or ("value",)})


ST = "db_id, key, CAST(value AS DOUBLE) AS value, seq, create_ts, expire_ts"

HALF = """
half AS (SELECT (n // 2) - 1 AS seq_hi FROM cnt),
old_newest AS (
  SELECT * FROM log WHERE op IN ('put', 'delete') AND seq <= (SELECT seq_hi FROM half)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
old_state AS (SELECT db_id, key, value, seq, create_ts, expire_ts FROM old_newest WHERE op = 'put')"""

BASED = """
last_base AS (SELECT key, max(seq) AS base_seq FROM log WHERE op IN ('put', 'delete') GROUP BY key),
counted AS (
  SELECT log.*, base_seq FROM log LEFT JOIN last_base USING (key)
  WHERE op IN ('put', 'merge') AND (base_seq IS NULL OR seq >= base_seq))"""


@query(f"WITH {LOG}, {STATE} SELECT {ST} FROM state")
def latest_state(spark, sf_dir):
    return dbl(t.state(spark, sf_dir))


@query(f"WITH {LOG}, {HALF} SELECT {ST} FROM old_state")
def state_at_checkpoint(spark, sf_dir):
    return dbl(log.resolve(t.op_log(spark, sf_dir), as_of=t.half_way(spark, sf_dir)))


@query(f"""WITH {CHECKPOINTS}
SELECT checkpoint_id, db_id, count(*) AS durable_rows,
  count(*) FILTER (WHERE event_id <= manifest_seq_hi) AS captured_rows,
  count(*) FILTER (WHERE event_id > manifest_seq_hi) AS lost_rows
FROM checkpoints JOIN events ON event_id // 500 = i GROUP BY 1, 2""")
def durable_not_captured(spark, sf_dir):
    """Rows since the previous checkpoint that were durable, and those its manifest had not caught."""
    i = F.floor(F.col("event_id") / t.CHECKPOINT_EVERY).cast("bigint")
    rows = t.table(spark, sf_dir, "events").select(F.lit("events").alias("db_id"), i.alias("i"), F.col("event_id").alias("seq"))
    return log.capture_report(rows, t.checkpoints(spark, sf_dir))


@query(f"""WITH {LOG}, {STATE}, {HALF}
SELECT {ST} FROM (SELECT * FROM state EXCEPT ALL SELECT * FROM old_state)""")
def resurrected_writes(spark, sf_dir):
    """Rows that reopening the live table would bring back, compared with the pinned clone."""
    pinned = log.resolve(t.op_log(spark, sf_dir), as_of=t.half_way(spark, sf_dir))
    return dbl(t.state(spark, sf_dir).exceptAll(pinned))


@query(f"""WITH {LOG},
marked AS (
  SELECT *, last_value(CASE WHEN op IN ('put', 'delete') THEN seq END IGNORE NULLS) OVER (
    PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM log)
SELECT m.db_id, m.key, m.seq, CAST(CASE WHEN l.op = 'put' THEN l.value END AS DOUBLE) AS value
FROM marked m LEFT JOIN log l ON m.w = l.seq WHERE m.op = 'get'""")
def read_your_writes(spark, sf_dir):
    return dbl(log.read_your_writes(t.op_log(spark, sf_dir)))


@query(f"""WITH {LOG}, base AS (SELECT * FROM log WHERE op IN ('put', 'delete')),
asked AS (
  SELECT event_id AS lookup_id, CAST(user_id AS VARCHAR) AS key, event_id - 500 AS at_seq FROM events)
SELECT 'events' AS db_id, asked.key, at_seq, lookup_id,
  CAST(CASE WHEN op = 'put' THEN value END AS DOUBLE) AS value,
  CASE WHEN op = 'put' THEN seq END AS value_seq
FROM asked ASOF LEFT JOIN base ON asked.key = base.key AND asked.at_seq >= base.seq""")
def asof_read(spark, sf_dir):
    """For every event: what its user's state was 500 log positions earlier."""
    lookups = t.events(spark, sf_dir).select(
        F.lit("events").alias("db_id"),
        "key",
        (F.col("seq") - 500).alias("at_seq"),
        F.col("seq").alias("lookup_id"),
    )
    return dbl(log.asof_read(lookups, t.op_log(spark, sf_dir), unique=True))


@query(f"""WITH {LOG}, base AS (SELECT * FROM log WHERE op IN ('put', 'delete')),
asked AS (SELECT o_orderkey AS lookup_id, CAST(o_custkey AS VARCHAR) AS key,
  (SELECT max(event_id) FROM events) // 2 AS at_seq FROM orders)
SELECT 'events' AS db_id, asked.key, at_seq, lookup_id,
  CAST(CASE WHEN op = 'put' THEN value END AS DOUBLE) AS value,
  CASE WHEN op = 'put' THEN seq END AS value_seq
FROM asked ASOF LEFT JOIN base ON asked.key = base.key AND asked.at_seq >= base.seq""")
def asof_orders(spark, sf_dir):
    """For every order: the state of its customer's key at one position; many orders ask the same."""
    middle = F.floor(t.table(spark, sf_dir, "events").agg(F.max("event_id")).scalar() / 2)
    lookups = t.table(spark, sf_dir, "orders").select(
        F.lit("events").alias("db_id"),
        F.col("o_custkey").cast("string").alias("key"),
        middle.alias("at_seq"),
        F.col("o_orderkey").alias("lookup_id"),
    )
    return dbl(log.asof_read(lookups, t.op_log(spark, sf_dir)))


@query(f"""WITH {LOG}, {BASED}
SELECT db_id, key, count(*) FILTER (WHERE op = 'merge') AS merges FROM counted GROUP BY 1, 2""")
def merge_counter(spark, sf_dir):
    return log.fold(t.op_log(spark, sf_dir)).select("db_id", "key", "merges")


FOLDED = """SELECT db_id, key, CAST(sum(value) AS DOUBLE) AS value,
  count(*) FILTER (WHERE op = 'merge') AS merges, max(seq) AS seq FROM counted GROUP BY 1, 2"""


@query(f"WITH {LOG}, {BASED} {FOLDED}")
def merge_sum(spark, sf_dir):
    return dbl(log.fold(t.op_log(spark, sf_dir)))


@query(f"WITH {LOG}, {BASED} SELECT db_id, key, CAST(max(value) AS DOUBLE) AS value FROM counted GROUP BY 1, 2")
def merge_custom(spark, sf_dir):
    """A merge function of the user's own: here the largest operand."""
    return log.fold_with(t.op_log(spark, sf_dir), lambda values: values.max())


@query(f"""WITH {LOG}, {STATE}, l AS (SELECT max(event_id) // 1000 AS g FROM events)
SELECT db_id, key, CAST(value AS DOUBLE) AS value, seq,
  CAST(CASE WHEN seq // 1000 = g THEN 0 ELSE 1 END AS INTEGER) AS level FROM state, l""")
def newest_first_merge(spark, sf_dir):
    """Newest layer first: the last thousand positions are still unmerged, the rest lies in runs."""
    last = t.table(spark, sf_dir, "events").agg(F.max("event_id")).scalar()
    layered = t.op_log(spark, sf_dir).withColumn(
        "level", F.when(F.floor(F.col("seq") / 1000) == F.floor(last / 1000), 0).otherwise(1)
    )
    return dbl(log.newest_first(layered, "level"))


@query(f"""WITH {LOG}, {BASED}
SELECT DISTINCT db_id, key, json_extract_string(props, '$.k') AS element FROM counted""")
def merge_set(spark, sf_dir):
    return log.fold_set(t.op_log(spark, sf_dir), F.get_json_object("props", "$.k"))


@query(f"WITH {LOG}, {BASED} {FOLDED}")
def incremental_merge(spark, sf_dir):
    """Fold half of the log, then fold the other half into it: equal to one fold over everything."""
    whole = t.op_log(spark, sf_dir)
    half = t.half_way(spark, sf_dir)
    stored = session.durable(spark, log.fold(log.upto(whole, half)), "folded")
    return dbl(log.fold_into(stored, whole.where(F.col("seq") > half)))


@query(f"""WITH {LOG},
seen AS (SELECT *, max(writer_epoch) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS e FROM log)
SELECT db_id, key, seq, writer_epoch FROM seen WHERE writer_epoch < e""")
def fenced_writes(spark, sf_dir):
    fenced = log.fence(t.epoch_log(spark, sf_dir)).where("NOT accepted")
    return fenced.select("db_id", "key", "seq", "writer_epoch")


@query(f"""WITH {LOG},
seen AS (SELECT *, max(writer_epoch) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS e FROM log),
newest AS (
  SELECT * FROM seen WHERE op IN ('put', 'delete') AND writer_epoch >= e
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
SELECT {ST} FROM newest WHERE op = 'put'""")
def fenced_state(spark, sf_dir):
    """State from accepted writes only."""
    return dbl(log.latest(log.fence(t.epoch_log(spark, sf_dir)).where("accepted")))


NOW = f"TIMESTAMP '{t.NOW}'"


@query(f"WITH {LOG}, {STATE} SELECT {ST} FROM state WHERE expire_ts IS NULL OR expire_ts > {NOW}")
def ttl_read_filter(spark, sf_dir):
    return dbl(log.ttl_view(t.state(spark, sf_dir), t.now(), "read_filter"))


@query(f"WITH {LOG}, {STATE} SELECT {ST}, coalesce(expire_ts <= {NOW}, FALSE) AS expired FROM state")
def ttl_lazy(spark, sf_dir):
    """Expired rows are still returned until a compaction drops them; marked here."""
    shown = log.ttl_view(t.state(spark, sf_dir), t.now(), "lazy")
    gone = F.coalesce(F.col("expire_ts") <= t.now(), F.lit(False))
    return dbl(shown.withColumn("expired", gone))


@query(f"""WITH {LOG}, replayed AS (
  SELECT * FROM log UNION ALL SELECT * FROM log WHERE op <> 'get'),
edge AS (SELECT (n // 4) - 1 AS last_flushed FROM cnt)
SELECT DISTINCT db_id, key, op, CAST(value AS DOUBLE) AS value, seq
FROM replayed WHERE seq > (SELECT last_flushed FROM edge)""")
def replay_dedupe(spark, sf_dir):
    """A log whose writes arrive twice, replayed after the flushed quarter: every row once."""
    whole = t.op_log(spark, sf_dir).select("db_id", "key", "op", "value", "seq")
    twice = whole.unionByName(whole.where("op <> 'get'"))
    flushed = F.floor(t.row_count(t.table(spark, sf_dir, "events")) / 4) - 1
    return dbl(log.replay_dedupe(twice, flushed))


@query(f"""WITH {LOG},
cut AS (
  SELECT key, event_type, seq, 1 + coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
    OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS epoch FROM log),
ends AS (SELECT key, count(*) AS last FROM log WHERE event_type = 'signup' GROUP BY 1),
per AS (
  SELECT cut.key, epoch, event_type, count(*) AS c FROM cut JOIN ends ON cut.key = ends.key
  WHERE event_type <> 'signup' AND epoch <= last GROUP BY 1, 2, 3)
SELECT key, CAST(epoch AS BIGINT) AS epoch, event_type,
  CAST(sum(c) OVER (PARTITION BY key, event_type ORDER BY epoch) AS BIGINT) AS n FROM per""")
def barrier_snapshot(spark, sf_dir):
    """Each user is a stream, each signup a barrier in it: counts per event type at every barrier."""
    return log.barrier_counts(t.events(spark, sf_dir), "key", "event_type", "signup")


@query(
    "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1"
)
def control_records(spark, sf_dir):
    data = log.drop_control(t.events(spark, sf_dir), "event_type", "signup")
    return data.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LOG}, {CHECKPOINTS},
moves AS (
  SELECT key, seq, op = 'put' AS live,
    coalesce(lag(op) OVER (PARTITION BY key ORDER BY seq) = 'put', FALSE) AS was
  FROM log WHERE op IN ('put', 'delete')),
per AS (
  SELECT seq // 500 AS i, sum(CAST(live AS INTEGER) - CAST(was AS INTEGER)) AS d FROM moves GROUP BY 1)
SELECT checkpoint_id, seq_hi,
  CAST(sum(coalesce(d, 0)) OVER (ORDER BY checkpoints.i) AS BIGINT) AS live_keys
FROM checkpoints LEFT JOIN per ON checkpoints.i = per.i""")
def checkpoint_live_keys(spark, sf_dir):
    """Live keys of every checkpoint in one pass over the log, without resolving each of them."""
    return log.live_keys_at(t.op_log(spark, sf_dir), t.checkpoints(spark, sf_dir), t.CHECKPOINT_EVERY)


@query(f"""WITH {LOG}, {STATE}
SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(value AS DOUBLE) AS value, seq, create_ts, expire_ts
FROM customer LEFT JOIN state ON CAST(c_custkey AS VARCHAR) = key""")
def point_lookup(spark, sf_dir):
    """State of every customer; null where the key is absent."""
    keys = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return dbl(scans.get(keys, t.state(spark, sf_dir).drop("db_id")))


@query(f"""WITH {LOG}, {STATE}
SELECT key, CAST(value AS DOUBLE) AS value, seq FROM state WHERE key >= '2' AND key < '5'""")
def range_scan(spark, sf_dir):
    rows = scans.key_range(t.state(spark, sf_dir), "key", "2", "5")
    return dbl(scans.ordered(rows.select("key", "value", "seq"), "key"))


@query(f"""WITH {LOG}, {STATE}
SELECT key, CAST(value AS DOUBLE) AS value, seq FROM state
WHERE starts_with(key, '1') AND key >= '12' AND key < '17'""")
def prefix_scan(spark, sf_dir):
    rows = scans.scan_prefix(t.state(spark, sf_dir), "key", "1", "2", "7")
    return dbl(rows.select("key", "value", "seq"))


@query("""
SELECT CASE WHEN url IS NULL OR octet_length(encode(url)) = 0 THEN 'empty_key'
    WHEN octet_length(encode(url)) > 65535 THEN 'key_too_long'
    WHEN octet_length(encode(html)) > 4294967295 THEN 'value_too_long' ELSE 'ok' END AS verdict,
  count(*) AS n, CAST(sum(octet_length(encode(html))) AS BIGINT) AS value_bytes,
  CAST(max(octet_length(encode(url))) AS INTEGER) AS longest_key
FROM pages GROUP BY 1""")
def key_limits(spark, sf_dir):
    """Pages as key (url) and value (html), judged by the size limits."""
    judged = t.table(spark, sf_dir, "pages").select(
        scans.limit_verdict(F.col("url"), F.col("html")).alias("verdict"), "url", "html"
    )
    return judged.groupBy("verdict").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length("html")).cast("bigint").alias("value_bytes"),
        F.max(F.octet_length("url")).alias("longest_key"),
    )


ORDERS = "CAST(o_custkey AS VARCHAR) AS key, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderpriority AS tag, o_orderkey AS seq"


def order_updates(spark, sf_dir):
    return t.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("key"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.col("o_orderpriority").alias("tag"),
        F.col("o_orderkey").alias("seq"),
    )


@query(f"""WITH u AS (SELECT {ORDERS} FROM orders)
SELECT key, CAST(sum(amount) AS DOUBLE) AS balance, count(tag) AS tags,
  arg_min(tag, seq) AS first_tag, arg_max(tag, seq) AS last_tag FROM u GROUP BY 1""")
def record_rmw(spark, sf_dir):
    return dbl(records.record_rmw(order_updates(spark, sf_dir)), "balance")


@query(f"""WITH u AS (SELECT {ORDERS} FROM orders)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS pos, tag FROM u""")
def record_tags(spark, sf_dir):
    return records.record_tags(order_updates(spark, sf_dir))


@query("""SELECT event_id AS seq, json_extract_string(props, '$.k') AS k,
  '{"max_files":' || json_extract_string(props, '$.k') || ',"poll":"' || event_type || '"}' AS settings,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS max_files FROM events""")
def settings_json(spark, sf_dir):
    """Settings as JSON, numbers bare and text quoted, written from one document and read again."""
    k = F.get_json_object("props", "$.k")
    doc = F.to_json(F.struct(k.cast("bigint").alias("max_files"), F.col("event_type").alias("poll")))
    rows = t.events(spark, sf_dir).select("seq", k.alias("k"), doc.alias("settings"))
    back = F.from_json("settings", "max_files bigint, poll string")
    return rows.withColumn("max_files", back["max_files"])


@query(f"""WITH {LOG}, d AS (SELECT key, seq, count(*) AS c FROM log GROUP BY 1, 2 HAVING count(*) > 1)
SELECT count(*) AS rows, (SELECT count(*) FROM d) AS duplicates, count(DISTINCT key) AS keys FROM log""")
def unique_positions(spark, sf_dir):
    """Every position of a key is used once, which the ordered operators rely on."""
    ops = t.op_log(spark, sf_dir)
    keys = ops.groupBy("db_id", "key").agg(F.count(F.lit(1)).alias("n"))
    twice = log.duplicate_positions(ops).agg(F.count(F.lit(1))).scalar()
    return keys.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys")).withColumn("duplicates", twice)


@query(f"""WITH {LOG}, {HALF} SELECT 'events' AS db_id, 'chk-now' AS checkpoint_id, max(seq) AS seq_hi,
  (SELECT seq_hi FROM half) AS manifest_seq_hi, max(create_ts) AS create_ts,
  CAST(NULL AS TIMESTAMP) AS expire_ts FROM log""")
def take_checkpoint(spark, sf_dir):
    """A checkpoint of the whole log whose manifest has only caught up with half of it."""
    flushed = t.half_way(spark, sf_dir)
    return log.checkpoint(t.op_log(spark, sf_dir), "chk-now", flushed)


@query(f"""WITH {LOG}, base AS (SELECT * FROM log WHERE op IN ('put', 'delete')),
asked AS (SELECT event_id AS lookup_id, CAST(user_id AS VARCHAR) AS key, ts - INTERVAL 90 MINUTE AS at_ts FROM events)
SELECT 'events' AS db_id, asked.key, lookup_id, at_ts, CAST(CASE WHEN op = 'put' THEN value END AS DOUBLE) AS value
FROM asked ASOF LEFT JOIN base ON asked.key = base.key AND asked.at_ts >= base.create_ts""")
def asof_time(spark, sf_dir):
    """For every event: what its user's state was ninety minutes earlier."""
    lookups = t.events(spark, sf_dir).select(
        F.lit("events").alias("db_id"),
        "key",
        F.col("seq").alias("lookup_id"),
        (F.col("ts") - F.expr("INTERVAL '90' MINUTE")).alias("at_ts"),
    )
    return dbl(log.asof_time(lookups, t.op_log(spark, sf_dir)))


@query(f"""WITH {LOG}, {HALF}
SELECT 'copy' AS db_id, key, CAST(value AS DOUBLE) AS value, seq FROM old_state WHERE key >= '2' AND key < '5'
UNION ALL SELECT 'copy', key || '-new', CAST(value AS DOUBLE), seq FROM old_state WHERE key >= '2' AND key < '5'
UNION ALL SELECT 'events', key, CAST(value AS DOUBLE), seq FROM old_state""")
def clone_range(spark, sf_dir):
    """Keys from 2 to 5 cloned at a checkpoint; the clone is written to and its origin is not changed by that."""
    changes, flushed = t.op_log(spark, sf_dir), t.half_way(spark, sf_dir)
    copy = log.clone(changes, flushed, "copy", "2", "5")
    more = copy.withColumn("key", F.concat("key", F.lit("-new")))
    every = log.captured(changes, flushed).unionByName(copy).unionByName(more)
    return dbl(log.latest(every).select("db_id", "key", "value", "seq"))


@query(f"""WITH {LOG} SELECT key, op, seq, CAST(value AS DOUBLE) AS value FROM log, cnt WHERE seq BETWEEN n // 4 AND n // 2""")
def change_feed_table(spark, sf_dir):
    """The changes of a table between two positions of its log."""
    n = t.row_count(t.table(spark, sf_dir, "events"))
    return dbl(log.change_feed(t.op_log(spark, sf_dir), F.floor(n / 4), F.floor(n / 2)).select("key", "op", "seq", "value"))
