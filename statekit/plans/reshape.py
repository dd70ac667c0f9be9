"""Queries over split, merge and rescale."""

from __future__ import annotations

from pyspark.sql import functions as F

from statekit.functions import routing as r
from statekit.operators import layout, reshape
from statekit.plans.log import dbl
from statekit.plans.registry import USERS, group_sql, query, ranges_sql
from statekit.sources import tables as t

G = r.GROUPS
ROUTED = f"routed AS (SELECT *, {group_sql('key')} AS key_group FROM users)"


def routed_users(spark, sf_dir):
    return t.user_counts(spark, sf_dir).withColumn("key_group", r.key_group("key", G))


def customer_state(spark, sf_dir):
    """Customers as ``key-0000000042 -> name``."""
    return t.table(spark, sf_dir, "customer").select(
        r.fixed_width("key-", F.col("c_custkey"), 10).alias("key"),
        F.col("c_name").alias("value"),
        F.col("c_custkey").alias("seq"),
    )


CUSTOMERS = """
cust AS (
  SELECT 'key-' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS key, c_name AS value, c_custkey AS seq
  FROM customer),
bound AS (SELECT 'key-' || lpad(CAST(count(*) // 2 AS VARCHAR), 10, '0') AS b FROM customer)"""


def boundary(spark, sf_dir):
    half = F.floor(t.row_count(t.table(spark, sf_dir, "customer")) / 2)
    return r.fixed_width("key-", half, 10)


@query(f"""WITH {CUSTOMERS}
SELECT CASE WHEN key < b THEN 'lo' ELSE 'hi' END AS side, count(*) AS rows, min(key) AS first_key,
  max(key) AS last_key FROM cust, bound GROUP BY 1""")
def split_counts(spark, sf_dir):
    lo, hi = reshape.split(customer_state(spark, sf_dir), boundary(spark, sf_dir))
    sides = lo.withColumn("side", F.lit("lo")).unionByName(hi.withColumn("side", F.lit("hi")))
    return sides.groupBy("side").agg(
        F.count(F.lit(1)).alias("rows"), F.min("key").alias("first_key"), F.max("key").alias("last_key")
    )


@query(f"WITH {CUSTOMERS} SELECT key, value, seq FROM cust")
def union_shards(spark, sf_dir):
    """Split at the middle and merge again: every row once."""
    lo, hi = reshape.split(customer_state(spark, sf_dir), boundary(spark, sf_dir))
    ranges = r.subtask_ranges(spark, G, 2).withColumn("db_id", F.concat(F.lit("part-"), "subtask"))
    return reshape.union_shards([lo, hi], ranges)


@query(f"""WITH {CUSTOMERS},
news AS (
  SELECT 'key-' || lpad(CAST((SELECT max(seq) FROM cust) - 49 + s_suppkey AS VARCHAR), 10, '0') AS key, s_name AS value,
    (SELECT max(seq) FROM cust) + 1 + s_suppkey AS seq FROM supplier)
SELECT key, arg_max(value, seq) AS value, max(seq) AS seq, count(*) AS versions
FROM (SELECT * FROM cust UNION ALL SELECT * FROM news) GROUP BY 1""")
def merge_writable(spark, sf_dir):
    """After the merge, new writes land (some on old keys, some on new ones) and old keys stay."""
    merged = union_shards(spark, sf_dir)
    last = merged.agg(F.max("seq")).scalar()
    news = t.table(spark, sf_dir, "supplier").select(
        r.fixed_width("key-", last - 49 + F.col("s_suppkey"), 10).alias("key"),
        F.col("s_name").alias("value"),
        (last + 1 + F.col("s_suppkey")).alias("seq"),
    )
    return merged.unionByName(news).groupBy("key").agg(
        F.max_by("value", "seq").alias("value"),
        F.max("seq").alias("seq"),
        F.count(F.lit(1)).alias("versions"),
    )


def moves_sql(name, groups, old, new):
    """Per key group: old and new subtask and whether it is copied, as three WITH items."""
    return f"""{name}_g AS (
  SELECT CAST(g AS INTEGER) AS key_group, CAST(g * {old} // {groups} AS INTEGER) AS old_subtask,
    CAST(g * {new} // {groups} AS INTEGER) AS new_subtask FROM range({groups}) q(g)),
{name}_o AS (
  SELECT old_subtask, new_subtask, min(key_group) AS lo, max(key_group) AS hi, count(*) AS overlap
  FROM {name}_g GROUP BY 1, 2),
{name}_b AS (
  SELECT *, row_number() OVER (PARTITION BY new_subtask ORDER BY overlap DESC, lo) = 1 AS is_base
  FROM {name}_o)"""


@query(f"""WITH {USERS}, {ROUTED}, {ranges_sql('o', G, 3)}, {ranges_sql('w', G, 2)}
SELECT o.subtask AS old_subtask, w.subtask AS new_subtask, greatest(o.lo, w.lo) AS lo,
  least(o.hi, w.hi) AS hi, CAST(least(o.hi, w.hi) - greatest(o.lo, w.lo) + 1 AS BIGINT) AS overlap,
  count(key) AS keys
FROM o JOIN w ON o.lo <= w.hi AND w.lo <= o.hi
LEFT JOIN routed ON key_group BETWEEN greatest(o.lo, w.lo) AND least(o.hi, w.hi)
GROUP BY ALL""")
def overlap_join(spark, sf_dir):
    """Ranges of three old subtasks against two new ones, with the keys in each overlap."""
    old = reshape.handles(spark, "events", "chk-1", G, 3)
    held = reshape.rescale(routed_users(spark, sf_dir), old, G, 2)
    keys = held.groupBy("old_subtask", "new_subtask").agg(F.count(F.lit(1)).alias("keys"))
    pairs = reshape.overlaps(old, G, 2)
    return pairs.join(keys, ["old_subtask", "new_subtask"], "left").fillna(0, ["keys"])


PLAN_SQL = f"""
moved AS (
  SELECT m.*, is_base FROM m_g m JOIN m_b b USING (old_subtask, new_subtask)),
sized AS (
  SELECT new_subtask, count(*) AS keys, count(*) FILTER (WHERE NOT is_base) AS keys_copied
  FROM moved JOIN routed USING (key_group) GROUP BY 1)
SELECT new_subtask, min(lo) AS lo, max(hi) AS hi, count(*) AS sources,
  max(old_subtask) FILTER (WHERE is_base) AS base_subtask,
  max(overlap) FILTER (WHERE is_base) AS base_overlap,
  CAST(coalesce(sum(overlap) FILTER (WHERE NOT is_base), 0) AS BIGINT) AS copied_groups,
  any_value(coalesce(keys, 0)) AS keys, any_value(coalesce(keys_copied, 0)) AS keys_copied
FROM m_b LEFT JOIN sized USING (new_subtask) GROUP BY 1"""


def sized_plan(spark, sf_dir, old_p, new_p):
    old = reshape.handles(spark, "events", "chk-1", G, old_p)
    rows = reshape.rescale(routed_users(spark, sf_dir), old, G, new_p)
    sized = rows.groupBy("new_subtask").agg(
        F.count(F.lit(1)).alias("keys"), F.count(F.when(F.col("copied"), 1)).alias("keys_copied")
    )
    plan = reshape.rescale_plan(old, G, new_p)
    return plan.join(sized, "new_subtask", "left").fillna(0, ["keys", "keys_copied"])


@query(f"WITH {USERS}, {ROUTED}, {moves_sql('m', G, 3, 2)}, {PLAN_SQL}")
def rescale_plan(spark, sf_dir):
    return sized_plan(spark, sf_dir, 3, 2)


@query(f"WITH {USERS}, {ROUTED}, {moves_sql('m', G, 2, 4)}, {PLAN_SQL}")
def rescale_out_plan(spark, sf_dir):
    """Scaling out only clips: no key is copied."""
    return sized_plan(spark, sf_dir, 2, 4)


def chain(spark, sf_dir):
    """Rescale 3 -> 2 -> 4; one row per key with its owner and fate at every step."""
    first = reshape.rescale(
        routed_users(spark, sf_dir), reshape.handles(spark, "events", "chk-1", G, 3), G, 2
    ).select(
        "key", "value", "key_group",
        F.col("old_subtask").alias("owner_at_3"),
        F.col("new_subtask").alias("owner_at_2"),
        F.col("copied").alias("copied_3_2"),
    )
    second = reshape.rescale(first, reshape.next_handles(first, G, 2), G, 4)
    return second.select(
        *first.columns, F.col("new_subtask").alias("owner_at_4"), F.col("copied").alias("copied_2_4")
    )


@query(f"""WITH {USERS}, {ROUTED}, {moves_sql('m', G, 3, 2)}, {moves_sql('k', G, 2, 4)}
SELECT key, CAST(value AS DOUBLE) AS value, key_group, m.old_subtask AS owner_at_3,
  m.new_subtask AS owner_at_2, NOT mb.is_base AS copied_3_2, k.new_subtask AS owner_at_4,
  NOT kb.is_base AS copied_2_4
FROM routed JOIN m_g m USING (key_group) JOIN k_g k USING (key_group)
JOIN m_b mb ON mb.old_subtask = m.old_subtask AND mb.new_subtask = m.new_subtask
JOIN k_b kb ON kb.old_subtask = k.old_subtask AND kb.new_subtask = k.new_subtask""")
def rescale_rows(spark, sf_dir):
    return dbl(chain(spark, sf_dir))


@query(f"""WITH {USERS} SELECT step, count(*) AS keys, TRUE AS no_foreign_key, TRUE AS no_duplicate,
  TRUE AS no_loss, TRUE AS values_intact, TRUE AS right_owner
FROM users, (VALUES ('3 to 2'), ('2 to 4')) v(step) GROUP BY 1""")
def rescale_verify(spark, sf_dir):
    rows, truth = chain(spark, sf_dir), t.user_counts(spark, sf_dir)
    one = reshape.verify_partition(rows.withColumn("subtask", F.col("owner_at_2")), truth, G, 2)
    two = reshape.verify_partition(rows.withColumn("subtask", F.col("owner_at_4")), truth, G, 4)
    return one.withColumn("step", F.lit("3 to 2")).unionByName(two.withColumn("step", F.lit("2 to 4")))


@query(f"WITH {USERS} SELECT key, n AS total, CAST(1 AS BIGINT) AS shards FROM users")
def shard_merge_stats(spark, sf_dir):
    placed = layout.routed(layout.keyed_count(t.events(spark, sf_dir)))
    return reshape.shard_merge_stats(placed)


def generations(spark, sf_dir):
    """Counter tables of three jobs, each stopped after another third of the events."""
    e = t.events(spark, sf_dir)
    third = F.floor(t.row_count(t.table(spark, sf_dir, "events")) / 3)
    counts = e.groupBy("key").agg(
        F.count(F.when(F.col("seq") < third, 1)).alias("n1"),
        F.count(F.when(F.col("seq") < third * 2, 1)).alias("n2"),
        F.count(F.lit(1)).alias("n3"),
    )
    per = F.array(*[F.struct(F.lit(g).alias("generation"), F.col(f"n{g}").alias("n")) for g in (1, 2, 3)])
    return counts.select("key", F.inline(per)).where("n > 0")


@query(f"""WITH third AS (SELECT count(*) // 3 AS t FROM events),
c AS (
  SELECT g, CAST(user_id AS VARCHAR) AS key, count(*) AS n
  FROM events, third, (VALUES (1), (2), (3)) v(g) WHERE g = 3 OR event_id < t * g GROUP BY 1, 2)
SELECT key, max(n) AS n, CAST(arg_max(g, n * 4 + g) AS INTEGER) AS generation FROM c GROUP BY 1""")
def max_across_generations(spark, sf_dir):
    return reshape.max_across_generations(generations(spark, sf_dir))


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) * 3 AS n FROM events GROUP BY 1")
def rounds_replay(spark, sf_dir):
    """The whole input three times over, from a source that keeps no offset."""
    from statekit.sources import files

    return layout.keyed_count(files.rounds(t.events(spark, sf_dir).select("key"), 3))


def scopes(spark, sf_dir):
    """Customers and suppliers in one pool; their keys collide on purpose."""
    c = t.table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("db_id"), F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value")
    )
    s = t.table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("db_id"), F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("value")
    )
    return c.unionByName(s)


SCOPES = """
pool AS (
  SELECT 'customer' AS db_id, CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier)"""


@query(f"""WITH {SCOPES} SELECT db_id, count(*) AS reads, count(*) AS right_value,
  CAST(0 AS BIGINT) AS mixed, CAST(0 AS BIGINT) AS wrong FROM pool GROUP BY 1""")
def scope_isolation(spark, sf_dir):
    pool = scopes(spark, sf_dir)
    asked = pool.select("db_id", "key")
    got = asked.join(pool.withColumnRenamed("value", "got"), ["db_id", "key"], "left")
    return reshape.scope_check(got, pool)


@query(f"WITH {SCOPES} SELECT key, count(DISTINCT db_id) AS tables FROM pool GROUP BY 1 HAVING count(DISTINCT db_id) > 1")
def duplicates_across(spark, sf_dir):
    return reshape.duplicates_across(scopes(spark, sf_dir))


ORDER_AND_EVENT_COUNTS = """
a AS (SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS value FROM orders GROUP BY 1),
b AS (SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS value FROM events GROUP BY 1)"""


def order_and_event_counts(spark, sf_dir):
    a = t.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("key"))
    b = t.events(spark, sf_dir).groupBy("key")
    return a.agg(F.count(F.lit(1)).alias("value")), b.agg(F.count(F.lit(1)).alias("value"))


@query(f"""WITH {ORDER_AND_EVENT_COUNTS}
SELECT count(*) FILTER (WHERE a.value = b.value) AS matching,
  count(*) FILTER (WHERE a.value <> b.value) AS wrong,
  count(*) FILTER (WHERE b.key IS NULL) AS missing, count(*) FILTER (WHERE a.key IS NULL) AS extra
FROM a FULL JOIN b ON a.key = b.key""")
def reconcile(spark, sf_dir):
    """Orders per customer against events per user: two tables that agree in part."""
    return reshape.reconcile(*order_and_event_counts(spark, sf_dir))


@query(f"""WITH {ORDER_AND_EVENT_COUNTS}
SELECT key, 'lost' AS what FROM a WHERE key NOT IN (SELECT key FROM b)
UNION ALL SELECT key, 'new' FROM b WHERE key NOT IN (SELECT key FROM a)""")
def no_loss(spark, sf_dir):
    """Keys that only one of the two tables holds."""
    return reshape.no_loss(*order_and_event_counts(spark, sf_dir))


@query(
    "SELECT 'gen-' || CAST(date_trunc('day', ts) AS DATE) AS name, min(event_id) AS first_seq "
    "FROM events GROUP BY 1"
)
def distinct_generations(spark, sf_dir):
    """A table name per day, recorded with every event."""
    names = t.events(spark, sf_dir).select(
        F.concat(F.lit("gen-"), F.col("ts").cast("date").cast("string")).alias("name"), "seq"
    )
    return reshape.distinct_generations(names, "name", "seq")


@query(f"""WITH {USERS}, {ROUTED}, {ranges_sql('o', G, 3)}
SELECT 'ev|ents|chk-7|' || lo || '|' || hi AS handle, 'ev|ents' AS db_id, 'chk-7' AS checkpoint_id,
  lo, hi, count(key) AS keys
FROM o LEFT JOIN routed ON key_group BETWEEN lo AND hi GROUP BY ALL""")
def handle_round_trip(spark, sf_dir):
    """Handles written as text and parsed again, with the keys that each range holds."""
    text = reshape.handles(spark, "ev|ents", "chk-7", G, 3).select(
        r.format_handle(F.col("db_id"), F.col("checkpoint_id"), F.col("lo"), F.col("hi")).alias("handle")
    )
    parsed = text.select("handle", r.parse_handle(F.col("handle")).alias("h")).select("handle", "h.*")
    groups = routed_users(spark, sf_dir).groupBy("key_group").agg(F.count(F.lit(1)).alias("_k"))
    held = r.expand_groups(parsed).join(groups, "key_group", "left")
    return held.groupBy("handle", "db_id", "checkpoint_id", "lo", "hi").agg(
        F.coalesce(F.sum("_k"), F.lit(0)).alias("keys")
    )
