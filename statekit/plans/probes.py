"""Checks over rows with planted faults, probes of values, and the smaller sources and sinks."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from statekit import session
from statekit.functions import routing as r
from statekit.operators import chunks, layout, log, metrics, records, reshape
from statekit.plans.log import dbl
from statekit.plans.metrics import metric_rows
from statekit.plans.registry import CHECKPOINTS, LOG, USERS, group_sql, query
from statekit.plans.streams import arranged, begin, fed_in_order, own_session
from statekit.sources import files
from statekit.sources import tables as t
from statekit.streaming import ordered, runs, state

G = r.GROUPS
FAULTS = ["none", "foreign", "copied", "lost", "changed", "moved"]


@query(f"""WITH {USERS}, f AS (SELECT unnest({FAULTS}) AS fault),
hit AS (SELECT fault, count(*) AS keys, count(*) FILTER (WHERE CAST(key AS BIGINT) % 7 = 3) AS hit FROM users, f GROUP BY 1)
SELECT fault, CASE fault WHEN 'lost' THEN keys - hit ELSE keys END AS keys,
  fault <> 'foreign' OR hit = 0 AS no_foreign_key, fault <> 'copied' OR hit = 0 AS no_duplicate,
  fault NOT IN ('lost', 'foreign') OR hit = 0 AS no_loss, fault <> 'changed' OR hit = 0 AS values_intact,
  fault <> 'moved' OR hit = 0 AS right_owner FROM hit""")
def verify_faults(spark, sf_dir):
    """The five-part proof over a generation with one kind of fault at a time, in every seventh key: it must name that kind."""
    truth = t.user_counts(spark, sf_dir).select("key", "value")
    hit = F.pmod(F.col("key").cast("bigint"), F.lit(7)) == 3
    right = r.owner(r.key_group("key", G), G, 4)
    whole = truth.withColumn("subtask", right)
    # A foreign key goes where its own hash sends it, so that it is foreign and nothing else.
    renamed = truth.withColumn("key", F.when(hit, F.concat(F.lit("ghost-"), "key")).otherwise(F.col("key"))).withColumn("subtask", right)
    faulty = {
        "none": whole,
        "foreign": renamed,
        "copied": whole.unionByName(whole.where(hit)),
        "lost": whole.where(~hit),
        "changed": whole.withColumn("value", F.when(hit, F.col("value") + 1).otherwise(F.col("value"))),
        "moved": whole.withColumn("subtask", F.when(hit, F.pmod(F.col("subtask") + 1, F.lit(4))).otherwise(F.col("subtask"))),
    }
    out = None
    for fault, gen in faulty.items():
        row = reshape.verify_partition(gen, truth, G, 4).withColumn("fault", F.lit(fault))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {USERS}, placed AS (SELECT {group_sql('key')} AS g FROM users),
ranges AS (FROM (VALUES ('gap', 0, 0, 42, 0, FALSE), ('gap', 2, 86, 127, 43, FALSE), ('overlap', 0, 0, 42, 0, FALSE),
  ('overlap', 1, 40, 85, -3, FALSE), ('overlap', 2, 86, 127, 0, TRUE), ('short', 0, 0, 42, 0, TRUE), ('short', 1, 43, 85, 0, FALSE)) v(fault, subtask, lo, hi, gap_before, tiles))
SELECT fault, subtask, lo, hi, gap_before, tiles, (SELECT count(*) FROM placed WHERE g BETWEEN lo AND hi) AS keys FROM ranges""")
def tiling_faults(spark, sf_dir):
    """Ranges of three subtasks with a gap, with an overlap, and without the last of them."""
    keyed = layout.routed(layout.keyed_count(t.events(spark, sf_dir)), G, 3).groupBy("key_group").agg(F.count(F.lit(1)).alias("n"))
    counts = session.durable(spark, keyed, "groups")
    out = None
    for fault, ranges in {"gap": [(0, 0, 42), (2, 86, 127)], "overlap": [(0, 0, 42), (1, 40, 85), (2, 86, 127)], "short": [(0, 0, 42), (1, 43, 85)]}.items():
        named = spark.createDataFrame(ranges, "subtask int, lo int, hi int")
        held = named.withColumn("key_group", F.explode(F.sequence("lo", "hi"))).join(counts, "key_group", "left")
        sized = held.groupBy("subtask", "lo", "hi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("keys"))
        rows = layout.tiling_check(sized, G).withColumn("fault", F.lit(fault))
        out = rows if out is None else out.unionByName(rows)
    return out


PROBED = """d AS (SELECT unnest(range(4)) AS d),
reads AS (
  SELECT 'd' || d AS db_id, c_custkey AS k, CASE
    WHEN (c_custkey + d) % 11 = 1 THEN NULL WHEN (c_custkey + d) % 11 = 2 THEN 'd' || ((d + 1) % 4) || '-k' || c_custkey
    WHEN (c_custkey + d) % 11 = 3 THEN 'd' || d || '-k' || (c_custkey + 1) WHEN (c_custkey + d) % 11 = 4 THEN 'd' || d || '-k' || c_custkey || '0'
    ELSE 'd' || d || '-k' || c_custkey END AS got FROM customer, d)"""


@query(f"""WITH {PROBED}
SELECT db_id, count(*) AS reads, count(*) FILTER (WHERE got IS NULL) AS missing, count(*) FILTER (WHERE got = db_id || '-k' || k) AS right_value,
  count(*) FILTER (WHERE got <> db_id || '-k' || k AND regexp_full_match(got, 'd\\d+-k' || k)) AS mixed,
  count(*) FILTER (WHERE got <> db_id || '-k' || k AND NOT regexp_full_match(got, 'd\\d+-k' || k)) AS garbled FROM reads GROUP BY 1""")
def value_probe(spark, sf_dir):
    """Four databases with the same keys; some reads give nothing, another database's value, or something else. Which is told
    by the pattern of the value."""
    d, k = F.col("d"), F.col("c_custkey")
    text = lambda db, key: F.concat(F.lit("d"), db.cast("string"), F.lit("-k"), key.cast("string"))
    asked = t.table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("d"))
    turn = F.pmod(k + d, F.lit(11))
    got = (
        F.when(turn == 1, None).when(turn == 2, text(F.pmod(d + 1, F.lit(4)), k)).when(turn == 3, text(d, k + 1))
        .when(turn == 4, F.concat(text(d, k), F.lit("0"))).otherwise(text(d, k))
    )
    reads = asked.select(F.concat(F.lit("d"), d.cast("string")).alias("db_id"), k.cast("string").alias("key"), text(d, k).alias("own"), got.alias("got"))
    return reshape.value_probe(reads, F.concat(F.lit(r"^d\d+-k"), F.col("key"), F.lit("$")))


@query("""SELECT name, row_number() OVER (ORDER BY name) AS pos, series FROM (
  SELECT 'op_' || event_type AS name, count(DISTINCT (user_id % 4) || '/' || CASE WHEN event_type = 'error' THEN event_id % 2 ELSE 0 END) AS series
  FROM events GROUP BY 1)""")
def catalog_by_name(spark, sf_dir):
    """The metric catalog in the order of its names."""
    return metrics.by_name(metrics.metric_catalog(metric_rows(spark, sf_dir))).select("name", "pos", "series")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, md5('42:' || event_id) AS a, md5('7:' || event_id) AS b FROM events)
SELECT key, count(*) AS n, count(*) AS n_other, arg_min(event_id, a) AS first_seq, arg_min(event_id, b) AS first_other FROM e GROUP BY 1""")
def seeded_order(spark, sf_dir):
    """Counts added up along two seeded orders of the events: the first event differs, the count does not."""
    e = t.events(spark, sf_dir).select("key", "seq")
    one, two = (
        chunks.running_sum(reshape.seeded(e, "seq", seed), ["key"], "place", {"n": F.lit(1).cast("bigint")})
        .groupBy("key").agg(F.max("n").alias(f"n{seed}"), F.min_by("seq", "place").alias(f"first{seed}"))
        for seed in (42, 7)
    )
    return one.join(two, "key").select("key", F.col("n42").alias("n"), F.col("n7").alias("n_other"), F.col("first42").alias("first_seq"), F.col("first7").alias("first_other"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS tags FROM orders GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(7 * c_custkey + 10 * coalesce(n, 0) AS BIGINT) AS balance, c_name AS owner,
  't' || c_custkey % 3 || ',t' || c_custkey % 5 || coalesce(',' || tags, '') AS tags, CAST(2 + coalesce(n, 0) AS INTEGER) AS n_tags
FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def record_nested(spark, sf_dir):
    """Stored records of a balance, an owner and two tags after every order has added ten and appended its priority."""
    k = F.col("c_custkey")
    tag = lambda m: F.concat(F.lit("t"), F.pmod(k, F.lit(m)).cast("string"))
    stored = t.table(spark, sf_dir, "customer").select(k.cast("string").alias("key"), records.record(7 * k, F.col("c_name"), tag(3), tag(5)).alias("record"))
    o = t.table(spark, sf_dir, "orders").join(stored.select("key"), F.col("o_custkey").cast("string") == F.col("key"), "left_semi")
    updates = o.select(F.col("o_custkey").cast("string").alias("key"), F.lit(10).alias("amount"), F.col("o_orderpriority").alias("tag"), F.col("o_orderkey").alias("seq"))
    after = records.apply_updates(stored, updates)
    return after.select("key", "record.balance", "record.owner", F.array_join("record.tags", ",").alias("tags"), F.size("record.tags").alias("n_tags"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, 't' || o_orderkey % 3 || ',' || o_orderpriority AS tags, 't' || o_orderkey % 3 AS before FROM orders""")
def list_append(spark, sf_dir):
    """A tag appended to a list in each row, the list itself unchanged."""
    o = t.table(spark, sf_dir, "orders").withColumn("tags", F.array(F.concat(F.lit("t"), F.pmod("o_orderkey", F.lit(3)).cast("string"))))
    after = o.select("o_orderkey", "tags", records.appended("tags", F.col("o_orderpriority")).alias("more"))
    return after.select(F.col("o_orderkey").alias("id"), F.array_join("more", ",").alias("tags"), F.array_join("tags", ",").alias("before"))


@query(f"""WITH {CHECKPOINTS} SELECT checkpoint_id, CAST(i AS BIGINT) AS number,
  row_number() OVER (ORDER BY i) = row_number() OVER (ORDER BY checkpoint_id) AS same_as_text, i = max(i) OVER () AS newest FROM checkpoints""")
def checkpoint_numbers(spark, sf_dir):
    """The number in a checkpoint's name, which tells the newest one; the order of the names does not."""
    named = t.checkpoints(spark, sf_dir).select("checkpoint_id", r.checkpoint_number("checkpoint_id").alias("number"))
    return log.numbered(named)


@query(f"""WITH {LOG}, w AS (SELECT seq FROM log WHERE op <> 'get'), b AS (SELECT min(seq) AS lo, max(seq) AS hi FROM w)
SELECT s AS position FROM (SELECT unnest(range(lo, hi + 1)) AS s FROM b) WHERE s NOT IN (SELECT seq FROM w)""")
def missing_positions(spark, sf_dir):
    """Positions between the first and the last write that hold no write, against the sequence of all positions."""
    writes = t.op_log(spark, sf_dir).where("op <> 'get'").select("seq")
    lo, hi = writes.agg(F.min("seq"), F.max("seq")).first()
    every = files.sequence(spark, lo, hi) if lo is not None else files.sequence(spark, 0, -1)
    return every.select(F.col("id").alias("position")).join(writes.select(F.col("seq").alias("position")), "position", "left_anti")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, n FROM d WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""")
def stream_windows(spark, sf_dir):
    """Events per day by event time, given out when the watermark has passed the day's end; the last day stays open."""
    own, log_, out = own_session(spark, sf_dir), arranged(spark, sf_dir, 4), session.work_path(spark, "out")
    delay = ordered.delay(spark, log_)

    def days(rows):
        # The tick that moves the clock past the last batch brings copies, which count nothing.
        clocked = runs.event_time(rows, "ts", delay)
        return clocked.groupBy(F.window("ts", "1 day")).agg(F.count_if(F.col("lap") == 0).alias("n"))

    fed_in_order(own, log_, lambda rows: begin(days(rows), session.work_path(spark, "ckpt"), runs.batch_writer(out), "append"), ticks=1)
    return spark.read.parquet(out).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


@query("""SELECT sink, event_type, count(*) AS n FROM events, (VALUES ('memory'), ('file')) v(sink) GROUP BY 1, 2""")
def sinks(spark, sf_dir):
    """Counts per event type in two sinks: a table in memory, and files; a third one takes rows and drops them."""
    own, log_, out = own_session(spark, sf_dir), arranged(spark, sf_dir, 2), session.work_path(spark, "out")
    rows = lambda: ordered.stream(own, log_)
    counts = lambda: rows().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    name = f"sink_{session.work_path(spark, 'm').rsplit('-', 1)[1]}"
    for kind in ("noop", "memory"):
        ordered.drained(lambda kind=kind: runs.simple_sink(counts(), kind, session.work_path(spark, "ckpt"), name, "complete", to_end=False))
    fed_in_order(own, log_, lambda _: begin(rows().select("event_type"), session.work_path(spark, "files"), runs.batch_writer(out), "append"))
    in_memory = own.table(name).select(F.lit("memory").alias("sink"), "event_type", "n")  # a row per type
    in_files = spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("file").alias("sink"), "event_type", "n")
    kept = spark.createDataFrame(in_memory.collect(), in_memory.schema)
    own.catalog.dropTempView(name)
    return kept.unionByName(in_files)


@query("""WITH size AS (SELECT greatest(1, count(*) // 4) AS rows, greatest(1, greatest(1, count(*) // 4) // 8) AS g FROM events),
b AS (SELECT (row_number() OVER (ORDER BY event_id) - 1) // g * g // rows AS batch FROM events, size)
SELECT 'disk on fire' AS cause, CAST(1 AS BIGINT) AS failed_batch, count(*) FILTER (WHERE batch = 0) AS committed_rows, CAST(1 AS BIGINT) AS starts FROM b""")
def fail_fast(spark, sf_dir):
    """A sink that breaks in batch 1 of a query without restarts: the cause comes to the surface, and what was committed before
    it is all that counts."""
    own, log_, out = own_session(spark, sf_dir), arranged(spark, sf_dir, 4), session.work_path(spark, "out")
    starts, ckpt, write = [], session.work_path(spark, "ckpt"), runs.batch_writer(out)

    def broken(df, number):
        if number == 1:
            raise RuntimeError("disk on fire")
        write(df, number)

    def start():
        starts.append(1)
        return begin(state.counter(t.as_events(ordered.stream(own, log_))), ckpt, broken)

    try:
        ordered.drained(start, restarts=0)
    except StreamingQueryException as e:
        cause = runs.cause(e)
    held = runs.state_of(spark, ckpt, batch_id=0).agg(F.sum("value.count").alias("committed_rows"))
    failed = F.lit(1).cast("bigint").alias("failed_batch")
    return held.select(F.lit(cause).alias("cause"), failed, "committed_rows", F.lit(len(starts)).cast("bigint").alias("starts"))
