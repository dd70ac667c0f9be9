"""Streaming queries; each runs to the end of its input and is checked against batch SQL."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from statekit import session
from statekit.operators import log
from statekit.plans.log import BASED, FOLDED, NOW, ST, dbl
from statekit.plans.registry import LOG, STATE, query
from statekit.sources import colocated
from statekit.sources import tables as t
from statekit.streaming import ordered, runs, state

PARTS = 6
BATCH = 64 << 30
DAY = 24 * 3600 * 1000
COUNTS = "SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events GROUP BY 1"


def own_session(spark, sf_dir, factor=1.0):
    rows = t.table(spark, sf_dir, "events").count()
    return runs.stream_session(spark, max(1, int(runs.state_partitions(spark, rows) * factor)))


def event_stream(spark, own, sf_dir):
    """The events as a stream of the stored table where it lies, in batches by size, in no order.

    The pattern matches a table that is one file as well as one that is a folder; a plain path must be a folder.
    """
    schema = t.table(spark, sf_dir, "events").schema
    return t.as_events(runs.replayable(own, f"{sf_dir}/events.parque[t]", schema, bytes_per_batch=BATCH))


def arranged(spark, sf_dir, parts):
    """The events in the order of seq, in ``parts`` batches."""
    return ordered.arrange(t.table(spark, sf_dir, "events"), session.work_path(spark, "log"), "event_id", parts, "ts")


def fed_in_order(own, log, start, **options):
    """Run a query over the events, one batch of the ordered log each micro-batch; the drained query."""
    return ordered.drained(lambda: start(ordered.stream(own, log, **options)))


def begin(stream, ckpt, write, mode="update"):
    return runs.start(stream, ckpt, write, mode, to_end=False)


@query(COUNTS)
def stream_count(spark, sf_dir):
    own = own_session(spark, sf_dir)
    out, ckpt = session.work_path(spark, "out"), session.work_path(spark, "ckpt")
    counts = state.counter(event_stream(spark, own, sf_dir))
    runs.drain(runs.start(counts, ckpt, runs.batch_writer(out)))
    return runs.newest_batch(spark, out, ["key"], ["n"])


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, CAST(3 AS BIGINT) AS failed_batch FROM events GROUP BY 1")
def stream_recovery(spark, sf_dir):
    """A failure after batch 3 was written but not committed; the restart repeats that batch only.

    ``failed_batch`` is the batch that really failed.
    """
    own = own_session(spark, sf_dir)
    out, ckpt = session.work_path(spark, "out"), session.work_path(spark, "ckpt")
    write = runs.failing_after(runs.batch_writer(out), 3)
    log = arranged(spark, sf_dir, PARTS)
    fed_in_order(own, log, lambda rows: begin(state.counter(t.as_events(rows)), ckpt, write))
    failed = F.lit(max(write.failures, default=None)).cast("bigint")
    return runs.newest_batch(spark, out, ["key"], ["n"]).withColumn("failed_batch", failed)


def third(spark, sf_dir, index, path, as_counts, cuts):
    """Append one third of the events to a source folder. The cuts are approximate quantiles, which need not come out the
    same again, so all thirds are taken by the same ones."""
    e = t.events(spark, sf_dir)
    e = e.select("key", F.lit(1).cast("bigint").alias("n"), "seq") if as_counts else e.select("key", "seq", "ts")
    first, last = index * len(cuts) // 3, (index + 1) * len(cuts) // 3
    lo, hi = (cuts[first][0], cuts[last - 1][1]) if last > first else (0, 0)
    runs.stage(e, path, "seq", lo, hi)
    return e.schema


@query(COUNTS)
def stream_rescale(spark, sf_dir):
    """State partitions doubled, then cut to a quarter: the state of a drained run is the first input of the next."""
    held, cuts = None, runs.row_cuts(t.events(spark, sf_dir), "seq", 3)
    for i, factor in enumerate((1, 2, 0.5)):
        own = own_session(spark, sf_dir, factor)
        path, ckpt = session.work_path(spark, "source"), session.work_path(spark, "ckpt")
        if held is not None:
            seed = held.select(F.col("key.key").alias("key"), F.col("value.sum").alias("n"), F.lit(-1).cast("bigint").alias("seq"))
            seed.write.mode("append").parquet(path)
        schema = third(spark, sf_dir, i, path, True, cuts)
        totals = state.adder(runs.replayable(own, path, schema))
        runs.drain(runs.start(totals, ckpt, runs.batch_writer(session.work_path(spark, "out"))))
        held = runs.state_of(spark, ckpt)
    return held.select(F.col("key.key").alias("key"), F.col("value.sum").alias("n"))


@query(COUNTS)
def stream_rescale_savepoint(spark, sf_dir):
    """The same chain with operator-owned state, handed on as the initial state of the next run."""
    held, cuts = None, runs.row_cuts(t.events(spark, sf_dir), "seq", 3)
    buckets = runs.state_buckets(t.table(spark, sf_dir, "events").count())
    for i, factor in enumerate((1, 2, 0.5)):
        own = own_session(spark, sf_dir, factor)
        path, ckpt = session.work_path(spark, "source"), session.work_path(spark, "ckpt")
        schema = third(spark, sf_dir, i, path, False, cuts)
        seed = None if held is None else own.read.schema(held.schema).parquet(saved)
        counts = state.seeded_counter(state.combine(runs.replayable(own, path, schema)), seed, buckets)
        runs.drain(runs.start(counts, ckpt, runs.batch_writer(session.work_path(spark, "out"))))
        held = runs.state_of(spark, ckpt, variable="n").select(
            F.col("key.key").alias("key"), F.col("value.n").alias("n")
        )
        saved = session.work_path(spark, "savepoint")
        held.write.parquet(saved)
    return spark.read.schema(held.schema).parquet(saved)


@query("""WITH cut AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events)
SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events, cut
WHERE event_id < lo + (hi - lo + 2) // 2 GROUP BY 1""")
def stream_barrier(spark, sf_dir):
    """State as of a barrier: the batch that drained the first half, read after the second half is in."""
    own = own_session(spark, sf_dir)
    e = t.events(spark, sf_dir).select("key", "seq", "ts")
    path, ckpt = session.work_path(spark, "source"), session.work_path(spark, "ckpt")
    barrier = None
    for lo, hi in runs.cuts(e, "seq", 2):
        runs.stage(e, path, "seq", lo, hi)
        counts = state.counter(runs.replayable(own, path, e.schema))
        q = runs.drain(runs.start(counts, ckpt, runs.batch_writer(session.work_path(spark, "out"))))
        barrier = runs.last_batch(q) if barrier is None else barrier
    at = runs.state_of(spark, ckpt, batch_id=barrier)
    return at.select(F.col("key.key").alias("key"), F.col("value.count").alias("n"))


@query(COUNTS)
def query_state(spark, sf_dir):
    """The counter state that a finished query left behind."""
    own = own_session(spark, sf_dir)
    ckpt = session.work_path(spark, "ckpt")
    counts = state.counter(event_stream(spark, own, sf_dir))
    runs.drain(runs.start(counts, ckpt, runs.batch_writer(session.work_path(spark, "out"))))
    held = runs.state_of(spark, ckpt)
    return held.select(F.col("key.key").alias("key"), F.col("value.count").alias("n"))


@query(COUNTS)
def state_change_feed(spark, sf_dir):
    """Changes of the counter state over all batches; the last of each key is its count."""
    own = own_session(spark, sf_dir)
    ckpt = session.work_path(spark, "ckpt")
    counts = state.counter(event_stream(spark, own, sf_dir))
    runs.drain(runs.start(counts, ckpt, runs.batch_writer(session.work_path(spark, "out"))))
    feed = runs.state_changes(spark, ckpt, 0)
    return feed.groupBy(F.col("key.key").alias("key")).agg(
        F.max_by(F.col("value.count"), "batch_id").alias("n")
    )


USER = "CAST(user_id AS STRING)"
KIND = "concat_ws(':', user_id, event_type)"


def tiered(own, log, out, ckpt, delay, key, seed=None, **options):
    """Run the two tiers over a log; the progress reports."""
    progress = runs.Progress(own)
    trail = lambda rows: state.tiers(state.touches(rows, F.expr(key)), DAY, delay, seed, runs.state_buckets(log.rows))
    reports = progress.of(fed_in_order(own, log, lambda rows: begin(trail(rows), ckpt, runs.batch_writer(out)), **options))
    runs.no_late_rows(reports)
    return reports


@query(COUNTS)
def stream_tiering(spark, sf_dir):
    """Counts kept through demotion after a day without a touch, and promotion by the next one."""
    own, log, out = own_session(spark, sf_dir), arranged(spark, sf_dir, PARTS), session.work_path(spark, "out")
    tiered(own, log, out, session.work_path(spark, "ckpt"), ordered.delay(spark, log), USER)
    return spark.read.parquet(out).groupBy("key").agg(F.max("n").alias("n"))


# Batches as the ordered log cuts a table of one file: row groups of an eighth of a batch. Within a batch the touches come
# first, then the timers due by the latest time of the batches before.
TRAIL = """WITH e AS (SELECT user_id || ':' || event_type AS key, epoch_us(ts) // 1000 AS ms, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events),
size AS (SELECT greatest(1, count(*) // 8) AS rows, greatest(1, greatest(1, count(*) // 8) // 8) AS g FROM events),
b AS (SELECT key, ms, i // g * g // rows AS batch FROM e, size),
clock AS (SELECT batch, max(max(ms)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM b GROUP BY 1),
touched AS (SELECT key, batch, max(ms) AS last, sum(count(*)) OVER (PARTITION BY key ORDER BY batch) AS n FROM b GROUP BY 1, 2),
due AS (SELECT key, batch, n, last, last + 86400000 AS at_ms,
  lead(batch) OVER w AS next_batch, lead(last) OVER w AS next_last,
  (SELECT min(c.batch) FROM clock c WHERE c.mark >= last + 86400000) AS fires FROM touched WINDOW w AS (PARTITION BY key ORDER BY batch)),
gone AS (SELECT * FROM due WHERE fires IS NOT NULL AND (next_batch IS NULL OR fires < next_batch))
SELECT key, 'demote' AS what, CAST(n AS BIGINT) AS n, at_ms FROM gone
UNION ALL SELECT key, 'promote', CAST(n AS BIGINT), next_last FROM gone WHERE next_batch IS NOT NULL"""


@query(TRAIL)
def stream_tier_trail(spark, sf_dir):
    """Every demotion and promotion of the streamed tiers, with the count that moved and its event time."""
    own, log, out = own_session(spark, sf_dir), arranged(spark, sf_dir, 8), session.work_path(spark, "out")
    tiered(own, log, out, session.work_path(spark, "ckpt"), ordered.delay(spark, log), KIND)
    return spark.read.parquet(out).where("what <> 'touch'").select("key", "what", "n", "at_ms")


@query(TRAIL)
def stream_rescale_tiers(spark, sf_dir):
    """The same trail from three queries with 2, 4 and 1 state partitions: each takes over both tiers, the pending timers
    and the clock of the one before."""
    log, out = arranged(spark, sf_dir, 8), session.work_path(spark, "out")
    delay, seed = ordered.delay(spark, log), None
    ends = [round(log.batches * share) for share in (1 / 3, 2 / 3, 1)]
    for partitions, first, until in zip((2, 4, 1), [0, *ends], ends, strict=False):
        own, ckpt = runs.stream_session(spark, partitions), session.work_path(spark, "ckpt")
        own_seed = None if seed is None else own.read.schema(seed.schema).parquet(*seed.inputFiles())
        tiered(own, log, f"{out}/until={until}", ckpt, delay, KIND, own_seed, first=first, until=until, lead=True)
        seed = session.durable(spark, state.tier_seed(runs.state_of(spark, ckpt, variable="hot"), runs.state_of(spark, ckpt, variable="cold")), "seed")
    return spark.read.parquet(out).where("what <> 'touch'").select("key", "what", "n", "at_ms")


@query("""SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(max(ts)) // 1000 + 86400000 AS due_ms FROM events GROUP BY 1
HAVING epoch_us(max(ts)) // 1000 + 86400000 > (SELECT epoch_us(max(ts)) // 1000 FROM events)""")
def pending_timers(spark, sf_dir):
    """Timers that the finished tiers still hold: last touch and a day, of keys touched within a day of the end."""
    own, log, ckpt = own_session(spark, sf_dir), arranged(spark, sf_dir, PARTS), session.work_path(spark, "ckpt")
    tiered(own, log, session.work_path(spark, "out"), ckpt, ordered.delay(spark, log), USER, ticks=1)
    return runs.pending_timers(spark, ckpt)


@query("""WITH cut AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events),
c AS (
  SELECT CAST(user_id AS VARCHAR) AS key, count(*) FILTER (WHERE event_id < lo + (hi - lo + 2) // 2) AS old,
    count(*) FILTER (WHERE event_id >= lo + (hi - lo + 2) // 2) AS new
  FROM events, cut GROUP BY 1)
SELECT key, CAST(0 AS BIGINT) AS short_before, old AS kept_before, new AS short, old + new AS kept
FROM c WHERE new > 0""")
def stream_ttl(spark, sf_dir):
    """State with a TTL of 1.5 s is gone when the second half arrives; the control state is not."""
    ttl_ms = 1500
    own = own_session(spark, sf_dir)
    e = t.events(spark, sf_dir).select("key", "seq", "ts")
    path, ckpt = session.work_path(spark, "source"), session.work_path(spark, "ckpt")
    for lo, hi in runs.cuts(e, "seq", 2):
        runs.stage(e, path, "seq", lo, hi)
        out = session.work_path(spark, "out")
        rows = state.expiring(state.combine(runs.replayable(own, path, e.schema)), ttl_ms)
        runs.drain(runs.start(rows, ckpt, runs.batch_writer(out)))
        time.sleep(ttl_ms / 1000 + 0.5)
    return spark.read.parquet(out).drop("batch")


@query("SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq FROM events")
def stream_dedupe(spark, sf_dir):
    """Every record delivered twice within its batch: each comes out once."""
    own, log = own_session(spark, sf_dir), arranged(spark, sf_dir, 3)
    out, ckpt, progress = session.work_path(spark, "out"), session.work_path(spark, "ckpt"), runs.Progress(own)
    delay = ordered.delay(spark, log)
    twice = lambda rows: t.as_events(rows).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2))))
    once = lambda rows: state.dedupe(twice(rows).select("key", "seq", "ts"), ["key", "seq"], delay=delay)
    q = fed_in_order(own, log, lambda rows: begin(once(rows), ckpt, runs.batch_writer(out), "append"))
    runs.no_late_rows(progress.of(q))
    return spark.read.parquet(out).select("key", "seq")


@query("""SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, c_name AS name, c_mktsegment AS segment
FROM events LEFT JOIN customer ON user_id = c_custkey""")
def stream_enrich(spark, sf_dir):
    """Events joined with the customer table as they arrive."""
    own = own_session(spark, sf_dir)
    out = session.work_path(spark, "out")
    customers = t.table(own, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("key"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )
    rows = state.enrich(event_stream(spark, own, sf_dir).select("key", "seq"), customers, "key")
    runs.drain(runs.start(rows, session.work_path(spark, "ckpt"), runs.batch_writer(out), mode="append"))
    return spark.read.parquet(out).select("seq", "key", "name", "segment")


@query(f"""WITH {LOG}, {BASED}
SELECT DISTINCT db_id, key, json_extract_string(props, '$.k') AS element FROM counted""")
def stream_set(spark, sf_dir):
    """Sets of the keys kept as stream state, one entry an element, through a failure after batch 1."""
    own, log_, ckpt = own_session(spark, sf_dir), arranged(spark, sf_dir, 4), session.work_path(spark, "ckpt")
    write = runs.failing_after(runs.batch_writer(session.work_path(spark, "out")), 1)
    sets = lambda rows: state.live_set(state.set_operands(t.as_op_log(t.as_events(rows)), F.get_json_object("props", "$.k")), buckets=runs.state_buckets(log_.rows))
    fed_in_order(own, log_, lambda rows: begin(sets(rows), ckpt, write))
    return runs.collection(spark, ckpt, "elements").select("db_id", "key", F.col("entry.element").alias("element"))


def writes_twice(spark, sf_dir, out, ckpt, width):
    """The writes of the op log (no reads), all of them delivered once and then all again."""
    own, log_ = own_session(spark, sf_dir), arranged(spark, sf_dir, 2)
    writes = lambda rows: t.as_op_log(t.as_events(rows)).where("op <> 'get'")
    once = lambda rows: state.seen_once(writes(rows), ["db_id", "key", "seq"], width)
    fed_in_order(own, log_, lambda rows: begin(once(rows), ckpt, runs.batch_writer(out), "append"), laps=2)


@query(f"WITH {LOG} SELECT db_id, key, seq FROM log WHERE op <> 'get'")
def stream_dedupe_any(spark, sf_dir):
    """The whole log delivered again after its end: every write comes out once, without a delay to be set."""
    out = session.work_path(spark, "out")
    writes_twice(spark, sf_dir, out, session.work_path(spark, "ckpt"), state.SHARD_WIDTH)
    return spark.read.parquet(out).select("db_id", "key", "seq")


@query(f"""WITH {LOG}, w AS (SELECT seq, seq // 1024 AS shard FROM log WHERE op <> 'get'),
i AS (SELECT *, seq - row_number() OVER (PARTITION BY shard ORDER BY seq) AS island FROM w)
SELECT shard, min(seq) AS lo, max(seq) AS hi FROM i GROUP BY shard, island""")
def seen_intervals(spark, sf_dir):
    """The state of that deduplication: per shard of 1,024 positions the intervals seen, one more than it has gaps."""
    ckpt = session.work_path(spark, "ckpt")
    writes_twice(spark, sf_dir, session.work_path(spark, "out"), ckpt, 1024)
    return runs.collection(spark, ckpt, "spans").select("shard", F.col("entry.lo").alias("lo"), F.col("at.hi").alias("hi"))


@query(f"""WITH {LOG}, {STATE} SELECT e.event_id AS seq, CAST(e.user_id AS VARCHAR) AS key, CAST(s.value AS DOUBLE) AS value
FROM events e LEFT JOIN state s ON s.key = CAST(e.user_id AS VARCHAR)""")
def stream_lookup(spark, sf_dir):
    """Events looked up, as they arrive, in a state table that is stored by hash of its key: only the events move."""
    own, out = own_session(spark, sf_dir), session.work_path(spark, "out")
    with colocated.stored(t.state(spark, sf_dir).select("key", "value"), ["key"], 16) as name:
        rows = colocated.lookup(event_stream(spark, own, sf_dir).select("key", "seq"), own.table(name), ["key"])
        runs.drain(runs.start(rows, session.work_path(spark, "ckpt"), runs.batch_writer(out), mode="append"))
    return dbl(spark.read.parquet(out).select("seq", "key", "value"))


@query(f"WITH {LOG}, {BASED} {FOLDED}")
def stream_fold(spark, sf_dir):
    """Merge operands folded as they arrive: every batch is squashed, the rest is folded on reading."""
    own = own_session(spark, sf_dir)
    out = session.work_path(spark, "out")
    write, ckpt = runs.batch_writer(out, log.squash), session.work_path(spark, "ckpt")
    fed_in_order(own, arranged(spark, sf_dir, 4), lambda rows: begin(t.as_op_log(t.as_events(rows)), ckpt, write, "append"))
    return dbl(log.fold_squashed(spark.read.parquet(out).drop("batch")))


@query(f"""WITH {LOG}, {STATE}
SELECT {ST}, (SELECT max(event_id) FROM events) AS seq_hi FROM state""")
def stream_checkpoints(spark, sf_dir):
    """A log written in batches, each pinned by a checkpoint; state at the newest of them."""
    own = own_session(spark, sf_dir)
    data, pins = session.work_path(spark, "log"), session.work_path(spark, "pins")
    write, ckpt = runs.checkpoint_writer(data, pins, "events"), session.work_path(spark, "ckpt")
    fed_in_order(own, arranged(spark, sf_dir, 3), lambda rows: begin(t.as_op_log(t.as_events(rows)), ckpt, write, "append"))
    seq_hi = spark.read.parquet(pins).agg(F.max("seq_hi")).scalar()
    return dbl(log.resolve(spark.read.parquet(data), as_of=seq_hi)).withColumn("seq_hi", seq_hi)


@query(f"""SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, max(event_id) AS seq,
  max(ts) + INTERVAL 1 DAY > {NOW} AS in_hot FROM events GROUP BY 1""")
def stream_write_through(spark, sf_dir):
    """Every batch goes to a cold table with all keys and a hot table with recent ones."""
    own = own_session(spark, sf_dir)
    cold, hot = session.work_path(spark, "cold"), session.work_path(spark, "hot")
    recent = F.col("ts") + F.expr("INTERVAL '1' DAY") > t.now()

    def both(df, batch_id):
        newest = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq"), F.max_by("ts", "seq").alias("ts"))
        runs.batch_writer(cold)(newest, batch_id)
        # The hot tier is a part of what was just written, so the batch is not computed twice.
        written = df.sparkSession.read.parquet(f"{cold}/batch={batch_id}")
        runs.batch_writer(hot)(written.where(recent), batch_id)

    stream = event_stream(spark, own, sf_dir)
    runs.drain(runs.start(stream, session.work_path(spark, "ckpt"), both, mode="append"))
    all_keys = spark.read.parquet(cold).groupBy("key").agg(F.sum("n").alias("n"), F.max("seq").alias("seq"))
    hot_keys = spark.read.parquet(hot).select("key").distinct().withColumn("in_hot", F.lit(True))
    return all_keys.join(hot_keys, "key", "left").fillna(False, ["in_hot"])


@query("""SELECT 'input_rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM events
UNION ALL SELECT 'state_rows', CAST(count(DISTINCT user_id) AS DOUBLE) FROM events
UNION ALL SELECT 'late_rows', CAST(0 AS DOUBLE)""")
def stream_metrics(spark, sf_dir):
    """Progress reports as a metrics table: rows read, rows in the state at the end, late rows."""
    own = own_session(spark, sf_dir)
    counts = state.counter(event_stream(spark, own, sf_dir))
    progress = runs.Progress(own)
    q = runs.start(counts, session.work_path(spark, "ckpt"), runs.batch_writer(session.work_path(spark, "out")))
    rows = runs.progress_metrics(spark, progress.of(runs.drain(q)))
    last = F.max_by("value", F.col("labels")["batch"].cast("bigint"))
    return rows.groupBy("name").agg(
        F.when(F.col("name") == "state_rows", last).otherwise(F.sum("value")).alias("value")
    )


@query("SELECT CAST(count(*) AS BIGINT) AS source_offset, max(event_id) AS seq_hi, CAST(0 AS BIGINT) AS torn FROM events")
def checkpoint_offset(spark, sf_dir):
    """State and source position are one cut, although batch 1 failed after it was written: the newest
    checkpoint, and how many checkpoints don't hold just the rows before their offset."""
    own = own_session(spark, sf_dir)
    data, pins = session.work_path(spark, "log"), session.work_path(spark, "pins")
    write, ckpt = runs.failing_after(runs.checkpoint_writer(data, pins, "events"), 1), session.work_path(spark, "ckpt")
    fed_in_order(own, arranged(spark, sf_dir, 3), lambda rows: begin(t.as_op_log(t.as_events(rows)), ckpt, write, "append"))
    marks = runs.checkpoint_offsets(spark, pins)
    held = spark.read.parquet(data).groupBy("batch").agg(F.count(F.lit(1)).alias("held"), F.max("seq").alias("top"))
    both = marks.join(held, "batch", "full")
    torn = F.coalesce((F.col("held") == F.col("rows")) & (F.col("top") == F.col("seq_hi")), F.lit(False))
    return both.agg(F.max("source_offset").alias("source_offset"), F.max("seq_hi").alias("seq_hi"), F.sum(F.when(torn, 0).otherwise(1)).cast("bigint").alias("torn"))
