"""Queries over tables of files that this package has written and committed.

The log's puts and deletes are written shard by shard. A shard s is flushed (s mod 5) + 1 times, so shards consist of one
to five files. Commit 3 fails once between its data and its manifest and is repeated.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from statekit import session
from statekit.functions import routing as r
from statekit.operators import log, reshape
from statekit.plans.log import ST, dbl
from statekit.plans.registry import LOG, STATE, group_sql, query
from statekit.plans.streams import arranged, begin, fed_in_order, own_session
from statekit.sources import manifest
from statekit.sources import tables as t
from statekit.streaming import runs, state

COMMITS, CRASH, MOST_FILES = 5, 3, 3
COLUMNS = ["db_id", "key", "op", "value", "seq", "create_ts", "expire_ts", "shard"]

FLUSHED = f"""placed AS (
  SELECT log.*, CAST({group_sql('key')} // 8 AS INTEGER) AS shard FROM log WHERE op IN ('put', 'delete')),
flushed AS (
  SELECT placed.*, CAST((seq * {COMMITS} // n) * ((shard % {COMMITS}) + 1) // {COMMITS} AS INTEGER) AS commit_no FROM placed, cnt),
parts AS (SELECT shard, commit_no, count(*) AS rows, min(seq) AS lo, max(seq) AS hi FROM flushed GROUP BY 1, 2),
crowded AS (SELECT shard FROM parts GROUP BY 1 HAVING count(*) > {MOST_FILES}),
packed AS (
  SELECT shard, count(*) AS rows, min(seq) AS lo, max(seq) AS hi
  FROM (SELECT shard, op, seq FROM flushed JOIN crowded USING (shard) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
  WHERE op = 'put' GROUP BY 1)"""


def flushes(spark, sf_dir):
    """Puts and deletes of the op log with their shard and the commit that brings them."""
    base = t.op_log(spark, sf_dir).where(log.is_base()).withColumn("shard", r.shard(r.key_group("key")))
    n = t.row_count(t.table(spark, sf_dir, "events"))
    turn = F.floor(F.col("seq") * COMMITS / n) * (F.pmod(F.col("shard"), F.lit(COMMITS)) + 1)
    return base.select(*COLUMNS, F.floor(turn / COMMITS).cast("int").alias("commit_no"))


def committed(spark, sf_dir):
    """Write and commit the log; the folder, the rows' schema and the checkpoint (of the second commit) that holds on."""
    root = session.work_path(spark, "table")
    rows = session.durable(spark, flushes(spark, sf_dir), "flushes")
    for number in range(COMMITS):
        mine = rows.where(F.col("commit_no") == number).drop("commit_no")
        if number == CRASH:
            manifest.write(mine, root)  # and nothing more: the writer dies before its manifest
        version = manifest.commit(spark, root, manifest.write(mine, root))
        if number == 1:
            manifest.pin(spark, root, "held", version, F.lit(None))
        if number == 2:
            manifest.pin(spark, root, "expired", version, F.lit("2024-01-31 00:00:00"))
    return root, rows.drop("commit_no").schema


def compacted(spark, root, schema):
    keep = lambda rows: log.latest(rows).withColumns({"op": F.lit("put"), "shard": r.shard(r.key_group("key"))}).select(*COLUMNS)
    return manifest.compact(spark, root, schema, keep, MOST_FILES)


def later(days=1):
    """A time at which all files written just now are old."""
    return F.current_timestamp() + F.make_dt_interval(days=F.lit(days))


@query(f"""WITH {LOG}, {FLUSHED}
SELECT shard, rows, lo, hi, CASE WHEN shard NOT IN (FROM crowded) THEN 'live' WHEN commit_no <= 1 THEN 'pinned' ELSE 'deletable' END AS status
FROM parts
UNION ALL SELECT shard, rows, lo, hi, 'live' FROM packed
UNION ALL SELECT shard, rows, lo, hi, 'deletable' FROM parts WHERE commit_no = {CRASH}""")
def manifest_files(spark, sf_dir):
    """Every file in the table's folder after five commits, a crash and a compaction: live, held by a checkpoint, or
    deletable, among these the files of the crashed commit."""
    root, schema = committed(spark, sf_dir)
    compacted(spark, root, schema)
    return manifest.judged(spark, root, later(), 900).select("shard", "rows", "lo", "hi", "status")


@query(f"""WITH {LOG}, {FLUSHED}, {STATE},
early AS (SELECT * FROM flushed WHERE commit_no <= 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
SELECT 'now' AS at, {ST} FROM state
UNION ALL SELECT 'held', {ST} FROM early WHERE op = 'put'""")
def manifest_state(spark, sf_dir):
    """State of the newest version and of the checkpoint that still holds, read after all deletable files were removed."""
    root, schema = committed(spark, sf_dir)
    compacted(spark, root, schema)
    if manifest.sweep(spark, manifest.judged(spark, root, later(), 900)) == 0:
        raise AssertionError("the crashed commit has left nothing to remove")
    held = manifest.pins(spark, root).where("checkpoint_id = 'held'").first()["version"]
    states = [log.latest(manifest.read(spark, root, schema, v)).withColumn("at", F.lit(at)) for at, v in (("now", None), ("held", held))]
    return dbl(states[0].unionByName(states[1]))


@query(f"""WITH {LOG}, {FLUSHED}
SELECT shard, count(*) AS files_before, CAST(sum(rows) AS BIGINT) AS rows_before,
  CASE WHEN count(*) <= {MOST_FILES} THEN count(*) WHEN shard IN (SELECT shard FROM packed) THEN 1 ELSE 0 END AS files_after,
  CAST(CASE WHEN count(*) <= {MOST_FILES} THEN sum(rows) ELSE coalesce((SELECT p.rows FROM packed p WHERE p.shard = parts.shard), 0) END AS BIGINT) AS rows_after,
  CASE WHEN count(*) <= {MOST_FILES} THEN count(*) ELSE 0 END AS files_kept,
  count(*) <= {MOST_FILES} AS same_bytes, CAST(0 AS BIGINT) AS lost
FROM parts GROUP BY 1""")
def compact_shards(spark, sf_dir):
    """Shards before and after a compaction of those with over three files, from the manifests; ``lost`` counts the keys
    whose state is not what it was."""
    root, schema = committed(spark, sf_dir)
    before, after = compacted(spark, root, schema)
    states = [log.latest(manifest.read(spark, root, schema, v)) for v in (before, after)]
    proof = reshape.reconcile(*states)
    lost = proof.select(F.col("wrong") + F.col("missing") + F.col("extra")).scalar()
    report = manifest.change_report(spark, root, before, after)
    same = (F.col("bytes_before") == F.col("bytes_after")).alias("same_bytes")
    return report.select("shard", "files_before", "rows_before", "files_after", "rows_after", "files_kept", same, lost.alias("lost"))


@query(f"""WITH {LOG}, {FLUSHED}
SELECT commit_no + 1 AS version, count(*) AS files, CAST(sum(count(*)) OVER w AS BIGINT) AS live_files,
  CAST(sum(sum(rows)) OVER w AS BIGINT) AS live_rows, CAST(max(max(hi)) OVER w AS BIGINT) AS hi
FROM parts GROUP BY commit_no WINDOW w AS (ORDER BY commit_no)""")
def manifest_versions(spark, sf_dir):
    """What each version consists of, from the manifests alone: no data file is opened."""
    root, _ = committed(spark, sf_dir)
    every = spark.read.schema(manifest.ENTRY + ", version int").parquet(f"{root}/manifest")
    first = every.groupBy("file").agg(F.min("version").alias("version")).groupBy("version").agg(F.count(F.lit(1)).alias("files"))
    whole = every.groupBy("version").agg(F.count(F.lit(1)).alias("live_files"), F.sum("rows").alias("live_rows"), F.max("hi").alias("hi"))
    return first.join(whole, "version")


@query(f"""WITH {LOG}, k AS (SELECT key, count(*) AS n, CAST({group_sql('key')} // 8 AS INTEGER) AS shard FROM log GROUP BY 1)
SELECT key, n, TRUE AS few_files FROM k""")
def stream_table(spark, sf_dir):
    """Counts kept by a stream of five batches in a table of shards, the fourth of which fails after its commit: every batch
    counts once, and no shard has over three files."""
    own, log_ = own_session(spark, sf_dir), arranged(spark, sf_dir, 5)
    root, ckpt = session.work_path(spark, "table"), session.work_path(spark, "ckpt")
    newest = lambda rows: rows.groupBy("key", "shard").agg(F.max("n").alias("n")).select("key", "n", "shard")
    write = runs.failing_after(manifest.batch_sink(root, newest, MOST_FILES, "n"), 3)
    counts = lambda rows: state.counter(t.as_events(rows)).withColumn("shard", r.shard(r.key_group("key")))
    fed_in_order(own, log_, lambda rows: begin(counts(rows), ckpt, write))
    crowded = manifest.live(spark, root).groupBy("shard").agg(F.count(F.lit(1)).alias("files")).where(F.col("files") > MOST_FILES)
    schema = "key string, n long, shard int"
    rows = newest(manifest.read(spark, root, spark.createDataFrame([], schema).schema))
    return rows.select("key", "n", F.lit(crowded.isEmpty()).alias("few_files"))
