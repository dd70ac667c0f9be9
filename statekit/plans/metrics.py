"""Queries over metrics, errors and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from statekit import session
from statekit.operators import metrics, sketches, tiering
from statekit.plans.log import NOW, dbl
from statekit.plans.registry import query
from statekit.plans.tiering import DAY, TOUCHES
from statekit.sources import tables as t


def metric_rows(spark, sf_dir):
    """A counter per event type with the label ``bucket``; errors also say whether they can be retried."""
    e = t.events(spark, sf_dir)
    bucket = F.pmod(F.col("key").cast("bigint"), F.lit(4)).cast("string")
    labels = F.when(
        F.col("event_type") == "error",
        F.create_map(F.lit("bucket"), bucket, F.lit("parity"), F.pmod(F.col("seq"), F.lit(2)).cast("string")),
    ).otherwise(F.create_map(F.lit("bucket"), bucket))
    return e.select(
        "ts",
        F.concat(F.lit("op_"), "event_type").alias("name"),
        labels.alias("labels"),
        F.lit("counter").alias("kind"),
        "value",
        "seq",
        "event_type",
    )


@query("""SELECT 'op_' || event_type AS name, 'counter' AS kind,
  CASE WHEN event_type = 'error' THEN 'bucket,parity' ELSE 'bucket' END AS label_keys,
  count(DISTINCT (user_id % 4) || '/' || CASE WHEN event_type = 'error' THEN event_id % 2 ELSE 0 END) AS series,
  max(value) AS sample
FROM events GROUP BY event_type""")
def metric_catalog(spark, sf_dir):
    return dbl(metrics.metric_catalog(metric_rows(spark, sf_dir)), "sample")


@query("""WITH e AS (SELECT 'op_' || event_type AS name, CAST(value AS DECIMAL(18,2)) AS value FROM events)
SELECT name, count(*) AS count, CAST(sum(value) AS DOUBLE) AS sum, CAST(min(value) AS DOUBLE) AS min,
  CAST(max(value) AS DOUBLE) AS max, count(*) FILTER (WHERE value <= 5) AS le_5,
  count(*) FILTER (WHERE value > 5 AND value <= 10) AS le_10,
  count(*) FILTER (WHERE value > 10 AND value <= 25) AS le_25,
  count(*) FILTER (WHERE value > 25 AND value <= 50) AS le_50, count(*) FILTER (WHERE value > 50) AS le_inf
FROM e GROUP BY 1""")
def histogram(spark, sf_dir):
    rows = metric_rows(spark, sf_dir)
    return dbl(metrics.histogram(rows, "name", "value", [5, 10, 25, 50]), "sum", "min", "max")


@query("""WITH e AS (SELECT event_type AS name, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM events),
r AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY cents) AS rn, count(*) OVER (PARTITION BY name) AS n FROM e)
SELECT name, min(cents) FILTER (WHERE rn >= ceil(0.5::DOUBLE * n)) AS p50,
  min(cents) FILTER (WHERE rn >= ceil(0.99::DOUBLE * n)) AS p99,
  min(cents) FILTER (WHERE rn >= ceil(0.999::DOUBLE * n)) AS p999
FROM r GROUP BY 1""")
def latency_quantiles(spark, sf_dir):
    """Exact p50, p99 and p999 of the values in hundredths."""
    cents = t.events(spark, sf_dir).select(
        F.col("event_type").alias("name"), (F.col("value") * 100).cast("bigint").alias("cents")
    )
    return metrics.quantiles(cents, "name", "cents", {"p50": 0.5, "p99": 0.99, "p999": 0.999})


@query(f"""WITH {TOUCHES},
a AS (
  SELECT event_type AS kind,
    CASE WHEN prev_ts IS NOT NULL AND NOT by_gap THEN 'hit' ELSE 'miss' END AS result
  FROM marked JOIN events ON event_id = seq)
SELECT kind, result, count(*) AS accesses,
  CAST(count(*) FILTER (WHERE result = 'hit') AS DOUBLE) / count(*) AS hit_ratio
FROM a GROUP BY CUBE (kind, result)""")
def hit_ratio(spark, sf_dir):
    """A touch hits when its user was touched less than a day before; by event type and result."""
    e = t.events(spark, sf_dir).select("key", "seq", "ts", "event_type")
    touched = tiering.touch_gaps(e, DAY)
    hit = F.col("prev_ts").isNotNull() & ~F.col("promoted")
    accesses = touched.select(
        F.col("event_type").alias("kind"), F.when(hit, "hit").otherwise("miss").alias("result")
    )
    return metrics.hit_ratio(accesses)


@query("""SELECT event_id AS seq, CAST(user_id % 4 AS VARCHAR) AS bucket,
  CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END)
    OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS BIGINT) AS gauge
FROM events QUALIFY event_type IN ('signup', 'error')""")
def gauge(spark, sf_dir):
    """Signups add one, errors take one away, per bucket."""
    e = t.events(spark, sf_dir).where(F.col("event_type").isin("signup", "error"))
    deltas = e.select(
        "seq",
        F.pmod(F.col("key").cast("bigint"), F.lit(4)).cast("string").alias("bucket"),
        F.when(F.col("event_type") == "signup", 1).otherwise(-1).alias("delta"),
    )
    return metrics.up_down_gauge(deltas, ["bucket"], "seq", F.col("delta")).drop("delta")


@query(f"""SELECT event_type, max(ts) AS last_ts, date_sub('second', max(ts), {NOW}) AS lag_s FROM events GROUP BY 1""")
def lag_seconds(spark, sf_dir):
    return metrics.lag_seconds(t.events(spark, sf_dir), "event_type", "ts", t.now())


ERRORS = """
errors AS (
  SELECT CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 6
    WHEN 0 THEN 'Unavailable' WHEN 1 THEN 'Transaction' WHEN 2 THEN 'Closed' WHEN 3 THEN 'Data'
    WHEN 4 THEN 'Internal' ELSE 'Other' END AS error, ts, event_type
  FROM events)"""


def error_name(k):
    names = ["Unavailable", "Transaction", "Closed", "Data", "Internal", "Other"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(k, F.lit(6)) + 1).cast("int"))


@query(f"""WITH {ERRORS}
SELECT error, count(*) AS n, CASE WHEN error IN ('Unavailable', 'Transaction') THEN 'retryable' ELSE 'fatal' END AS class,
  error <> 'Other' AS known
FROM errors WHERE event_type = 'error' GROUP BY 1""")
def error_triage(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    errors = t.events(spark, sf_dir).where("event_type = 'error'").select(error_name(k).alias("error"))
    return metrics.error_triage(errors)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests,
  count(*) FILTER (WHERE event_type = 'error') AS errors,
  CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*) AS error_rate
FROM events GROUP BY 1""")
def error_rate(spark, sf_dir):
    e = t.events(spark, sf_dir).withColumn("day", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd"))
    return metrics.rates(e, ["day"], F.col("event_type") == "error")


@query("""SELECT event_type AS op, CAST(user_id % 4 AS VARCHAR) AS bucket, count(*) AS requests FROM events GROUP BY 1, 2""")
def request_count(spark, sf_dir):
    e = metric_rows(spark, sf_dir)
    counted = e.groupBy(F.col("event_type").alias("op"), F.col("labels")["bucket"].alias("bucket"))
    return counted.agg(F.count(F.lit(1)).alias("requests"))


@query("""SELECT l_returnflag AS mode, CAST(floor(l_quantity / 10) AS INTEGER) AS size_class, count(*) AS ops,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS us_per_op,
  count(*) * 1e6 / CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS ops_per_s
FROM lineitem GROUP BY 1, 2""")
def throughput_report(spark, sf_dir):
    """Line items as a run log: the flag is the access mode, the price the microseconds taken."""
    runs = t.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("mode"),
        F.floor(F.col("l_quantity") / 10).cast("int").alias("size_class"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("micros"),
    )
    return metrics.throughput(runs, ["mode", "size_class"], "micros")


@query("""WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day FROM events),
last AS (SELECT event_type, max(day) AS day FROM e GROUP BY 1)
SELECT event_type, count(DISTINCT e.day) AS generations, count(*) AS n, count(*) FILTER (WHERE e.day < last.day) AS n_before,
  TRUE AS p50_ok, TRUE AS p99_ok, TRUE AS p999_ok, FALSE AS shifted_ok
FROM e JOIN last USING (event_type) GROUP BY 1""")
def sketch_quantiles(spark, sf_dir):
    """Sketches per event type and day, stored and merged by week and then over all: are the quantiles within the sketch's bound
    of the exact ranks? ``shifted_ok`` asks the same of a wrong value and must fail; ``n_before`` lacks the last day."""
    e = t.table(spark, sf_dir, "events").select("event_type", "value", F.col("ts").cast("date").alias("day"))
    daily = session.durable(spark, sketches.sketch(e, ["event_type", "day"], "value", 800), "sketches")
    weekly = sketches.merge(daily.withColumn("week", F.weekofyear("day")), ["event_type", "week"])
    points = {"p50": 0.5, "p99": 0.99, "p999": 0.999}
    found = sketches.quantiles(sketches.merge(weekly, ["event_type"]), points).withColumn("shifted", F.kll_sketch_get_quantile_double("sketch", F.lit(0.6)))
    found = session.durable(spark, found, "quantiles")
    last = daily.groupBy("event_type").agg(F.max("day").alias("last"), F.count(F.lit(1)).alias("generations"))
    before = sketches.merge(daily.join(last, "event_type").where("day < last"), ["event_type"]).select("event_type", sketches.rows().alias("n_before"))
    exact = sketches.ranks(e, found, "event_type", "value", [*points, "shifted"]).drop("n")
    error = 3 * sketches.rank_error(800)  # three times the bound of 99 cases in 100: chance alone does not get there
    ok = lambda name, p: ((F.col(f"{name}_below") <= p + error) & (F.col(f"{name}_upto") >= p - error)).alias(f"{name}_ok")
    rows = found.select("event_type", sketches.rows().alias("n")).join(last, "event_type").join(before, "event_type").join(exact, "event_type")
    return rows.select("event_type", "generations", "n", "n_before", *[ok(x, p) for x, p in points.items()], ok("shifted", 0.5))
