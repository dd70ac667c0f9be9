"""Name -> Spark query and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register the decorated function under its own name."""

    def add(run: Run) -> Run:
        if run.__name__ in REGISTRY:
            raise ValueError(f"query {run.__name__} is registered twice")
        REGISTRY[run.__name__] = Query(run.__name__, run, sql)
        return run

    return add


# Derivations shared by the SQL texts, as the WITH items of a query.

LOG = """
cnt AS (SELECT count(*) AS n FROM events),
log AS (
  SELECT 'events' AS db_id, CAST(user_id AS VARCHAR) AS key,
    CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete'
      WHEN 'view' THEN 'get' ELSE 'merge' END AS op,
    CAST(value AS DECIMAL(18,2)) AS value, event_id AS seq,
    CASE WHEN event_id < (n // 2) THEN 1 WHEN event_id % 10 = 0 THEN 1 ELSE 2 END AS writer_epoch,
    ts AS create_ts,
    CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL 7 DAY END AS expire_ts,
    event_type, props
  FROM events, cnt)"""

STATE = """
newest AS (
  SELECT * FROM log WHERE op IN ('put', 'delete')
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
state AS (SELECT db_id, key, value, seq, create_ts, expire_ts FROM newest WHERE op = 'put')"""

USERS = """
users AS (
  SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n,
    sum(CAST(value AS DECIMAL(18,2))) AS value, max(event_id) AS seq
  FROM events GROUP BY 1)"""

CHECKPOINTS = """
checkpoints AS (
  SELECT 'chk-' || i AS checkpoint_id, 'events' AS db_id, i, seq_hi, seq_hi - 20 AS manifest_seq_hi,
    create_ts, CASE WHEN i % 2 = 0 THEN create_ts + INTERVAL 900 SECOND END AS expire_ts
  FROM (SELECT event_id // 500 AS i, max(event_id) AS seq_hi, max(ts) AS create_ts
        FROM events GROUP BY 1))"""


def group_sql(key: str, groups: int = 128) -> str:
    """Key group of a text expression."""
    return f"CAST((CAST(('0x' || substr(md5({key}), 1, 8)) AS UBIGINT) % {groups}) AS INTEGER)"


def ranges_sql(name: str, groups: int, parallelism: int) -> str:
    """A WITH item listing the subtask ranges."""
    return f"""{name} AS (
  SELECT CAST(i AS INTEGER) AS subtask,
    CAST((i * {groups} + {parallelism} - 1) // {parallelism} AS INTEGER) AS lo,
    CAST(((i + 1) * {groups} + {parallelism} - 1) // {parallelism} - 1 AS INTEGER) AS hi
  FROM range({parallelism}) t(i))"""
