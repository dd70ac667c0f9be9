"""Run the registered queries against their SQL in DuckDB: python tools/check.py [-d DIR] [names...]"""

from __future__ import annotations

import argparse
import decimal
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from statekit.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6g}" if v % 1 else str(int(v))
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, dict):
        return str(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data), [cols[i] for i in order]


def compare(spark, con, sf_dir, query):
    t0 = time.time()
    df = query.run(spark, sf_dir)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if query.sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    con_t = time.time()
    res = con.execute(query.sql)
    cols = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want, want_cols = rows_of(cols, res.fetchall())
    con_t = time.time() - con_t
    if got_cols != want_cols:
        return False, f"columns {got_cols} vs {want_cols}"
    bad_types = [
        f"{n}:{t} vs {types[n]}" for n, t in df.dtypes if not same_type(t, types[n].upper())
    ]
    note = f" TYPES {bad_types}" if bad_types else ""
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return False, f"{len(got)} vs {len(want)} rows, cols {got_cols}, first diffs {diff}{note}"
    return not bad_types and bool(got), f"{len(got)} rows, {took:.1f}s (sql {con_t:.1f}s){note}"


PAIRS = {
    "bigint": ("BIGINT",),
    "int": ("INTEGER",),
    "string": ("VARCHAR",),
    "double": ("DOUBLE",),
    "boolean": ("BOOLEAN",),
    "timestamp_ntz": ("TIMESTAMP",),
    "timestamp": ("TIMESTAMP WITH TIME ZONE", "TIMESTAMP"),
}


def same_type(spark_type, duck_type):
    if spark_type.startswith("decimal"):
        return duck_type.startswith("DECIMAL")
    if spark_type.startswith("array"):
        return duck_type.endswith("[]") or duck_type == "LIST"
    return duck_type in PAIRS.get(spark_type, (duck_type,))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("-w", type=int, help="chunk width, with every row sampled")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from statekit.plans import REGISTRY

    extra = {}
    if a.w:
        extra = {"spark.statekit.chunk.width": str(a.w), "spark.statekit.chunk.sample": "1"}
    spark = local_session(8, **extra)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.d}/{t}.parquet'")
    bad = 0
    for name, q in REGISTRY.items():
        if a.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in a.names):
            continue
        try:
            ok, text = compare(spark, con, a.d, q)
        except Exception as e:  # noqa: BLE001
            ok, text = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {text}", flush=True)
    print("failures:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
