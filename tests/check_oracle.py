"""Compare registered queries with their SQL on DuckDB: ``python tests/check_oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return (len(got), None, "rows only")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want, wcols = rows_of(cols, cur.fetchall())
    if gcols != wcols:
        return (len(got), False, f"columns {gcols} vs {wcols}")
    types = dict(zip(cols, [str(d[1]) for d in cur.description]))
    bad = [(c, t) for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t]
    if bad:
        return (len(got), False, f"types {bad}")
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return (len(got), False, f"rows {len(got)} vs {len(want)}; cols {gcols}; first {diff}")
    return (len(got), True, "")


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from zonewise.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    picks = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_spark("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = oracle_sql()
    fails = 0
    for name, fn in queries().items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        start = time.time()
        try:
            n, ok, note = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - a report line per query is the point
            n, ok, note = -1, False, f"{type(exc).__name__}: {str(exc)[:600]}"
        fails += ok is False
        print(f"{'ok ' if ok else ('-- ' if ok is None else 'BAD')} {name} rows={n} {time.time() - start:.2f}s {note}", flush=True)
    print("failures", fails)
    spark.stop()
