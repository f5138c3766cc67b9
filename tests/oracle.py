"""Run the named queries beside their SQL and compare: ``python -m tests.oracle SF_DIR [name ...]``."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: [(x is None, str(type(x)), x) for x in r])


TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "date": "DATE",
}


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    described = [(d[0], str(d[1])) for d in rel.description]
    want_cols, want = rows_of([d[0] for d in described], rel.fetchall())
    notes = []
    types = dict(df.dtypes)
    for name, kind in described:
        if name in types and TYPES.get(types[name]) != kind.replace("_NS", ""):
            notes.append(f"{name}: {types[name]} vs {kind}")
    if got_cols != want_cols:
        return False, f"columns {got_cols} vs {want_cols}", notes, len(got)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:3]
        lack = [r for r in want if r not in set(got)][:3]
        return False, f"{len(got)} rows vs {len(want)}; extra {extra}; lack {lack}", notes, len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return not bad, f"{len(bad)} rows differ, e.g. {bad[:2]}" if bad else "", notes, len(got)


def main(argv):
    from __spark_entry__ import oracle_sql, queries

    from shelfmark.runtime import local_session

    sf_dir = argv[0]
    spark = local_session("oracle")
    con = duck(sf_dir)
    q, o = queries(), oracle_sql()
    names = argv[1:] or list(q)
    failed = 0
    for name in names:
        t = time.time()
        try:
            if name in o:
                ok, why, notes, n = compare(spark, con, sf_dir, q[name], o[name])
            else:
                n, ok, why, notes = len(q[name](spark, sf_dir).collect()), True, "rows only", []
        except Exception as e:  # noqa: BLE001
            ok, why, notes, n = False, f"{type(e).__name__}: {str(e)[:1500]}", [], -1
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {n:7d} {time.time() - t:6.1f}s {why} {'TYPES ' + str(notes) if notes else ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
