"""Run registered queries beside their SQL in DuckDB and compare rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (int, str)):
        return v
    return repr(v)


def compare(spark, con, name, plan, sql, sf):
    started = time.time()
    df = plan(spark, sf)
    got = df.collect()
    took = time.time() - started
    cols = sorted(df.columns)
    if sql is None:
        return True, f"{len(got)} rows, no SQL", took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != cols:
        return False, f"columns {cols} != {sorted(names)}", took
    idx = [names.index(c) for c in cols]
    a = sorted((repr(tuple(plain(r[c]) for c in cols)) for r in got))
    b = sorted((repr(tuple(plain(r[i]) for i in idx)) for r in want))
    if a == b:
        return True, f"{len(a)} rows", took
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return False, f"{len(a)} vs {len(b)} rows\n   cols {cols}\n   spark {only_a}\n   sql   {only_b}", took


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from ringsight.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[3:]
    spark = build_session(
        "local[8]",
        **{"spark__sql__shuffle__partitions": "8", "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "12g",
           "spark__ringsight__blockRows": sys.argv[2]},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = entry.oracle_sql()
    bad = []
    total = 0.0
    for name, plan in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note, took = compare(spark, con, name, plan, sqls.get(name), sf)
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:1200]}", 0.0
        total += took
        print(("ok  " if ok else "FAIL"), name, f"{took:.2f}s", note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed {bad}; {total:.1f}s")
