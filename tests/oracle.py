"""Run a query and its SQL twin and compare them value by value."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def spark_side(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def sql_side(con, sql):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())


def difference(got, want) -> str | None:
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        missing = [r for r in want[1] if r not in set(got[1])][:2]
        return f"{len(got[1])} rows != {len(want[1])}; only here {extra}; only SQL {missing}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{a} != {b}"
    types = [{type(x) for r in side[1] for x in r if x is not None} for side in (got, want)]
    if types[0] != types[1]:
        return f"types {types[0]} != {types[1]}"
    return None


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from voxboard.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or list(entry.queries())
    spark, con = local_session(8), connect(sf)
    bad = 0
    for name in names:
        begin = time.time()
        try:
            got = spark_side(entry.queries()[name](spark, sf))
            took = time.time() - begin
            sql = entry.oracle_sql().get(name)
            begin = time.time()
            why = difference(got, sql_side(con, sql)) if sql else None
            state = "rows" if sql is None else "ok" if why is None else f"DIFF {why[:1500]}"
            print(f"{name:32s} {len(got[1]):7d} {took:6.2f}s {time.time() - begin:6.2f}s {state}", flush=True)
            bad += why is not None
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"{name:32s} ERROR {type(exc).__name__}: {str(exc)[:1800]}", flush=True)
        spark.catalog.clearCache()
    print("bad", bad, "of", len(names))
    return bad


if __name__ == "__main__":
    main(sys.argv[1:])
