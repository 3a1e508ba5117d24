"""Run registered queries beside their SQL twins: python tests/check.py [name-part ...] [--sf 0.01] [--slow]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    import datetime as dt
    import decimal

    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, bool):
        return value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def compare(spark, con, fn, sql, sf_dir):
    """None when both agree, else a description of the difference."""
    scols, srows = spark_rows(fn(spark, sf_dir))
    if sql is None:
        return None, len(srows)
    dcols, drows = duck_rows(con, sql)
    if scols != dcols:
        return f"columns {scols} != {dcols}", len(srows)
    if srows != drows:
        diff = [(a, b) for a, b in zip(srows, drows) if a != b][:2]
        return f"rows {len(srows)} vs {len(drows)}; first differences {diff}", len(srows)
    return None, len(srows)


def main():
    sys.path.insert(0, "/root/repo")
    from tracefold.plans.catalog import load
    from tracefold.session import local_session

    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at : at + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = load()
    names = [n for n in queries if not args or any(a == n or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark = local_session()
    spark.sparkContext.setLogLevel("FATAL")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        begin = time.time()
        try:
            problem, count = compare(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:1200]}", -1
        mark = "ok " if problem is None else "BAD"
        bad += problem is not None
        empty = " EMPTY" if count == 0 else ""
        print(f"{mark} {name:32s} {count:7d} rows {time.time() - begin:6.2f}s {'' if name in oracles else 'no-sql'}{empty}", flush=True)
        if problem:
            print("    ", problem[:2500], flush=True)
    print("bad", bad, "of", len(names))


if __name__ == "__main__":
    main()
