"""Side-by-side check of a Spark query against its SQL twin in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, Decimal):
        raise TypeError("DECIMAL in output")
    if isinstance(v, float):
        if math.isnan(v):
            raise TypeError("NaN in output")
        return ("f", repr(v))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("d", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(norm(x) for x in v))
    return ("s", v) if v is not None else ("n", None)


def compare(spark, con, fn, sql, sf_dir):
    """Return (ok, message, n_rows, spark_seconds)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    srows = [tuple(r) for r in df.select(*cols).collect()]
    secs = time.time() - t0
    if sql is None:
        return len(srows) > 0, "rows only", len(srows), secs
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    raw = cur.fetchall()
    if sorted(names) != cols:
        return False, f"columns spark={cols} sql={sorted(names)}", len(srows), secs
    order = [names.index(c) for c in cols]
    a = sorted((tuple(norm(v) for v in r) for r in srows), key=repr)
    b = sorted((tuple(norm(r[i]) for i in order) for r in raw), key=repr)
    if a == b:
        return len(a) > 0, f"match ({len(a)} rows)" if a else "EMPTY", len(a), secs
    sa, sb = set(a), set(b)
    only_a = [x for x in a if x not in sb][:3]
    only_b = [x for x in b if x not in sa][:3]
    return False, f"rows {len(a)}/{len(b)} cols={cols}\n   spark {only_a}\n   sql   {only_b}", len(a), secs


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    only = sys.argv[1:]
    q, o = entry.queries(), entry.oracle_sql()
    names = [n for n in q if not only or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in only)]
    spark = session()
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf)
    bad = []
    for n in names:
        try:
            ok, msg, rows, secs = compare(spark, con, q[n], o.get(n), sf)
        except Exception as exc:
            ok, msg, rows, secs = False, f"{type(exc).__name__}: {str(exc)[:1500]}", 0, 0
        print(("ok  " if ok else "FAIL"), n, f"{secs:.1f}s", msg, flush=True)
        if not ok:
            bad.append(n)
    print(len(names) - len(bad), "ok", len(bad), "bad", bad)
