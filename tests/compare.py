"""Compare registered queries with their SQL: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

#: Queries that SQL cannot express; each has tests of its own on small inputs.
NO_SQL = {"html_elements", "answer_questions"}


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def check(spark, con, folder, name, fn, sql):
    """(ok, message) of one query."""
    t0 = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return name in NO_SQL and len(got) > 0, f"{len(got)} rows, no SQL, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    t2 = time.time()
    note = f"{len(got)}/{len(want)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"{note} columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return True, note
    bad = next(((g, w) for g, w in zip(got, want) if g != w), (None, None))
    return False, f"{note}\n   spark {str(bad[0])[:600]}\n   sql   {str(bad[1])[:600]}"


if __name__ == "__main__":
    from folioquery.plans import ORACLES, QUERIES
    from folioquery.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duck(folder)
    for name in sys.argv[2:] or QUERIES:
        try:
            ok, note = check(spark, con, folder, name, QUERIES[name], ORACLES.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
