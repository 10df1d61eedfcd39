"""Run registered queries next to their SQL and compare rows.

    python tests/compare.py sf0.01 [name-part ...]
"""
from __future__ import annotations

import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(directory):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("f", repr(round(v, 9) + 0.0))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr), [columns[i] for i in order]


def check(spark, con, name, fn, sql, directory):
    df = fn(spark, directory)
    got, cols = rows(df.columns, [tuple(r) for r in df.collect()])
    if not sql:
        return len(got), None
    rel = con.sql(sql)
    want, wcols = rows(rel.columns, rel.fetchall())
    if cols != wcols:
        return len(got), f"columns {cols} != {wcols}"
    if got != want:
        only = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return len(got), f"{len(got)} vs {len(want)} rows\n   {cols}\n   spark {only[0]}\n   sql   {only[1]}"
    return len(got), ""


def main(argv):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from spanloom import build_session
    spark = build_session(master="local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                                   "spark.python.sql.dataFrameDebugging.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    directory = "/root/testdata/" + argv[0]
    con = connect(directory)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if argv[1:] and not any(p in name for p in argv[1:]):
            continue
        t = time.time()
        try:
            n, diff = check(spark, con, name, fn, sqls.get(name), directory)
        except Exception as e:
            n, diff = -1, f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(diff)
        print(f"\n@ {'ok  ' if diff == '' else 'rows' if diff is None else 'BAD '} {name} {n} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print("\n@ bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
