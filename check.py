"""Compare registered queries with their SQL on the given tables: check.py [sf] [name prefix ...]."""

import sys
import time

import duckdb

from gridspark.session import build_session
from gridspark.workload import load

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def kind(v):
    return {"int": "int", "float": "float", "str": "str", "bool": "bool", "bytes": "bytes"}.get(type(v).__name__, type(v).__name__)


def key(row):
    return tuple("" if v is None else f"{kind(v)}:{v!r}" for v in row)


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    folder = f"/root/testdata/{sf}"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                                  "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = 0
    for name, entry in load().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = entry.run(spark, folder)
            cols = sorted(df.columns)
            got = sorted(key(r) for r in df.select(*cols).collect())
            took = time.time() - start
            if entry.sql is None:
                print(f"rows  {name} {len(got)} {took:.1f}s", flush=True)
                continue
            start = time.time()
            rel = con.sql(entry.sql)
            names = sorted(rel.columns)
            if names != cols:
                raise ValueError(f"columns {cols} against {names}")
            order = [rel.columns.index(c) for c in names]
            want = sorted(key([r[i] for i in order]) for r in rel.fetchall())
            duck = time.time() - start
        except Exception as error:  # report and go on
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        if got == want and got:
            print(f"ok    {name} {len(got)} {took:.1f}s (sql {duck:.1f}s)", flush=True)
        else:
            bad += 1
            print(f"DIFF  {name}: {len(got)} against {len(want)} rows; {cols}", flush=True)
            a, b = set(got), set(want)
            for side, rows in (("spark", sorted(a - b)), ("sql  ", sorted(b - a))):
                print(f"   {side} {len(rows)}: {rows[:3]}", flush=True)
    print("all agree" if not bad else f"{bad} bad")


if __name__ == "__main__":
    main()
