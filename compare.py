"""Run registered queries in Spark and their SQL in DuckDB and compare the values.

    python compare.py [sf folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from postsift.plans import registry
from postsift.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "isoformat"):
        return str(value).replace("T", " ")
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, [str(dict(df.dtypes)[n]) for n in names], sorted(tuple(cell(v) for v in r) for r in df.select(*names).collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    types = [str(cur.description[i][1]) for i in order]
    return [names[i] for i in order], types, sorted(tuple(cell(r[i]) for i in order) for r in cur.fetchall())


SAME = {
    "INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date",
}


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, sf: str, name: str) -> tuple[bool, str]:
    start = time.time()
    names, types, rows = spark_rows(registry.QUERIES[name](spark, sf))
    took = time.time() - start
    if name not in registry.ORACLE:
        return len(rows) > 0, f"rows-only n={len(rows)} spark={took:.1f}s"
    start = time.time()
    d_names, d_types, d_rows = duck_rows(con, registry.ORACLE[name])
    note = f"n={len(rows)} spark={took:.1f}s duck={time.time() - start:.1f}s"
    if names != d_names:
        return False, f"columns {names} vs {d_names}"
    wrong = [(n, a, b) for n, a, b in zip(names, types, d_types) if SAME.get(b, b) != a]
    if wrong:
        note += f" TYPES {wrong}"
    if rows != d_rows:
        a, b = set(rows) - set(d_rows), set(d_rows) - set(rows)
        return False, f"{note} spark {len(rows)} duck {len(d_rows)} diff {len(a)}/{len(b)}\n   {names}\n   S {str(sorted(a)[:2])[:900]}\n   D {str(sorted(b)[:2])[:900]}"
    return not wrong and len(rows) > 0, note


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    registry.load()
    names = sys.argv[2:] or list(registry.QUERIES)
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.postsift.scanTasks": "8"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf, name)
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
