"""Run registered queries against their SQL twins in DuckDB: oracle_check.py [sf dir] [name prefix...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from promptlake.catalog import all_oracles, all_queries  # noqa: E402
from promptlake.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def normal(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if v is None or isinstance(v, (bool, int, str)):
        return v
    return float(v) if type(v).__name__ == "Decimal" else str(v)


def key(row):
    return tuple((v is None, str(type(v).__name__ if not isinstance(v, (int, float)) else "n"), str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=key)


def compare(df, sql, con):
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    compare.spark_done = time.time()
    rel = con.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}", len(mine)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}", len(mine)
    for a, b in zip(mine, theirs):
        if a != b:
            return f"first difference\n   spark  {str(a)[:300]}\n   duckdb {str(b)[:300]}", len(mine)
    return None, len(mine)


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(8)
    con = connect(sf_dir)
    oracles = all_oracles()
    bad = 0
    for name, fn in all_queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            if name in oracles:
                problem, n = compare(fn(spark, sf_dir), oracles[name], con)
            else:
                df = fn(spark, sf_dir)
                problem, n = None, df.count()
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind:4} {name:28} {n:7} rows {(compare.spark_done if kind == 'sql' and not (problem or '').startswith('Ana') else time.time()) - t:6.2f}s {time.time() - t:6.2f}s {problem or ''}", flush=True)
        bad += problem is not None
    print("failed:", bad)


if __name__ == "__main__":
    main()
