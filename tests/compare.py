"""Run registered queries beside their SQL and report differences: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {table} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(map(str, (plain(r[i]) for i in order))) for r in rows)


def differences(spark, con, name, job, sql, sf_dir):
    df = job(spark, sf_dir)
    left = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(left[1]), None
    cur = con.execute(sql)
    right = table([d[0] for d in cur.description], cur.fetchall())
    if left == right:
        return len(left[1]), ""
    if left[0] != right[0]:
        return len(left[1]), f"columns {left[0]} != {right[0]}"
    mine, theirs = set(left[1]) - set(right[1]), set(right[1]) - set(left[1])
    cut = lambda rows: [str(r)[:400] for r in sorted(rows)[:3]]
    return len(left[1]), f"{len(left[1])} rows vs {len(right[1])}\n   spark {cut(mine)}\n   duck  {cut(theirs)}"


def main():
    import __spark_entry__ as entry
    from runlens.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con, jobs, sqls = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name, job in jobs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        begun = time.time()
        try:
            rows, diff = differences(spark, con, name, job, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on
            rows, diff = -1, f"{type(error).__name__} {str(error)[:900]}"
        state = "rows-only" if diff is None else "ok" if diff == "" else "DIFF"
        bad += state == "DIFF"
        print(f"{state:9} {name:28} rows={rows} {time.time() - begun:.1f}s {diff or ''}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main()
