"""Compare registered queries with their SQL form in DuckDB.

Run as ``python tests/oracle.py [sf_dir] [name prefix ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


SPENT = [0.0]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "\\N"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f + 0.0:.10g}"
    return str(v)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, query):
    """Empty string when both sides agree, else a short difference."""
    start = time.time()
    df = query.run(spark, sf)
    got_names, got = table_of(df.columns, [tuple(r) for r in df.collect()])
    SPENT.append(time.time() - start)
    if query.sql is None:
        return "" if got else "no rows"
    cur = con.execute(query.sql)
    want_names, want = table_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} / {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ {got_names}: {bad[:2]}"
    return "" if got else "no rows"


def main(argv):
    from gsx.plans import catalog

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = session(), duck(sf)
    failed = 0
    for name, q in catalog().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, sf, q)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(problem)
        mark = "FAIL" if problem else ("ok  " if q.sql else "rows")
        print(f"{mark} {SPENT[-1]:6.2f}s of {time.time() - t:6.2f}s {name} {problem}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
