"""Runs registered queries next to their SQL twin and compares all values."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("threadloom-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{type(r[i]).__name__}:{r[i]!r}" for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    """None when equal, else a short text of the difference."""
    got = query(spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} != {sorted(names)}"
    a, b = rows_of(got.columns, rows), rows_of(names, want)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"rows {len(a)} != {len(b)}; only spark {str(only_a)[:900]}; only sql {str(only_b)[:900]}"


if __name__ == "__main__":
    from threadloom import catalog

    sf = sys.argv[1]
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 and sys.argv[2] else None
    if wanted and wanted[0].startswith("@"):
        catalog.MODULES = [m[1:] for m in wanted]
        wanted = None
    queries, sql = catalog.load()
    spark, con = session(), connect(sf)
    bad = 0
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sql:
                diff = compare(spark, con, query, sql[name], sf)
            else:
                diff = None if query(spark, sf).count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            diff = f"{type(error).__name__}: {str(error)[:700]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {time.time() - start:6.2f}s {name}{'' if name in sql else ' (rows)'} {diff or ''}", flush=True)
    print("bad:", bad)
    spark.stop()
