"""Runs registered queries against their SQL twins; also a command: python tests/oracle.py [NAME...]."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    value = lambda v: "null" if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)) else f"{v}.000000" if isinstance(v, int) and not isinstance(v, bool) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(value(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False, name=None))


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    return f"{len(a)} and {len(b)} rows; only here {[x for x in a if x not in set(b)][:2]}; only there {[x for x in b if x not in set(a)][:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[8]")).config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con, queries, oracles = connect(sf_dir), entry.queries(), entry.oracle_sql()
    for name in [n for n in oracles if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]:
        t = time.time()
        try:
            found = differences(spark, con, name, queries[name], oracles[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{'ok  ' if not found else 'BAD '} {name} {time.time() - t:.1f}s {found[:600]}", flush=True)
