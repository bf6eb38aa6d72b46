"""Compare queries with their SQL: python tests/oracle.py [sf_dir] [name ...]."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if hasattr(v, "isoformat") else v


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' if the rows are equal in any order."""
    got = con.sql(sql)
    cols = sorted(df.columns)
    if cols != sorted(got.columns):
        return f"columns {cols} and {sorted(got.columns)}"
    at = [got.columns.index(c) for c in cols]
    ours = sorted((repr([plain(r[c]) for c in cols]) for r in df.collect()))
    theirs = sorted((repr([plain(r[k]) for k in at]) for r in got.fetchall()))
    if ours == theirs:
        return ""
    a, b = [x for x in ours if x not in set(theirs)][:2], [x for x in theirs if x not in set(ours)][:2]
    return f"{len(ours)} and {len(theirs)} rows; ours {a}; SQL's {b}"[:900]


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sql = connection(sf), entry.oracle_sql()
    for name, f in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or name not in sql:
            continue
        try:
            print(name, difference(f(spark, sf), con, sql[name]) or "ok", flush=True)
        except Exception as e:  # noqa: BLE001 report and go on
            print(name, "ERROR", str(e)[:600], flush=True)
