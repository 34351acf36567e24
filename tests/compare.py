"""Run registered queries and their oracle SQL side by side."""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    return f"{v:.9f}" if isinstance(v, float) else v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.sql(sql)
    want = rows_of(cur.columns, cur.fetchall())
    if sorted(df.columns) != sorted(cur.columns):
        return f"columns {sorted(df.columns)} != {sorted(cur.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, oracle {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first:\n  {bad[0][0]}\n  {bad[0][1]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from lawspark.plans.oracles import ORACLES
    from lawspark.plans.queries import QUERIES
    from lawspark.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    SparkSession.builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    spark = local_session(2)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    for name in names:
        t = time.time()
        try:
            out = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
        except Exception as e:
            out = f"{type(e).__name__}: {str(e)[:1200]}"
        print(f"\n@@ {name} {time.time() - t:.1f}s {'ok' if out is None else out}", flush=True)
