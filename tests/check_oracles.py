"""Run queries against their SQL in DuckDB: ``python tests/check_oracles.py [sf] [key ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

from topicloom.session import build_session, release  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True) if len(df) else df


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when both hold the same rows, types and columns."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = canonical(got), canonical(want)
    for name in got.columns:
        a, b = got[name], want[name]
        if a.dtype.kind != b.dtype.kind or (a.dtype.kind in "if" and a.dtype != b.dtype):
            return f"{name}: type {a.dtype} != {b.dtype}"
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = same.idxmin()
            return f"{name}: {(~same).sum()} differ, e.g. {got.loc[i].to_dict()} != {want.loc[i].to_dict()}"
    return ""


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    keys = sys.argv[2:] or list(entry.queries())
    con = connect(sf_dir)
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    bad = 0
    for key in keys:
        start = time.time()
        try:
            got = entry.queries()[key](spark, sf_dir).toPandas()
            took = time.time() - start
            sql = entry.oracle_sql().get(key)
            note = "rows only" if sql is None else difference(got, con.execute(sql).df()) or "ok"
        except Exception as error:  # noqa: BLE001
            got, took, note = [], time.time() - start, f"ERROR {str(error)[:600]}"
        bad += note not in ("ok", "rows only")
        print(f"{key:24s} {len(got):8d} rows {took:7.2f}s  {note[:700]}", flush=True)
    release(spark)
    print(f"{len(keys)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
