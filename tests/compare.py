"""Run queries beside their SQL: ``python tests/compare.py SF_DIR NAME...`` (all with SQL if none is named)."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con.execute(sql).df()


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else repr(round(v, 6)) if isinstance(v, float) else str(list(v)) if hasattr(v, "tolist") and hasattr(v, "__len__") else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """Empty when both hold the same rows, else what differs."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} and {len(sql_df)}"
    a, b = canon(spark_df), canon(sql_df)
    bad = (a != b).any(axis=1)
    return "" if not bad.any() else f"{int(bad.sum())} rows differ, as\n{a[bad].head(3).to_string()}\n{b[bad].head(3).to_string()}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sqls = e.oracle_sql()
    for name in sys.argv[2:] or list(sqls):
        t = time.time()
        try:
            got = e.queries()[name](spark, sys.argv[1]).toPandas()
        except Exception as x:  # the others still run
            print(name, "FAILED", str(x)[:600], flush=True)
            continue
        s = time.time() - t
        print(name, len(got), f"{s:.1f} s", (difference(got, oracle(sqls[name], sys.argv[1])) or "same") if name in sqls else "no SQL", flush=True)
        if name not in sqls:
            print(got.head(5).to_string())
