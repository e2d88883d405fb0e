"""Run registered queries and their SQL side by side and compare the values.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith(("str", "datetime")):
            df[c] = df[c].map(lambda v: "<null>" if v is None or v is pd.NaT or v != v else str(v))
    df = df.fillna(-987654321.0) if len(df) else df
    for c in df.columns:
        if str(df[c].dtype) in ("float64", "float32", "int32", "int64", "bool"):
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """Empty when equal, else what differs first."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        a, b = canonical(spark_df), canonical(sql_df)
        both = a.merge(b, how="outer", indicator=True)
        odd = both[both["_merge"] != "both"].head(6)
        return f"rows {len(spark_df)} / {len(sql_df)}\n{odd.to_string()}"
    a, b = canonical(spark_df), canonical(sql_df)
    same = (a == b).all(axis=1)
    if same.all():
        return ""
    return f"{(~same).sum()} rows differ\n{a[~same].head(4)}\n{b[~same].head(4)}"


def main(sf_dir: str, names: list[str]) -> int:
    from tests.conftest import make_session
    from __spark_entry__ import oracle_sql, queries

    spark = make_session()
    con = connect(sf_dir)
    runs, sqls = queries(), oracle_sql()
    bad = 0
    for name in names or runs:
        start = time.time()
        try:
            got = runs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001 - report and go on
            print(f"{name:28s} SPARK {str(e)[:600]}", flush=True)
            bad += 1
            continue
        mid = time.time()
        if name not in sqls:
            print(f"{name:28s} rows {len(got):7d} spark {mid - start:6.1f}s (no SQL)", flush=True)
            continue
        try:
            want = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SQL {str(e)[:600]}", flush=True)
            bad += 1
            continue
        diff = differences(got, want)
        bad += bool(diff)
        print(
            f"{name:28s} rows {len(got):7d} spark {mid - start:6.1f}s sql {time.time() - mid:6.1f}s "
            f"{'OK' if not diff else 'DIFF ' + diff}",
            flush=True,
        )
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
