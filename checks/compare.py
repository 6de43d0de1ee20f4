"""Runs queries against their SQL twins: ``python -m checks.compare [sf] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracles import ORACLES
from checks.queries import QUERIES
from hazeline.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.astype(object).where(df.notna(), None).map(str).sort_values(list(df.columns)).reset_index(drop=True)


def difference(spark, con, name: str, sf_dir: str) -> str:
    """Empty when equal, else a short description."""
    got_df = QUERIES[name](spark, sf_dir)
    got = got_df.toPandas()
    if name not in ORACLES:
        return "" if len(got) else "no rows"
    want = con.execute(ORACLES[name]).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = [
        f"{c}: {got[c].dtype} != {want[c].dtype}"
        for c in got.columns
        if got[c].dtype.kind != want[c].dtype.kind and "O" not in (got[c].dtype.kind, want[c].dtype.kind)
        and not (got[c].isna().any() or want[c].isna().any())
    ]
    for frame in (got, want):
        for c in frame.columns:
            if frame[c].dtype.kind in "iuf":
                frame[c] = frame[c].astype("float64")
            elif frame[c].dtype.kind == "M":
                frame[c] = frame[c].astype("datetime64[us]")
    a, b = canonical(got), canonical(want)
    if not a.equals(b):
        bad = (a != b).any(axis=0)
        rows = (a != b).any(axis=1)
        columns = list(bad[bad].index)
        first = rows[rows].index[0]
        return f"{int(rows.sum())} rows differ in {columns}: {a.loc[first, columns].tolist()} != {b.loc[first, columns].tolist()}"
    return ("types " + "; ".join(kinds)) if kinds else ""


def main() -> None:
    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "0.001"), sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            problem = difference(spark, con, name, sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        mark = "FAIL" if problem else ("ok" if name in ORACLES else "rows")
        print(f"{mark:5} {name:28} {time.time() - start:6.1f}s {problem}", flush=True)
    print("failed:", failed, "queries:", len(QUERIES), "oracles:", len(ORACLES))


if __name__ == "__main__":
    main()
