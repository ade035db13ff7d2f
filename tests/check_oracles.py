"""Compare every named query with its SQL oracle: ``python tests/check_oracles.py [sf] [name..]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


def nullable(df: pd.DataFrame) -> pd.DataFrame:
    """Whole-number columns in one type, whether or not the reader saw nulls in them."""
    whole = {
        c: "Int64"
        for c in df.columns
        if pd.api.types.is_numeric_dtype(df[c])
        and not pd.api.types.is_bool_dtype(df[c])
        and df[c].isna().any()
        and (df[c].dropna() % 1 == 0).all()
    }
    return df.astype(whole)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    got, want = canonical(nullable(got)), canonical(nullable(want))
    for c in got.columns:
        if str(got[c].dtype) != str(want[c].dtype):
            return f"{c}: {got[c].dtype} vs {want[c].dtype}"
        same = ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).fillna(False).to_numpy()
        if not same.all():
            at = int((~same).argmax())
            return f"{c}: {got[c][at]!r} vs {want[c][at]!r} in row {at}"
    return None


def check(spark, con, sf_dir: str, name: str) -> tuple[str | None, float]:
    t0 = time.perf_counter()
    got = entry.queries()[name](spark, sf_dir).toPandas()
    seconds = time.perf_counter() - t0
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return (None if len(got) else "no rows"), seconds
    return difference(got, con.execute(sql).df()), seconds


if __name__ == "__main__":
    from conftest import make_session

    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    session = make_session()
    con = connect(sf)
    bad = 0
    for name in sys.argv[2:] or entry.queries():
        try:
            problem, seconds = check(session, con, sf, name)
        except Exception as error:  # report and go on to the next query
            problem, seconds = f"{type(error).__name__}: {str(error)[:600]}", 0.0
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':5s}{name:28s}{seconds:7.2f}s  {problem or ''}", flush=True)
    sys.exit(bad > 0)
