"""Run every registered query next to its checking SQL and compare the results.

    python tests/check.py [sf folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith(("float", "Float")):
            df[c] = df[c].astype("float64") + 0.0
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if not len(got):
        return "no rows"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if got[c].dtype != want[c].dtype
             and not got[c].isna().any()}
    kinds = {c: k for c, k in kinds.items() if not (k[0].startswith("datetime") and k[1].startswith("datetime"))}
    if kinds:
        return f"types {kinds}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"column {c} row {i} ({(~same).sum()} rows): {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from rdspark.session import local_session
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = local_session(8), duck(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or queries:
        begin = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
            continue
        took = time.time() - begin
        if name not in oracle:
            print(f"rows {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        try:
            want = con.sql(oracle[name]).df()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name} (sql): {str(e)[:700]}", flush=True)
            continue
        wrong = difference(got, want)
        bad += wrong is not None
        print(f"{'DIFF' if wrong else 'ok  '} {name}: {len(got)} rows, {took:.1f}s {wrong or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
