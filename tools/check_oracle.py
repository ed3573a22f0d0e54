"""Run every named query on Spark and its SQL on DuckDB and compare the rows.

    python tools/check_oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import importlib
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return 0.0 if f == 0 else f
    return str(v)


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = [tuple(canon(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False, name=None)]
    key = lambda r: tuple((x is None, str(type(x)), round(x, 4) if isinstance(x, float) else str(x)) for x in r)
    return sorted(out, key=key)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    return a == b


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return False, f"columns {sorted(set(spark_pdf.columns) ^ set(duck_pdf.columns))}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"rows {len(spark_pdf)} != {len(duck_pdf)}"
    a, b = rows_of(spark_pdf), rows_of(duck_pdf)
    cols = sorted(spark_pdf.columns)
    bad, exact = {}, True
    first = ""
    for x, y in zip(a, b):
        for c, u, v in zip(cols, x, y):
            if u != v:
                exact = False
                if not same(u, v):
                    bad[c] = bad.get(c, 0) + 1
                    first = first or f"{c}: {u!r} != {v!r}"
    if bad:
        return False, f"values differ {bad} first {first}"
    return True, f"{len(a)} rows" + ("" if exact else " (inexact floats)")


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from logwarden.session import local_session

    entry = importlib.import_module("__spark_entry__")
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8, "check")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        started = time.time()
        try:
            pdf = fn(spark, sf_dir).toPandas()
            took = time.time() - started
            if name in oracles:
                duck = time.time()
                ok, note = compare(pdf, con.execute(oracles[name]).df())
                note += f"  [duck {time.time() - duck:.1f}s]"
            else:
                ok, note = True, f"{len(pdf)} rows, no SQL"
        except Exception as exc:  # report and go on
            took, ok, note = time.time() - started, False, f"{type(exc).__name__}: {str(exc)[:600]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {took:6.2f}s  {note}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
