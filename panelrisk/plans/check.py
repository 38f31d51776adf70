"""Local correctness harness: a registered Spark query vs its DuckDB oracle.

Mirrors the driver's gate (row count, column names, order-insensitive
values) so a query can be checked before a round ends. DuckDB runs
in-process on the same parquet files; nothing is served.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

from ..sources.tables import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:10] if len(str(v)) >= 10 and str(v)[10:].strip("0: ") == "" else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import numpy as np

        if isinstance(v, np.generic):
            return _norm(v.item())
        if isinstance(v, np.ndarray):
            return tuple(_norm(x) for x in v.tolist())
    except ImportError:
        pass
    return v


def _rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name: str, sf_dir: str, con=None, verbose: bool = True) -> dict:
    from .oracle import oracle_sql
    from .queries import queries

    q = queries()[name]
    t0 = time.time()
    sdf = q(spark, sf_dir).toPandas()
    t1 = time.time()
    sql = oracle_sql().get(name)
    res = {"name": name, "spark_rows": len(sdf), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        if verbose:
            print(res, flush=True)
        return res
    con = con or duck(sf_dir)
    odf = con.execute(sql).df()
    res["oracle_rows"] = len(odf)
    sc, sr = _rows(sdf)
    oc, orows = _rows(odf)
    if sc != oc:
        res["status"] = f"columns differ: spark={sc} oracle={oc}"
    elif len(sr) != len(orows):
        res["status"] = "row count differs"
    else:
        bad = [(a, b) for a, b in zip(sr, orows) if a != b]
        res["status"] = "match" if not bad else f"{len(bad)} rows differ, e.g. {bad[0]}"
    if verbose:
        print(res, flush=True)
    return res


if __name__ == "__main__":
    from ..session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(shuffle_partitions=8)
    from .queries import queries

    con = duck(sf)
    results = []
    for n in names or sorted(queries()):
        try:
            results.append(compare(spark, n, sf, con))
        except Exception as e:  # report and continue
            print({"name": n, "status": f"error: {type(e).__name__}: {str(e)[:300]}"}, flush=True)
    ok = sum(1 for r in results if r["status"] == "match")
    print(f"{ok}/{len(results)} match")
