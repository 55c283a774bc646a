"""Run a registered Spark query and its DuckDB oracle; compare like the driver.

Row count, column names, and an order-insensitive comparison of values
(floats rounded to 9 significant digits).
"""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, (int,)) or type(v).__name__.startswith("int"):
        return float(int(v))
    if type(v).__name__.startswith("float"):
        return float(f"{float(v):.9g}")
    return v


def _rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for _, r in df.iterrows()]
    return sorted(out, key=lambda t: tuple((x is None, repr(x)) for x in t))


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None) -> dict:
    sdf = fn(spark, sf_dir).toPandas()
    con = con or duck(sf_dir)
    ddf = con.execute(sql).df()
    res = {"name": name, "spark_rows": len(sdf), "oracle_rows": len(ddf),
           "spark_cols": sorted(sdf.columns), "oracle_cols": sorted(ddf.columns)}
    res["cols_ok"] = res["spark_cols"] == res["oracle_cols"]
    res["rows_ok"] = len(sdf) == len(ddf)
    res["values_ok"] = res["cols_ok"] and res["rows_ok"] and _rows(sdf) == _rows(ddf)
    if not res["values_ok"] and res["cols_ok"] and res["rows_ok"]:
        a, b = _rows(sdf), _rows(ddf)
        diffs = [(x, y) for x, y in zip(a, b) if x != y]
        res["first_diff"] = diffs[:2]
    return res
