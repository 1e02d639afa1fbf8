"""Compare a Spark result with its DuckDB oracle: row count, column names and
order-insensitive values (dates normalised to ISO text, -0.0 to 0.0)."""

from __future__ import annotations

import datetime as dt
import math
import os

import pandas as pd

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in RAW_TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple, dict)):
        return repr(v)
    if pd.isna(v):
        return None
    if isinstance(v, dt.datetime):
        return v.date().isoformat() if v.time() == dt.time(0) else v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def normalized_rows(pdf: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=repr)


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> tuple[bool, str]:
    sc, sr = normalized_rows(spark_pdf)
    oc, orr = normalized_rows(oracle_pdf)
    if sc != oc:
        return False, f"columns differ: spark={sc} oracle={oc}"
    if len(sr) != len(orr):
        return False, f"row counts differ: spark={len(sr)} oracle={len(orr)}"
    if sr != orr:
        diff = [(a, b) for a, b in zip(sr, orr) if a != b]
        return False, f"{len(diff)} rows differ; first: {diff[:2]}"
    return True, f"{len(sr)} rows equal"
