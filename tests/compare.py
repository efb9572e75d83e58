"""Run a query and its DuckDB SQL over the same tables and compare the rows."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([columns[i] for i in order], *[repr(tuple(plain(r[i]) for i in order)) for r in rows])[1:])


def duck(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def differences(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same rows."""
    df = query(spark, sf_dir)
    columns, rows = duck(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    a, b = rows_of(df.columns, df.collect()), rows_of(columns, rows)
    if a == b:
        return ""
    return f"{len(a)} rows against {len(b)}; first ours {next((x for x in a if x not in set(b)), None)}, first theirs {next((x for x in b if x not in set(a)), None)}"
