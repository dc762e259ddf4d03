"""Compare a registered query with its SQL oracle (row count, names, values).

Values are compared exactly after sorting rows; columns are matched by name.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name: str, sf_dir: str, queries: dict, sqls: dict) -> tuple[bool, str]:
    df = queries[name](spark, sf_dir)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(sqls[name])
    d_cols, d_rows = [c[0] for c in res.description], res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: {sorted(s_cols)} vs {sorted(d_cols)}"
    a, b = canonical(s_cols, s_rows), canonical(d_cols, d_rows)
    if a != b:
        only_a = [r for r in a if r not in b][:2]
        only_b = [r for r in b if r not in a][:2]
        return False, f"{len(a)} vs {len(b)} rows; spark-only {only_a}; sql-only {only_b}"
    return True, f"{len(a)} rows"
