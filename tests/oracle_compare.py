"""Run a Spark result and a DuckDB text side by side and compare rows without order."""

from __future__ import annotations

import datetime as dt
import decimal
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return f"{f + 0.0:.9g}"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def normalized(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def _close(left, left_names, right, right_names, tol: float = 1e-7) -> bool:
    """Equal up to the last digits: rows keyed by their exact columns, floats compared closely."""
    if len(left) != len(right):
        return False
    names = sorted(left_names)
    floats = [n for n in names if any(isinstance(r[list(left_names).index(n)], float) for r in left)]
    exact = [n for n in names if n not in floats]

    def keyed(rows, cols):
        at = {n: i for i, n in enumerate(cols)}
        out = [(tuple(_norm(r[at[n]]) for n in exact), tuple(r[at[n]] for n in floats)) for r in rows]
        return sorted(out, key=lambda x: (x[0], tuple(-1e300 if v is None else round(float(v), 4) for v in x[1])))

    for (ka, va), (kb, vb) in zip(keyed(left, left_names), keyed(right, right_names)):
        if ka != kb:
            return False
        for x, y in zip(va, vb):
            if (x is None) != (y is None) or (x is not None and abs(float(x) - float(y)) > tol * max(1.0, abs(float(x)))):
                return False
    return True


def compare(df, con, sql: str) -> tuple[bool, str]:
    rows = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    other = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = normalized(rows, df.columns), normalized(other, names)
    if a == b:
        return True, f"{len(a)} rows"
    if _close(rows, df.columns, other, names):
        return True, f"{len(a)} rows within tolerance"
    in_a, in_b = set(a), set(b)
    left, right = [x for x in a if x not in in_b], [x for x in b if x not in in_a]
    return False, f"{len(a)} vs {len(b)} rows; cols {sorted(names)}; spark-only {left[:2]} duck-only {right[:2]}"
