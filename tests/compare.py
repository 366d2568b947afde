"""Runs registered queries beside their SQL in DuckDB and compares all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """Values as both engines can give them; floats to 6 places."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = Path(f"{sf_dir}/{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def differences(spark, con, query, sql, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    want = rows_of([d[0] for d in found.description], found.fetchall())
    out = []
    if got[0] != want[0]:
        out.append(f"columns {got[0]} and {want[0]}")
    if len(got[1]) != len(want[1]):
        out.append(f"{len(got[1])} rows and {len(want[1])}")
    out += [f"{a} and {b}" for a, b in zip(got[1], want[1], strict=False) if a != b][:3]
    return out
