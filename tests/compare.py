"""Rows as plain values, for comparison with DuckDB and with lists."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter
from pathlib import Path


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


def duck_rows(sf_dir: str, sql: str, columns: list[str]) -> Counter:
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(columns)
    at = [names.index(c) for c in sorted(columns)]
    return Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
