"""Holds a query against its DuckDB SQL."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return int(v) if type(v).__name__ == "Decimal" else v


def connect(sf_dir: str):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def assert_same(spark, query, sql: str, sf_dir: str) -> int:
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    rows = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    rel = connect(sf_dir).sql(sql)
    assert sorted(rel.columns) == cols
    want = Counter(tuple(plain(v) for v in r) for r in rel.select(*(f'"{c}"' for c in cols)).fetchall())
    assert rows == want
    return sum(rows.values())
