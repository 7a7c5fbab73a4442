"""Spark against DuckDB on the same Parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, list):
        return str([norm(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ").removesuffix(" 00:00:00").split("+")[0]
    return str(v)


def difference(spark_df, con, sql: str) -> str:
    """Empty if columns and rows agree, order aside."""
    cols = sorted(spark_df.columns)
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in spark_df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    if mine == theirs:
        return ""
    extra, missing = [r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3]
    return f"{len(mine)} rows and {len(theirs)}; only in Spark {extra}; only in DuckDB {missing}"
