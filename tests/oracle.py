"""Compare queries with their SQL on DuckDB, order aside."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple") or isinstance(v, (int, float)):
        return f"{float(v):.6g}" if isinstance(v, float) and abs(v) < 1e-3 else f"{float(v):.4f}"
    return str(v)


def difference(spark, run, sql: str, sf_dir: str, may_be_empty: bool = False) -> str | None:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, rel = run(spark, sf_dir), con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    names = sorted(df.columns)
    mine = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    other = sorted(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    if not other and not may_be_empty:
        return "no rows"
    if len(mine) != len(other):
        return f"{len(mine)} rows / {len(other)}"
    return next((f"{names}: {a} / {b}" for a, b in zip(mine, other) if a != b), None)
