"""Where queries and their SQL register themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_ledger: bool = True):
    """Register a query and, where there is one, its SQL; with_ledger puts the ledger's tables before it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {A.SQL.strip()}\n{sql}" if with_ledger else sql
        return f

    return add


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles at the very end: they are exact sums until then."""
    return df.select(*(F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes))
