"""Fingerprints: sha256 of a canonical form."""

from __future__ import annotations

from pyspark.sql import functions as F


def joined(*cols, sep: str = "|"):
    """sha256 of the columns' texts, null as empty, joined by a mark."""
    return F.sha2(F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)), 256)


def canonical(*cols):
    """sha256 of compact JSON with sorted keys; nulls stay, characters are not escaped (our own canonical form)."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(cols))), {"ignoreNullFields": "false"}), 256)


def generated_id(prefix: str, *cols):
    return F.concat(F.lit(prefix + ":"), F.substring(canonical(*cols), 1, 32))


def spaced(**values):
    """sha256 of JSON with sorted keys and a space behind each mark; the values are JSON texts."""
    parts = [F.concat(F.lit(f'"{k}": '), values[k]) for k in sorted(values)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)
