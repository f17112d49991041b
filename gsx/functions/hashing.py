"""Seeded, engine-independent hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed, *cols) -> Column:
    """md5 of ``seed|col|col…``: a random-looking order that any engine can rebuild."""
    parts = [F.lit(str(seed)), *[F.col(c) if isinstance(c, str) else c for c in cols]]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hash_int(seed, *cols) -> Column:
    """First 15 hex digits of :func:`hash_key` as a non-negative bigint."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 15), 16, 10).cast("bigint")
