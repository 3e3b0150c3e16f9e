"""Seeded, partition-independent hashing.

Every random-looking choice (splits, folds, shuffles, bootstrap draws, masks)
is a pure function of (seed, row key), so results do not depend on how the
data is partitioned, survive task retries unchanged, and have an exact
DuckDB twin:

    Spark : cast(conv(substr(md5(concat(seed, ':', key)), 1, 15), 16, 10) as bigint)
    DuckDB: ('0x' || substr(md5(seed || ':' || key), 1, 15))::BIGINT
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 16**15: the 15 hex digits give a non-negative 60-bit integer.
HASH_RANGE = float(16 ** 15)


def _key(seed, cols) -> Column:
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit(":"), (F.col(c) if isinstance(c, str) else c).cast("string")]
    return F.concat(*parts)


def hash_u60(seed, *cols) -> Column:
    """Non-negative 60-bit integer hash of (seed, cols...)."""
    return F.conv(F.substring(F.md5(_key(seed, cols)), 1, 15), 16, 10).cast("bigint")


def hash_unit(seed, *cols) -> Column:
    """Uniform double in [0, 1) from (seed, cols...)."""
    return hash_u60(seed, *cols) / F.lit(HASH_RANGE)


def sql_hash_u60(seed, *exprs: str) -> str:
    """DuckDB twin of :func:`hash_u60` (for oracle SQL)."""
    key = f"'{seed}'" + "".join(f" || ':' || CAST({e} AS VARCHAR)" for e in exprs)
    return f"('0x' || substr(md5({key}), 1, 15))::BIGINT"


def sql_hash_unit(seed, *exprs: str) -> str:
    return f"({sql_hash_u60(seed, *exprs)} / {HASH_RANGE!r})"
