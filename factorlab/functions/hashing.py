"""Deterministic pseudo-random numbers from md5.

The value depends only on the key string, so it is independent of the
partitioning and of the engine: DuckDB computes the same numbers, which is
what lets random initialisation, sampling and pair generation be checked
against an SQL oracle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def md5_u32(key: Column) -> Column:
    """First 32 bits of md5(key) as a non-negative bigint."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")


def md5_u60(key: Column) -> Column:
    """First 60 bits of md5(key) as a non-negative bigint."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("bigint")


def hash01(key: Column) -> Column:
    """Uniform value in [0, 1) derived from md5(key)."""
    return md5_u32(key) / F.lit(TWO_32)


def sql_hash01(key_sql: str) -> str:
    """DuckDB twin of :func:`hash01` for oracle SQL."""
    return f"(('0x' || substr(md5({key_sql}), 1, 8))::BIGINT / 4294967296.0)"


def sql_md5_u32(key_sql: str) -> str:
    return f"(('0x' || substr(md5({key_sql}), 1, 8))::BIGINT)"


def sql_md5_u60(key_sql: str) -> str:
    return f"(('0x' || substr(md5({key_sql}), 1, 15))::BIGINT)"


def uniform_factor(seed: int, side: str, id_col: Column, i: int, scale: float = 5.0) -> Column:
    """scale * U[0,1) for component i of entity id (M7 initialisation)."""
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(side), id_col.cast("string"), F.lit(str(i)))
    return F.lit(scale) * hash01(key)


def sql_uniform_factor(seed: int, side: str, id_sql: str, i: int, scale: float = 5.0) -> str:
    key = f"concat_ws(':', '{seed}', '{side}', CAST({id_sql} AS VARCHAR), '{i}')"
    return f"({scale}e0 * {sql_hash01(key)})"


def mix64(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of every uint64 (wraps around): the numpy side of a row hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
