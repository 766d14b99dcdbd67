"""Partition-invariant randomness: uniform draws keyed by (seed, purpose, row key) through md5.

``rand(seed)`` depends on how rows are partitioned; a keyed hash does not, and any SQL engine can repeat it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def u01(seed: int, purpose: str, *key: Column | str) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the key's md5."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def u01_sql(seed: int, purpose: str, *key: str) -> str:
    """The same draw in DuckDB's SQL."""
    keys = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', '{purpose}', {keys})), 1, 8))::BIGINT / 4294967296.0)"


def integer(u: Column, low: int, high: int) -> Column:
    """Uniform integer in [low, high], both included."""
    return (F.floor(u * F.lit(float(high - low + 1))) + F.lit(low)).cast("long")


def pick(u: Column, values: Column) -> Column:
    """Uniform element of an array column; null if it is empty."""
    return F.get(values, F.floor(u * F.size(values)).cast("int"))


def gauss(u1: Column, u2: Column) -> Column:
    """Standard normal draw of two uniform ones (Box-Muller)."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2)


def gauss_sql(u1: str, u2: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos(2 * pi() * {u2}))"
