"""Tables of records that change by key: lookup, upsert, replacement and deletion as unions and joins, latest row first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(table: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values; filters that a scan can use."""
    for c, v in equal.items():
        table = table.where(F.col(c) == v)
    return table


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """New rows in place of those of the same key."""
    rest = [c for c in table.columns if c not in key]
    both = table.withColumn("_v", F.lit(0)).unionByName(changes.withColumn("_v", F.lit(1)))
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), "_v").alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*table.columns)


def replace(table: DataFrame, rows: DataFrame, scope: list[str]) -> DataFrame:
    """All rows of the scopes that the new rows name go, and the new rows come."""
    return table.join(rows.select(*scope).distinct(), scope, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.distinct(), keys.columns, "left_anti").select(*table.columns)
