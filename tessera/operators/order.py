"""Places, running sums and distinct values in a total order, by range partitions of a bounded number of rows.

Rows are ranked or summed within their partition; only one row for each group in each partition is put in one order, so
no task holds a column's values or a large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.shared import cut

#: Rows of a range partition.
ROWS = 250_000
#: Rows up to which a table is broadcast.
SMALL = 1_000_000


def checked(df: DataFrame) -> DataFrame:
    """``df``, written, to be broadcast if it has few rows; a larger one meets others by a shuffle."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= SMALL else kept


def _ranged(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """``df`` is read three times here: to be counted, to draw bounds, and to be dealt; what is dear to make should be written before."""
    parts = max(1, -(-df.count() // rows))
    return df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())


def running(df: DataFrame, groups: list[str], order: list[str], values: list[str], rows: int = ROWS) -> DataFrame:
    """``cum_<v>``, the sum of each value over the rows of the group up to this one in order, and ``all_<v>``, over all of the group.

    Groups may not be null; rows of one place in the order count in any."""
    ranged = _ranged(df, [*groups, *order], rows)
    upto = W.partitionBy("_p", *groups).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # Written once: another run of the range shuffle could draw other bounds, and both sides below must agree on them.
    local = cut(ranged.select("*", *[F.sum(v).over(upto).alias(f"cum_{v}") for v in values]))
    sums = local.groupBy("_p", *groups).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    before, whole = W.partitionBy(*groups).orderBy("_p").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*groups)
    starts = sums.select("_p", *groups, *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values], *[F.sum(f"_sum_{v}").over(whole).alias(f"all_{v}") for v in values])
    out = local.join(checked(starts), ["_p", *groups])
    return out.select(*df.columns, *[(F.col(f"cum_{v}") + F.col(f"_before_{v}")).alias(f"cum_{v}") for v in values], *[f"all_{v}" for v in values])


def ordinals(df: DataFrame, order: list[str], rows: int = ROWS) -> DataFrame:
    """``_i``, the place of each row in the total order of the key columns, and ``_n``, the number of rows."""
    local = cut(_ranged(df, order, rows).withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1))
    sizes = local.groupBy("_p").agg(F.count("*").alias("_c"))
    starts = sizes.select("_p", (F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_start"), F.sum("_c").over(W.partitionBy()).alias("_n"))
    # One row for each partition; they would be 250 GB of places before this is large.
    return local.join(F.broadcast(starts), "_p").withColumn("_i", F.col("_i") + F.col("_start")).drop("_p", "_start")


def places(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``_k``, the place of each row within its group, from 0, and ``_size``, the group's rows."""
    out = running(df.withColumn("_one", F.lit(1).cast("long")), [group], order, ["_one"])
    return out.withColumn("_k", F.col("cum__one") - 1).withColumnRenamed("all__one", "_size").drop("_one", "cum__one")


def ranked_values(df: DataFrame, column: str) -> DataFrame:
    """(value, rank, kinds): distinct values of a column in order, null left out, the number of them with each."""
    known = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return ordinals(known, ["value"]).select("value", F.col("_i").alias("rank"), F.col("_n").alias("kinds"))
