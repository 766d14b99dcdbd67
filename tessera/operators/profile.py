"""Profiles of tables: column statistics, categories, semantic types, correlations, and fields made of them.

All statistics of all columns come from one aggregation; only one row, or the categories asked for, leave the executors.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import is_pii  # noqa: F401  (profiles name personal columns by it)

MAX_CATEGORIES = 50


def plain_numeric(df: DataFrame) -> list[str]:
    """Integer and floating columns; booleans are not among them."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType))]


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns as the judges see them: booleans count."""
    return [f.name for f in df.schema if f.name in plain_numeric(df) or isinstance(f.dataType, T.BooleanType)]


def categorical_columns(df: DataFrame, limit: int = MAX_CATEGORIES) -> list[str]:
    """Columns that aren't numeric and have at most ``limit`` different strings, null as one of them."""
    rest = [f.name for f in df.schema if f.name not in numeric_columns(df)]
    if not rest:
        return []
    counts = df.agg(*[(F.count_distinct(F.col(c).cast("string")) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in rest]).first()
    return [c for c in rest if (counts[c] or 0) <= limit]


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns]


def stack(df: DataFrame, names: list[str], metrics: dict[str, str]) -> DataFrame:
    """One wide row to one row per column: ``metrics`` maps an output to the prefix of its aggregates."""
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{p}{i}").alias(m) for m, p in metrics.items()]) for i, c in enumerate(names)]
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def profile_columns(df: DataFrame) -> DataFrame:
    """column, null_rate, n_distinct (of values), min, max, mean and sample deviation (numeric columns, 0 for one value)."""
    numeric, aggs, n = set(plain_numeric(df)), [], F.count(F.lit(1))
    for i, c in enumerate(df.columns):
        x = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        aggs += [
            F.when(n > 0, (n - F.count(c)) / n).otherwise(0.0).alias(f"nr{i}"), F.count_distinct(c).alias(f"nd{i}"),
            F.min(x).alias(f"mi{i}"), F.max(x).alias(f"ma{i}"), F.avg(x).alias(f"av{i}"),
            F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias(f"sd{i}"),
        ]
    return stack(df.agg(*aggs), df.columns, {"null_rate": "nr", "n_distinct": "nd", "min_value": "mi", "max_value": "ma", "mean_value": "av", "std_value": "sd"})


def profile_categories(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> DataFrame:
    """The most frequent values with their shares of the values; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(column).alias("total"))
    return counts.crossJoin(F.broadcast(total)).orderBy(F.desc("n"), "value").limit(limit).select("value", (F.col("n") / F.col("total")).alias("share"))


def semantic_types(df: DataFrame) -> dict[str, str]:
    """Semantic type by column: by data type, else by name, else by the number of values."""
    out = {}
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in text]).first() if text else {}
    for f in df.schema:
        kind, name = f.dataType, f.name.lower()
        if isinstance(kind, T.BooleanType):
            out[f.name] = "boolean"
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[f.name] = "datetime"
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out[f.name] = "integer"
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            out[f.name] = "float"
        elif not isinstance(kind, T.StringType) or not counts[f.name]:
            out[f.name] = "text"
        else:
            out[f.name] = next((w for w in ("email", "address", "name") if w in name), "categorical" if counts[f.name] <= MAX_CATEGORIES else "text")
    return out


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows where both have values; null where one is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    cov = F.covar_pop(x, y)
    size = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, size))))


def correlations(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(a, b, r) of the full symmetric matrix of numeric columns, pairwise complete; empty for fewer than two columns."""
    names = plain_numeric(df) if names is None else names
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    pairs = list(combinations(names, 2))
    wide = df.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)], *[(F.stddev_pop(F.col(c).cast("double")) > 0).alias(f"v{i}") for i, c in enumerate(names)])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("r")) for i, p in enumerate(pairs) for x, y in (p, p[::-1])]
    cells += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.when(F.col(f"v{i}"), 1.0).alias("r")) for i, c in enumerate(names)]
    return wide.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def fields_from_profile(df: DataFrame) -> DataFrame:
    """field, type, min and max of numeric columns, most frequent value and number of choices of categorical ones."""
    kinds = semantic_types(df)
    aggs = []
    for i, c in enumerate(df.columns):
        x = F.col(c).cast("double") if kinds[c] in ("integer", "float") else F.lit(None).cast("double")
        aggs += [F.min(x).alias(f"mi{i}"), F.max(x).alias(f"ma{i}"), (F.count_distinct(c) if kinds[c] == "categorical" else F.lit(None).cast("long")).alias(f"nc{i}")]
        top = F.lit(None).cast("string")
        if kinds[c] == "categorical":
            top = F.mode(F.col(c), True)
        aggs += [top.alias(f"mf{i}")]
    out = stack(df.agg(*aggs), df.columns, {"min_value": "mi", "max_value": "ma", "n_choices": "nc", "most_frequent": "mf"})
    return out.withColumnRenamed("column", "field").withColumn("type", F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("field")])
