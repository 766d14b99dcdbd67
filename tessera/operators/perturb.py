"""Seeded perturbations of table columns: noise, drift, outliers, bias and edge cases.

Every draw is keyed by (seed, purpose, column, row key), so a result doesn't depend on partitions or row order. What an
operator needs to know of a column (deviation, extremes) is one aggregation joined back as one row, or is given as
``stats`` that were taken before (``column_stats``); categories are joined by their rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import scalars as S
from tessera.functions.rng import gauss, u01
from tessera.operators.order import checked, ordinals, ranked_values
from tessera.operators.profile import plain_numeric


def targets(df: DataFrame, kind: str, wanted: list[str] | None = None, key: tuple[str, ...] = ()) -> list[str]:
    """Columns of a kind (numeric or string), of those wanted if any are; never the key."""
    able = plain_numeric(df) if kind == "numeric" else [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return [c for c in able if c not in key and (not wanted or c in wanted)]


def _whole(df: DataFrame, column: str, x: Column) -> Column:
    """Back in the column's type; integers are rounded half to even."""
    kind = df.schema[column].dataType
    return F.rint(x).cast(kind) if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else x.cast(kind)


Stats = dict[str, dict[str, float | None]]


def column_stats(df: DataFrame, columns: list[str]) -> Stats:
    """What the numeric operators need to know of columns: mean, deviation and extremes, one row on the driver."""
    made = [f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("mean", lambda x: F.avg(x.cast("double"))), ("sd", lambda x: F.stddev_pop(x.cast("double"))), ("low", F.min), ("high", F.max))]
    row = df.agg(*made).first()
    return {c: {k: row[f"{k}{i}"] for k in ("mean", "sd", "low", "high")} for i, c in enumerate(columns)}


def _with(df: DataFrame, wanted: dict[str, tuple[str, str]], stats: Stats | None) -> DataFrame:
    """``df`` with columns of a name each: (statistic, column), from ``stats`` or of the table itself."""
    if stats is not None:
        return df.select("*", *[F.lit(stats[c][k]).cast(df.schema[c].dataType if k in ("low", "high") else "double").alias(name) for name, (k, c) in wanted.items()])
    own = {"mean": lambda c: F.avg(F.col(c).cast("double")), "sd": lambda c: F.stddev_pop(F.col(c).cast("double")), "low": F.min, "high": F.max}
    return df.crossJoin(F.broadcast(df.agg(*[own[k](c).alias(name) for name, (k, c) in wanted.items()])))


def _positive(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(1.0)


def noise(df: DataFrame, columns: list[str], key: list[str], seed: int, intensity: float, kind: str = "gaussian", stats: Stats | None = None) -> DataFrame:
    """Adds normal noise of ``intensity`` deviations, or uniform noise of as large a share of the span; null stays null."""
    wanted = {f"_{k}{i}": (k, c) for i, c in enumerate(columns) for k in (("sd",) if kind == "gaussian" else ("low", "high"))}
    out = _with(df, wanted, stats)
    for i, c in enumerate(columns):
        size = F.col(f"_sd{i}") if kind == "gaussian" else (F.col(f"_high{i}") - F.col(f"_low{i}")).cast("double")
        draw = gauss(u01(seed, f"noise:{c}:a", *key), u01(seed, f"noise:{c}:b", *key)) if kind == "gaussian" else 2 * u01(seed, f"noise:{c}", *key) - 1
        out = out.withColumn(c, _whole(df, c, F.col(c) + draw * intensity * _positive(size)))
    return out.select(*df.columns)


def categorical_swap(df: DataFrame, column: str, key: list[str], seed: int, intensity: float) -> DataFrame:
    """A share of values becomes another observed value; nothing changes with fewer than two.

    Only the rows that change meet the ranks of the values, and the values of the drawn ranks."""
    ranks = checked(ranked_values(df, column))
    hit = (u01(seed, f"swap:{column}", *key) < intensity) & F.col(column).isNotNull()
    at = df.withColumn("_at", F.when(hit, F.col(column))).join(ranks.select(F.col("value").alias("_at"), F.col("rank").alias("_own"), "kinds"), "_at", "left")
    k = F.floor(u01(seed, f"swap:{column}:to", *key) * (F.col("kinds") - 1)).cast("long")
    drawn = at.withColumn("_to", F.when(F.col("kinds") > 1, F.when(k >= F.col("_own"), k + 1).otherwise(k)))
    new = ranks.select(F.col("rank").alias("_to"), F.col("value").alias("_new"))
    return drawn.join(new, "_to", "left").withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def text_noise(df: DataFrame, column: str, key: list[str], seed: int, intensity: float, kind: str = "char") -> DataFrame:
    """Typos by character, typos in a share of words, or masked words; null becomes empty."""
    k = F.concat_ws(":", *[F.col(c).cast("string") for c in key])
    draw = lambda part: lambda i: u01(seed, f"text:{part}", k, i)
    x = F.col(column)
    if kind == "mask":
        out = S.mask_words(x, intensity, draw("mask"))
    elif kind == "char":
        out = S.char_typos(x, intensity, draw("hit"), draw("kind"), draw("letter"))
    else:
        def word(w: Column, i: Column) -> Column:
            part = lambda p: lambda j: u01(seed, f"text:{p}", k, i, j)
            return F.when(u01(seed, "text:word", k, i) < intensity, S.char_typos(w, 0.5, part("hit"), part("kind"), part("letter"))).otherwise(w)

        out = F.array_join(F.transform(F.split(S.text_value(x), " "), word), " ")
    return df.withColumn(column, out)


def drift_covariate(df: DataFrame, columns: list[str], intensity: float, scale: float = 1.0, shift: float | None = None, stats: Stats | None = None) -> DataFrame:
    """Scales values and adds a shift, by default ``intensity`` deviations."""
    out = _with(df, {f"_s{i}": ("sd", c) for i, c in enumerate(columns)}, stats) if shift is None else df
    for i, c in enumerate(columns):
        out = out.withColumn(c, _whole(df, c, F.col(c) * scale + (F.lit(float(shift)) if shift is not None else intensity * F.coalesce(F.col(f"_s{i}"), F.lit(1.0)))))
    return out.select(*df.columns)


def drift_temporal(df: DataFrame, column: str, order: list[str], intensity: float, slope: float = 1.0) -> DataFrame:
    """A trend along the given order, from nothing up to ``intensity * slope`` deviations."""
    sd = df.agg(F.coalesce(F.stddev_pop(F.col(column).cast("double")), F.lit(1.0)).alias("_s"))
    rows = ordinals(df, order).crossJoin(F.broadcast(sd))
    trend = intensity * slope * F.col("_s") * F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1))
    return rows.withColumn(column, _whole(df, column, F.col(column) + trend)).select(*df.columns)


def relabel(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Values by a map; others stay."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(column, F.coalesce(table[F.col(column)], F.col(column)))


def rotate(df: DataFrame, column: str) -> DataFrame:
    """Each category becomes the next in order, the last the first."""
    ranks = ranked_values(df, column)
    after = ranks.select(F.col("rank").alias("next"), F.col("value").alias("_new"))
    step = checked(ranks.withColumn("next", (F.col("rank") + 1) % F.col("kinds")).join(after, "next").select(F.col("value").alias(column), "_new"))
    return df.join(step, column, "left").withColumn(column, F.col("_new")).select(*df.columns)


def text_progressive(df: DataFrame, column: str, order: list[str], seed: int, intensity: float) -> DataFrame:
    """Typos whose rate grows along the given order."""
    k = F.concat_ws(":", *[F.col(c).cast("string") for c in order])
    rate = intensity * F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1))
    draw = lambda part: lambda i: u01(seed, f"progress:{part}", k, i)
    return ordinals(df, order).withColumn(column, S.char_typos(F.col(column), rate, draw("hit"), draw("kind"), draw("letter"))).select(*df.columns)


def outlier_point(df: DataFrame, column: str, key: list[str], seed: int, intensity: float, magnitude: float = 5.0, stats: Stats | None = None) -> DataFrame:
    """A share of values becomes the mean plus or minus ``magnitude`` deviations."""
    out = _with(df, {"_m": ("mean", column), "_s": ("sd", column)}, stats)
    far = F.col("_m") + F.when(u01(seed, f"outlier:{column}:sign", *key) < 0.5, -1.0).otherwise(1.0) * magnitude * _positive(F.col("_s"))
    return out.withColumn(column, F.when(u01(seed, f"outlier:{column}", *key) < intensity, _whole(df, column, far)).otherwise(F.col(column))).select(*df.columns)


def outlier_value(df: DataFrame, column: str, key: list[str], seed: int, intensity: float, rare: str = "__ANOMALY__", times: float = 1) -> DataFrame:
    """A share of strings becomes a rare value, repeated for texts."""
    return df.withColumn(column, F.when(u01(seed, f"rare:{column}", *key) < intensity, F.lit(rare * max(1, int(times)))).otherwise(F.col(column)))


def bias_resample(df: DataFrame, column: str, key: list[str], seed: int, ratio: float = 0.8, target: str | None = None) -> DataFrame:
    """As many rows, drawn with replacement so that ``ratio`` of them have the target value, by default the most frequent.

    Draws and rows meet by (side, place): rows are numbered by key within their side, and draw ``i`` picks a place by hash."""
    target = target if target is not None else df.groupBy(F.col(column).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").first()["v"]
    mark = F.coalesce((F.col(column).cast("string") == target), F.lit(False))
    sizes = df.agg(F.count("*").alias("n"), F.count_if(mark).alias("pos"), F.count_distinct(column).alias("kinds")).first()
    n, pos = sizes["n"], sizes["pos"]
    if sizes["kinds"] < 2 or pos in (0, n):
        return df
    wanted = round(ratio * n)
    sides = [ordinals(df.where(mark), key).withColumn("_side", F.lit(1)), ordinals(df.where(~mark), key).withColumn("_side", F.lit(0))]
    rows = sides[0].unionByName(sides[1]).withColumnRenamed("_i", "_place")
    draws = df.sparkSession.range(n).select((F.col("id") < wanted).cast("int").alias("_side"), F.floor(u01(seed, "bias", "id") * F.when(F.col("id") < wanted, float(pos)).otherwise(float(n - pos))).cast("long").alias("_place"))
    return draws.join(rows, ["_side", "_place"]).select(*df.columns)


def edge_nulls(df: DataFrame, column: str, key: list[str], seed: int, intensity: float) -> DataFrame:
    return df.withColumn(column, F.when(u01(seed, f"edge:{column}", *key) >= intensity, F.col(column)))


def edge_boundary(df: DataFrame, column: str, key: list[str], seed: int, intensity: float, stats: Stats | None = None) -> DataFrame:
    """A share of numbers becomes the least or the greatest; of strings, empty."""
    hit = u01(seed, f"edge:{column}", *key) < intensity
    if column not in plain_numeric(df):
        return df.withColumn(column, F.when(hit, F.lit("")).otherwise(F.col(column)))
    out = _with(df, {"_lo": ("low", column), "_hi": ("high", column)}, stats)
    return out.withColumn(column, F.when(hit, F.when(u01(seed, f"edge:{column}:side", *key) < 0.5, F.col("_lo")).otherwise(F.col("_hi"))).otherwise(F.col(column))).select(*df.columns)


def edge_format(df: DataFrame, column: str, key: list[str], seed: int, intensity: float) -> DataFrame:
    """A share of numbers becomes 0; of strings, three blanks."""
    odd = F.lit(0).cast(df.schema[column].dataType) if column in plain_numeric(df) else F.lit("   ")
    return df.withColumn(column, F.when(u01(seed, f"edge:{column}", *key) < intensity, odd).otherwise(F.col(column)))


def edge_text(df: DataFrame, column: str, key: list[str], seed: int, intensity: float) -> DataFrame:
    """A share of texts becomes empty or three blanks, by halves."""
    odd = F.when(u01(seed, f"edge:{column}:kind", *key) < 0.5, "").otherwise("   ")
    return df.withColumn(column, F.when(u01(seed, f"edge:{column}", *key) < intensity, odd).otherwise(F.col(column)))


#: Families and kinds that use statistics of the whole column.
NEED_STATS = {("noise", None), ("noise", "gaussian"), ("noise", "uniform"), ("drift", None), ("drift", "covariate"), ("outlier", None), ("edge", "boundary")}
#: Those that need all rows at once: ranks of values, places in an order, draws among all rows.
NEED_TABLE = {("noise", "swap"), ("drift", "temporal"), ("drift", "concept"), ("drift", "progressive"), ("bias", None)}


def perturb(df: DataFrame, family: str, column: str, key: list[str], seed: int, intensity: float, kind: str | None = None, stats: Stats | None = None, **params) -> DataFrame:
    """One perturbation by family and kind on a column; image, audio and video have none. ``stats`` take the place of the table's own."""
    number = column in plain_numeric(df)
    table = {
        ("noise", None): lambda: noise(df, [column], key, seed, intensity, stats=stats) if number else categorical_swap(df, column, key, seed, intensity),
        ("noise", "gaussian"): lambda: noise(df, [column], key, seed, intensity, stats=stats), ("noise", "uniform"): lambda: noise(df, [column], key, seed, intensity, "uniform", stats),
        ("noise", "swap"): lambda: categorical_swap(df, column, key, seed, intensity),
        **{("noise", k): (lambda k=k: text_noise(df, column, key, seed, intensity, k)) for k in ("char", "word", "mask")},
        ("drift", None): lambda: drift_covariate(df, [column], intensity, stats=stats, **params), ("drift", "covariate"): lambda: drift_covariate(df, [column], intensity, stats=stats, **params),
        ("drift", "temporal"): lambda: drift_temporal(df, column, key, intensity, **params), ("drift", "concept"): lambda: relabel(df, column, params["mapping"]) if params.get("mapping") else rotate(df, column),
        ("drift", "progressive"): lambda: text_progressive(df, column, key, seed, intensity),
        ("outlier", None): lambda: outlier_point(df, column, key, seed, intensity, stats=stats, **params) if number else outlier_value(df, column, key, seed, intensity, **params),
        ("bias", None): lambda: bias_resample(df, column, key, seed, **params),
        ("edge", None): lambda: edge_nulls(df, column, key, seed, intensity), ("edge", "nulls"): lambda: edge_nulls(df, column, key, seed, intensity),
        ("edge", "boundary"): lambda: edge_boundary(df, column, key, seed, intensity, stats), ("edge", "format"): lambda: edge_format(df, column, key, seed, intensity), ("edge", "text"): lambda: edge_text(df, column, key, seed, intensity),
    }
    if (family, kind) not in table:
        raise NotImplementedError(f"no perturbation {family}/{kind}")
    return table[family, kind]()
