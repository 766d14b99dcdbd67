"""Task metrics of a subject table as aggregate columns; each is defined for empty input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import INTERROGATIVES, bigram_overlap, clamp01, nonempty, question_type, strip_json_fence, text_value
from tessera.operators.judges import entropy


def share(condition: Column, empty: float = 0.0) -> Column:
    """Share of rows for which the condition holds, null counting as not."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(empty))


def balance(df: DataFrame, label: str) -> DataFrame:
    """One row: entropy of the label's values over its most for so many; 0 for one value or none."""
    n = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("x")).agg(F.count("*").alias("n"))
    return n.agg(entropy(F.col("n")).alias("balance"))


def duplicate_rate(column: str) -> Column:
    n = F.count(F.lit(1))
    return F.when(n > 0, 1 - F.count_distinct(text_value(F.col(column))) / n).otherwise(0.0)


def macro_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """accuracy and macro_f1: F1 of each true class, averaged without weights."""
    pairs = df.select(F.col(truth).cast("string").alias("t"), F.col(guess).cast("string").alias("g"))
    cells = pairs.groupBy("t", "g").agg(F.count("*").alias("n"))
    by_truth = cells.groupBy("t").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)).alias("hit"))
    by_guess = cells.groupBy(F.col("g").alias("t")).agg(F.sum("n").alias("said"))
    each = by_truth.join(by_guess, "t", "left").na.fill(0, ["said"])
    f1 = F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("support") + F.col("said"))).otherwise(0.0)
    return each.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def feature_completeness(df: DataFrame, target: str) -> DataFrame:
    names = [c for c in df.columns if c != target]
    if not names:
        return df.agg(F.lit(1.0).alias("completeness"))
    nulls = sum((F.avg(F.col(c).isNull().cast("double")) for c in names), F.lit(0.0))
    return df.agg(F.coalesce(1 - nulls / len(names), F.lit(1.0)).alias("completeness"))


def range_validity(column: Column) -> Column:
    """Share of values that are finite numbers."""
    x = column.try_cast("double")
    return share(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def distribution_health(column: Column) -> Column:
    """1 less a tenth of the sample skewness, at least 0; a constant column has no skew."""
    x = column.cast("double")
    n = F.count(x).cast("double")
    g = F.when((n >= 3) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2).otherwise(1.0)).otherwise(0.0)
    return 1 - F.least(F.lit(1.0), F.abs(g) / 10)


def question_diversity(question: Column) -> Column:
    """Kinds of questions, of the interrogatives and one for all others, over the number of interrogatives; at most 1."""
    return F.least(F.lit(1.0), F.count_distinct(question_type(question)) / len(INTERROGATIVES))


def compression(document: Column, summary: Column) -> Column:
    """Mean share of its length that a document keeps in its summary, at most 1; empty documents are left out."""
    d, s = F.length(text_value(document)), F.length(text_value(summary))
    return F.coalesce(F.avg(F.when(d > 0, F.least(F.lit(1.0), F.try_divide(s, d)))), F.lit(0.0))


def abstractiveness(document: Column, summary: Column) -> Column:
    return 1 - F.coalesce(F.avg(bigram_overlap(summary, document)), F.lit(0.0))


def turn_validity(instruction: Column, response: Column) -> Column:
    return share(nonempty(instruction) & nonempty(response))


def prompt_diversity(prompt: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_distinct(prompt), F.count(F.lit(1))), F.lit(0.0))


def duration_uniformity(df: DataFrame, column: str, slack: float = 0.1) -> DataFrame:
    """share of rows within a tenth of the median; null counts as outside."""
    mid = df.agg(F.median(F.col(column).cast("double")).alias("mid"))
    return df.crossJoin(F.broadcast(mid)).agg(share(F.abs(F.col(column) - F.col("mid")) <= slack * F.abs(F.col("mid"))).alias("uniformity"))


def modal_share(df: DataFrame, *columns: str) -> DataFrame:
    """value(s) and share of the most frequent combination; ties go to the smallest."""
    n = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), *columns).limit(1).crossJoin(n.agg(F.sum("n").alias("total"))).select(*columns, (F.col("n") / F.col("total")).alias("share"))


def verdict_rates(df: DataFrame, verdict: str) -> DataFrame:
    """yes_rate and mean_rating of verdicts given as JSON, fenced or not: booleans, and ratings of 1 to 5 as shares; malformed ones drop out."""
    j = F.from_json(strip_json_fence(F.col(verdict)), "ok boolean, rating double")
    rows = df.select(j.alias("j")).where(F.col("j.ok").isNotNull() | F.col("j.rating").isNotNull())
    return rows.agg(F.count("*").alias("n_valid"), F.coalesce(F.avg(F.col("j.ok").cast("double")), F.lit(0.0)).alias("yes_rate"), clamp01(F.avg(F.col("j.rating") / 5)).alias("mean_rating"))


def mean_contribution(metrics: Column, names: list[str]) -> Column:
    """Mean of the named entries of a metric map; 0 without any."""
    found = F.filter(F.array(*[metrics[n] for n in names]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found)).otherwise(0.0)
