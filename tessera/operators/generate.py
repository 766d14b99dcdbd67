"""Row generators: declarative field specs become expressions over row numbers, keyed by (seed, field, row number).

A table is one projection of a range, so any partitioning gives the same rows and shards of it are ranges of row numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.rng import integer, pick, u01

TYPES = ("integer", "float", "boolean", "categorical", "datetime", "name", "email", "address", "text")
#: Rows of a shard by modality.
SHARD_ROWS = {"tabular": 50_000, "image": 50_000, "audio": 50_000, "text": 200, "video": 4, "graph": 1_000_000}
#: Shares of rows of named use cases.
USE_CASE_RATES = {"rare_event": 0.02, "balanced": 0.5, "high_risk_segment": 0.3}
FIRST = ("Ada", "Alan", "Barbara", "Carl", "Donald", "Edith", "Frances", "Grace", "Hedy", "Ivan", "Joan", "Katherine", "Leslie", "Margaret", "Niklaus", "Olga")
LAST = ("Abel", "Bauer", "Costa", "Duran", "Ericson", "Fischer", "Garcia", "Hopper", "Ito", "Jansen", "Kovacs", "Laurent", "Moreau", "Novak", "Okafor", "Petrov")
STREETS = ("Main Street", "Oak Avenue", "Station Road", "Park Lane", "Mill Road", "High Street", "Lake Drive", "Hill Street")
NOUNS = ("order", "report", "sensor", "market", "system", "signal", "garden", "letter", "engine", "window")
EPOCH_FROM, EPOCH_TILL = 1577836800, 1735689600


class DirectiveError(ValueError):
    """A directive that doesn't fit the spec."""


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str
    nullable: bool = False
    constraints: dict[str, Any] = field(default_factory=dict)

    def data_type(self) -> T.DataType:
        return {"integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType()}.get(self.type, T.StringType())


def schema_of(fields: list[FieldSpec]) -> T.StructType:
    """Struct type with the constraints in each field's metadata."""
    return T.StructType([T.StructField(f.name, f.data_type(), f.nullable, {"semantic": f.type, **{k: v for k, v in f.constraints.items() if v is not None}}) for f in fields])


def bounded(x: Column, low=None, high=None) -> Column:
    """Clipped to the declared bounds; null stays null."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def chosen(x: Column, choices: list, fallback=None) -> Column:
    """Values outside the vocabulary, null among them, become the fallback, by default the first choice."""
    return F.when(x.isin(*choices), x).otherwise(F.lit(choices[0] if fallback is None else fallback))


def _words(u, values: tuple[str, ...]) -> Column:
    return pick(u, F.array(*map(F.lit, values)))


def generated(spec: FieldSpec, seed: int, row: Column) -> Column:
    c, u = spec.constraints, lambda part="": u01(seed, spec.name + part, row)
    if spec.type == "integer":
        return integer(u(), int(c.get("min", 0)), int(c.get("max", 100)))
    if spec.type == "float":
        low, high = float(c.get("min", 0.0)), float(c.get("max", 1.0))
        return u() * F.lit(high - low) + F.lit(low)
    if spec.type == "boolean":
        return u() < 0.5
    if spec.type == "categorical":
        return pick(u(), F.array(*[F.lit(str(x)) for x in c.get("choices", ["a", "b", "c"])]))
    if spec.type == "datetime":
        return F.date_format(F.timestamp_seconds(F.floor(u() * (EPOCH_TILL - EPOCH_FROM)) + EPOCH_FROM), "yyyy-MM-dd'T'HH:mm:ss")
    first, last = _words(u(":first"), FIRST), _words(u(":last"), LAST)
    if spec.type == "name":
        return F.concat_ws(" ", first, last)
    if spec.type == "email":
        return F.concat(F.lower(first), F.lit("."), F.lower(last), integer(u(":n"), 1, 999).cast("string"), F.lit("@example.com"))
    if spec.type == "address":
        return F.concat(integer(u(":n"), 1, 200).cast("string"), F.lit(" "), _words(u(":street"), STREETS))
    return F.concat_ws(" ", *[_words(u(f":{i}"), NOUNS) for i in range(6)])


def table(spark: SparkSession, fields: list[FieldSpec], start: int, count: int, seed: int) -> DataFrame:
    rows = spark.range(start, start + count)
    return rows.select(*[generated(f, seed, F.col("id")).alias(f.name) for f in fields])


def directives(spark: SparkSession, fields: list[FieldSpec], rules: list[dict], start: int, count: int, seed: int) -> DataFrame:
    """A generated table whose fields are overwritten by rules in turn: each has field, value (or ``min``, ``max``, ``null``) and rate or a named use case."""
    known, columns, row = {f.name: f for f in fields}, {f.name: generated(f, seed, F.col("id")) for f in fields}, F.col("id")
    for i, rule in enumerate(rules):
        name = rule.get("field")
        if not name:
            raise DirectiveError(f"rule {i} has no field")
        if name not in known:
            raise DirectiveError(f"rule {i} has the unknown field {name!r}")
        rate = rule.get("rate", USE_CASE_RATES.get(rule.get("name")))
        if rate is None:
            raise DirectiveError(f"rule {i} has no rate")
        spec, value = known[name], rule.get("value")
        if value == "null":
            if not spec.nullable:
                raise DirectiveError(f"{name!r} can't be null")
            value = None
        elif value in ("min", "max"):
            value = spec.constraints.get(value)
        columns[name] = F.when(u01(seed, f"rule{i}:{name}", row) < rate, F.lit(value).cast(spec.data_type())).otherwise(columns[name])
    return spark.range(start, start + count).select(*[c.alias(n) for n, c in columns.items()])


def shard_plan(rows: int, modality: str = "tabular") -> list[tuple[int, int]]:
    size = SHARD_ROWS[modality]
    return [(at, min(size, rows - at)) for at in range(0, rows, size)] or [(0, 0)]


class Copula:
    """Gaussian copula: marginals by quantiles or frequencies, dependence by the correlation of normal scores.

    Fitting takes one aggregation for the marginals and one for the scores' correlations; only those come to the driver.
    """

    GRID = 200

    def __init__(self, df: DataFrame, fields: list[FieldSpec]):
        self.fields = [f for f in fields if f.type in ("integer", "float", "boolean", "categorical")]
        self.marks, self.values = {}, {}
        grid = [i / self.GRID for i in range(self.GRID + 1)]
        for f in self.fields:
            if f.type in ("integer", "float"):
                self.marks[f.name] = [float(x) for x in df.agg(F.percentile(F.col(f.name).cast("double"), grid)).first()[0] or [0.0, 0.0]]
            else:
                rows = df.where(F.col(f.name).isNotNull()).groupBy(F.col(f.name).alias("v")).count().orderBy(F.desc("count"), "v").limit(1000).collect()
                total = sum(r["count"] for r in rows) or 1
                self.values[f.name] = ([r["v"] for r in rows], list(np.cumsum([r["count"] / total for r in rows])))
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.stat import Correlation

        scored = df.select(*[self._score(f).alias(f"s{i}") for i, f in enumerate(self.fields)])
        if len(self.fields) > 1:
            made = VectorAssembler(inputCols=scored.columns, outputCol="v").transform(scored)
            corr = np.nan_to_num(Correlation.corr(made, "v").first()[0].toArray())
        else:
            corr = np.eye(len(self.fields))
        np.fill_diagonal(corr, 1.0)
        low, vectors = np.linalg.eigh(corr)
        fixed = vectors @ np.diag(np.maximum(low, 1e-6)) @ vectors.T
        self.root = np.linalg.cholesky(fixed / np.sqrt(np.outer(np.diag(fixed), np.diag(fixed))))

    def _score(self, f: FieldSpec) -> Column:
        """Normal score of a value: its place among the marginal's marks, put through a logistic inverse normal."""
        x = F.col(f.name)
        if f.name in self.marks:
            marks = F.array(*map(F.lit, self.marks[f.name]))
            at = F.size(F.filter(marks, lambda m: m <= x.cast("double"))) - F.size(F.filter(marks, lambda m: m == x.cast("double"))) / 2
            p = F.coalesce(at / (self.GRID + 1), F.lit(0.5))
        else:
            values, cum = self.values[f.name]
            mid = [(a + b) / 2 for a, b in zip([0.0, *cum], cum)]
            p = F.coalesce(F.create_map(*[F.lit(v) for kv in zip(values, mid) for v in kv])[x], F.lit(0.5)) if values else F.lit(0.5)
        p = F.least(F.lit(0.999), F.greatest(F.lit(0.001), p))
        return (F.pow(p, F.lit(0.135)) - F.pow(1 - p, F.lit(0.135))) / 0.1975

    def sample(self, spark: SparkSession, start: int, count: int, seed: int) -> DataFrame:
        """Rows ``start`` to ``start + count``: correlated normal draws, back through the marginals."""
        from tessera.functions.rng import gauss

        row = F.col("id")
        z = [gauss(u01(seed, f"z{i}", row), u01(seed, f"w{i}", row)) for i in range(len(self.fields))]
        out = []
        for i, f in enumerate(self.fields):
            y = sum((F.lit(float(self.root[i, j])) * z[j] for j in range(i + 1)), F.lit(0.0))
            p = 1 / (1 + F.exp(-(1.5976 * y + 0.07056 * y * y * y)))
            if f.name in self.marks:
                marks, at = F.array(*map(F.lit, self.marks[f.name])), F.least(F.lit(self.GRID - 1e-9), p * self.GRID)
                low = F.floor(at).cast("int")
                x = F.get(marks, low) + (at - low) * (F.get(marks, low + 1) - F.get(marks, low))
                out.append((F.rint(x).cast("long") if f.type == "integer" else x).alias(f.name))
            else:
                values, cum = self.values[f.name]
                places = F.array(*map(F.lit, cum)) if cum else F.array(F.lit(1.0))
                out.append(F.get(F.array(*map(F.lit, values or [None])), F.least(F.size(F.filter(places, lambda c: c < p)), F.lit(max(0, len(values) - 1)))).alias(f.name))
        return spark.range(start, start + count).select(*out)


def synthesizer(method: str):
    """The generator class of a method's name."""
    if method == "copula":
        return Copula
    if method in ("ctgan", "tvae", "sdv"):
        raise NotImplementedError(f"{method} needs a deep-learning library, which this engine does not use")
    raise ValueError(f"unknown method {method!r}")


def image_prompts(spark: SparkSession, count: int, description: str, labels: list[str], extras: list[str] = ()) -> DataFrame:
    """index, label (in turn) and prompt: description, label and whatever extras are given, comma-joined."""
    label = F.get(F.array(*map(F.lit, labels)), F.pmod("id", F.lit(len(labels))).cast("int")) if labels else F.lit(None).cast("string")
    return spark.range(count).select(F.col("id").alias("index"), label.alias("label"), F.concat_ws(", ", F.lit(description), label, *map(F.lit, extras)).alias("prompt"))


def audio_plan(spark: SparkSession, count: int, prompts: list[str], labels: list[str], seed: int) -> DataFrame:
    """index, the prompt given for it or else a seeded sentence, and its label if there is one."""
    own = F.get(F.array(*map(F.lit, prompts)).cast("array<string>"), F.col("id").cast("int"))
    said = F.concat_ws(" ", *[_words(u01(seed, f"audio:{i}", "id"), NOUNS) for i in range(5)])
    return spark.range(count).select(F.col("id").alias("index"), F.coalesce(own, said).alias("prompt"), F.get(F.array(*map(F.lit, labels)).cast("array<string>"), F.col("id").cast("int")).alias("label"))


def video_plan(spark: SparkSession, count: int, description: str, rules: dict[str, str], seed: int) -> DataFrame:
    """index, prompt with its number and the rules by name, and a seed of its own."""
    tail = "".join(f"; {k}={rules[k]}" for k in sorted(rules))
    return spark.range(count).select(F.col("id").alias("index"), F.concat(F.lit(f"{description} (clip "), F.col("id").cast("string"), F.lit(f"){tail}")).alias("prompt"), (F.lit(seed) * F.lit(1_000_003) + F.col("id")).cast("long").alias("item_seed"))


def text_rows(spark: SparkSession, count: int, provider, fields: list[str], batch: int = 20, attempts: int = 5) -> DataFrame:
    """Rows of text that ``provider(first, size, attempt)`` makes as dicts, in batches; rows that lack a field or hold an
    empty or over-long one are asked for again, a few times, and what still fails is left out."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for first, size in zip(b["start"], b["size"]):
                good: list[dict] = []
                for attempt in range(attempts):
                    rows = provider(int(first), int(size), attempt)
                    good += [r for r in rows if all(1 <= len(str(r.get(f) or "").strip()) <= 20_000 for f in fields)]
                    if len(good) >= size:
                        break
                out += [{"id": int(first) + i, **{f: str(r[f]) for f in fields}} for i, r in enumerate(good[: int(size)])]
            yield pd.DataFrame(out, columns=["id", *fields])

    plan = spark.range(0, count, batch).select(F.col("id").alias("start"), F.least(F.lit(batch), F.lit(count) - F.col("id")).alias("size"))
    return plan.mapInPandas(run, "id long, " + ", ".join(f"{f} string" for f in fields)).dropDuplicates(fields)
