"""Judges of a subject table, mostly against a reference: fidelity, diversity, privacy, fairness, utility, and their mixture."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import clamp01
from tessera.functions.shared import cut
from tessera.operators.order import running
from tessera.operators.profile import categorical_columns, correlations, numeric_columns, shared_columns

#: Weights of the dimensions in the overall score, the media ones last and so in force where names meet.
TABLE_WEIGHTS = {"fidelity": 0.22, "privacy": 0.17, "utility": 0.17, "diversity": 0.12, "qualitative": 0.08, "bias": 0.09, "task_quality": 0.15}
GRAPH_WEIGHTS = {"graph_structure": 0.22, "graph_ontology": 0.18, "graph_privacy": 0.13, "graph_connectivity": 0.13, "graph_utility": 0.13, "graph_semantic": 0.08, "task_quality": 0.13}
MEDIA_WEIGHTS = {"task_quality": 0.7, "qualitative": 0.3}
WEIGHTS = TABLE_WEIGHTS | GRAPH_WEIGHTS | MEDIA_WEIGHTS


def _long(df: DataFrame, names: list[str], kind: str) -> DataFrame:
    """(column, x) of several columns as one long table."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("x")) for c in names])).alias("r")).select("r.*")


def ks(subject: DataFrame, reference: DataFrame, names: list[str]) -> DataFrame:
    """(column, ks): largest distance of the two empirical distributions, all columns at once.

    Rows are counted by value before any order is needed; running sums over the values are made by range partitions."""
    side = lambda df, s, r: _long(df, names, "double").where("x is not null and not isnan(x)").select("column", "x", F.lit(s).alias("s"), F.lit(r).alias("r"))
    counts = cut(side(subject, 1, 0).union(side(reference, 0, 1)).groupBy("column", "x").agg(F.sum("s").alias("s"), F.sum("r").alias("r")))
    cum = running(counts, ["column"], ["x"], ["s", "r"])
    return cum.where("all_s > 0 and all_r > 0").groupBy("column").agg(F.max(F.abs(F.col("cum_s") / F.col("all_s") - F.col("cum_r") / F.col("all_r"))).alias("ks"))


def js(subject: DataFrame, reference: DataFrame, names: list[str]) -> DataFrame:
    """(column, js): Jensen-Shannon distance to base 2 of the category shares; categories of one side count 0 on the other."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        n = _long(df, names, "string").where("x is not null").groupBy("column", "x").agg(F.count("*").alias("n"))
        total = F.broadcast(n.groupBy("column").agg(F.sum("n").alias("total")))  # a row for each column
        return n.join(total, "column").select("column", "x", (F.col("n") / F.col("total")).alias(name))

    both = shares(subject, "p").join(shares(reference, "q"), ["column", "x"], "full_outer").na.fill(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    part = lambda v: F.when(F.col(v) > 0, F.col(v) * F.log2(F.col(v) / m)).otherwise(0.0)
    return both.groupBy("column").agg((F.sum(part("p")) / 2 + F.sum(part("q")) / 2).alias("d")).select("column", F.sqrt(F.greatest(F.lit(0.0), F.col("d"))).alias("js"))


def correlation_delta(subject: DataFrame, reference: DataFrame, names: list[str]) -> DataFrame:
    """One row: half the mean absolute difference of the correlation matrices, undefined cells left out; 0 for one column."""
    if len(names) < 2:
        return subject.sparkSession.range(1).select(F.lit(0.0).alias("corr_delta"))
    both = correlations(subject, names).withColumnRenamed("r", "x").join(correlations(reference, names).withColumnRenamed("r", "y"), ["a", "b"])
    return both.agg(clamp01(F.avg(F.abs(F.col("x") - F.col("y"))) / 2).alias("corr_delta"))


def fidelity(subject: DataFrame, reference: DataFrame) -> DataFrame:
    """score, ks_mean, js_mean, corr_delta; a component without columns counts 0."""
    shared = shared_columns(subject, reference)
    numeric = [c for c in numeric_columns(subject) if c in shared and c in numeric_columns(reference)]
    known = categorical_columns(reference.select(*shared))
    cats = [c for c in categorical_columns(subject.select(*shared)) if c in known]
    one = subject.sparkSession.range(1).select(F.lit(0.0).alias("z"))
    a = ks(subject, reference, numeric).agg(F.avg("ks").alias("ks_mean")) if numeric else one.withColumnRenamed("z", "ks_mean")
    b = js(subject, reference, cats).agg(F.avg("js").alias("js_mean")) if cats else one.withColumnRenamed("z", "js_mean")
    c = correlation_delta(subject, reference, numeric)
    out = a.crossJoin(b).crossJoin(c).na.fill(0.0)
    return out.withColumn("score", clamp01(1 - (F.col("ks_mean") + F.col("js_mean") + F.col("corr_delta")) / 3))


def entropy(n: Column) -> Column:
    """Entropy of groups of these sizes over its most for so many, 0 for one; one aggregate, without shares."""
    k, total = F.count(n), F.sum(n).cast("double")
    h = F.log(total) - F.try_divide(F.sum(n * F.log(n.cast("double"))), total)
    return F.when(k > 1, F.greatest(F.lit(0.0), h) / F.log(F.greatest(k, F.lit(2)).cast("double"))).otherwise(0.0)


def entropy_of(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, entropy, top_share): entropy of the values over its most for so many values, 0 for one; share of the top value."""
    n = _long(df, names, "string").where("x is not null").groupBy("column", "x").agg(F.count("*").alias("n"))
    return n.groupBy("column").agg(entropy(F.col("n")).alias("entropy"), (F.max("n") / F.sum("n")).alias("top_share"))


def uniqueness(df: DataFrame) -> Column:
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return reduce(lambda a, b: a + b, [F.count_distinct(c) / n for c in df.columns]) / len(df.columns)


def diversity(df: DataFrame) -> DataFrame:
    """score, uniqueness, entropy, max_mode: variety of values, lowered where one value takes over 60 percent of a column."""
    cats = categorical_columns(df)
    u = df.agg(uniqueness(df).alias("uniqueness"))
    e = entropy_of(df, cats or numeric_columns(df)).agg(F.avg("entropy").alias("entropy"), F.max("top_share").alias("max_mode")) if cats or numeric_columns(df) else df.agg(F.lit(None).cast("double").alias("entropy"), F.lit(0.0).alias("max_mode"))
    out = u.crossJoin(e)
    entropy = F.coalesce("entropy", "uniqueness") if cats else F.col("uniqueness")
    out = out.select("uniqueness", entropy.alias("entropy"), F.coalesce("max_mode", F.lit(0.0)).alias("max_mode"))
    return out.withColumn("score", clamp01((F.col("uniqueness") + F.col("entropy")) / 2 * (1 - F.greatest(F.lit(0.0), F.col("max_mode") - 0.6) / 0.4)))


def exact_duplicates(subject: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: n, n_copies, rate of subject rows that the reference has in all shared columns, null equal to null."""
    shared = shared_columns(subject, reference)
    s, r = subject.select(*[F.col(c).cast("string") for c in shared]), reference.select(*[F.col(c).cast("string").alias(f"_{c}") for c in shared]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in shared])
    return s.agg(F.count("*").alias("n")).crossJoin(s.join(r, same, "left_semi").agg(F.count("*").alias("n_copies"))).withColumn("rate", F.when(F.col("n") > 0, F.col("n_copies") / F.col("n")).otherwise(0.0))


CELL = 512
SAMPLE = 65_536


def _cells(reference: DataFrame, columns: list[Column], n: int) -> list[tuple[int, float, int, int]]:
    """A k-d tree whose leaves hold about ``CELL`` reference rows, at most 8,192 leaves: (dimension, cut, left, right) of each node, or a leaf's number as dimension -1 - number.

    It is split at medians of a sample of at most about ``SAMPLE`` rows; any tree gives exact results."""
    share = min(1.0, SAMPLE / max(1, n))
    some = reference.select(F.array(*columns).alias("v")).where(F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) or 1)).limit(4 * SAMPLE).toArrow().column(0).to_pylist()
    x, least = np.array(some, np.float64).reshape(-1, len(columns)), max(8.0, CELL * share)
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0
    todo = [(x, 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            d, cut_, left, right = nodes[parent]
            nodes[parent] = (d, cut_, left if side else me, me if side else right)
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(len(columns))
        d = int(np.argmax(spread))
        if len(rows) <= 1.5 * least or spread[d] == 0 or depth >= 13:
            nodes.append((-1 - leaves, 0.0, 0, 0))
            leaves += 1
            continue
        at = float(np.median(rows[:, d]))
        if at >= rows[:, d].max():  # more than half are equal to the greatest: the rest goes left
            at = float(rows[rows[:, d] < at, d].max())
        nodes.append((d, at, -1, -1))
        todo += [(rows[rows[:, d] > at], depth + 1, me, 1), (rows[rows[:, d] <= at], depth + 1, me, 0)]
    return nodes


def _leaf_of(nodes: list[tuple[int, float, int, int]], x: np.ndarray) -> np.ndarray:
    out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        d, at, left, right = nodes[node]
        if d < 0:
            out[rows] = -1 - d
            continue
        low = x[rows, d] <= at
        todo += [(n, r) for n, r in ((left, rows[low]), (right, rows[~low])) if len(r)]
    return out


def nearest_distances(subject: DataFrame, reference: DataFrame, names: list[str], key: str, block: int = 4096) -> DataFrame:
    """(key, distance): Euclidean distance of each subject row to its nearest reference row, columns scaled by the reference's mean and deviation.

    Exact: distinct reference rows are dealt to the cells of a k-d tree, whose bounding boxes are one row a cell on the
    driver. A subject row first meets the cell whose box is nearest, and then those whose boxes are nearer than what it
    found there; cells meet in blocks of ``block`` rows."""
    stats = reference.agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)], *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)]).first()
    scaled = [F.coalesce((F.col(c).cast("double") - F.lit(stats[f"m{i}"] or 0.0)) / F.lit(stats[f"s{i}"] or 1.0), F.lit(0.0)) for i, c in enumerate(names)]
    spark, dims = subject.sparkSession, len(names)
    nodes = spark.sparkContext.broadcast(_cells(reference, scaled, stats["n"]))
    kind = subject.schema[key].dataType.simpleString()

    def own_cell(batches):
        for b in batches:
            v = np.array(b.column("v").to_pylist(), np.float64).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([b.column("v"), pa.array(_leaf_of(nodes.value, v), pa.int64())], names=["v", "cell"])

    cells = cut(reference.select(F.array(*scaled).alias("v")).distinct().mapInArrow(own_cell, "v array<double>, cell long"))
    boxes = cells.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("v")[i]).alias(f"{s}{i}") for i in range(dims) for s, f in (("lo", F.min), ("hi", F.max))]).collect()
    if not boxes:
        return subject.select(F.col(key), F.lit(None).cast("double").alias("distance"))
    held = spark.sparkContext.broadcast((np.array([r["cell"] for r in boxes]), np.array([[r[f"lo{i}"] for i in range(dims)] for r in boxes]), np.array([[r[f"hi{i}"] for i in range(dims)] for r in boxes]), np.array([-(-r["n"] // block) for r in boxes])))

    def route(first: bool):
        """Rows for the blocks of the cells that a subject row asks: the nearest box's, then all whose boxes are nearer than the distance so far, but that one's."""
        def run(batches):
            ids, lo, hi, parts = held.value
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    v = np.array(part.column("v").to_pylist(), np.float64).reshape(-1, dims)
                    far = np.zeros((len(v), len(ids)))
                    for d in range(dims):
                        far += np.maximum(0.0, np.maximum(lo[None, :, d] - v[:, None, d], v[:, None, d] - hi[None, :, d])) ** 2
                    best = np.argmin(far, axis=1)
                    if first:
                        row, cell = np.arange(len(v)), best
                    else:
                        limit = np.array(part.column("distance").to_pylist(), np.float64) ** 2
                        row, cell = np.nonzero((far < limit[:, None]) & (np.arange(len(ids))[None, :] != best[:, None]))
                    row, cell = np.repeat(row, parts[cell]), np.repeat(cell, parts[cell])
                    block_ = np.arange(len(cell)) - np.maximum.accumulate(np.where(np.concatenate([[True], (cell[1:] != cell[:-1]) | (row[1:] != row[:-1])])[: len(cell)], np.arange(len(cell)), 0)) if len(cell) else cell
                    took = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([took.column("k"), took.column("v"), pa.array(ids[cell], pa.int64()), pa.array(block_, pa.int32())], names=["k", "v", "cell", "part"])

        return run

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"k": a.column("k").slice(0, 0), "distance": pa.array([], pa.float64())})
        x, y = (np.array(t.column("v").to_pylist(), np.float64).reshape(-1, dims) for t in (a, b))
        low = np.full(len(x), np.inf)
        for at in range(0, len(x), 256):
            for to in range(0, len(y), 512):
                low[at : at + 256] = np.minimum(low[at : at + 256], ((x[at : at + 256, None, :] - y[None, to : to + 512, :]) ** 2).sum(2).min(1))
        return pa.table({"k": a.column("k"), "distance": pa.array(np.sqrt(low))})

    counts = spark.createDataFrame([(r["cell"], -(-r["n"] // block)) for r in boxes], "cell long, parts int")
    right = cells.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64("v"), "parts").cast("int")).select("cell", "part", "v")

    def asked(rows: DataFrame, first: bool) -> DataFrame:
        routed = rows.mapInArrow(route(first), f"k {kind}, v array<double>, cell long, part int")
        salted = routed.withColumn("salt", F.pmod(F.xxhash64("k", "v"), F.lit(salts)).cast("int"))
        spread = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = ("cell", "part", "salt")
        met = salted.groupBy(*on).cogroup(spread.groupBy(*on)).applyInArrow(meet, f"k {kind}, distance double")
        return met.groupBy("k").agg(F.min("distance").alias("distance"))

    rows = subject.select(F.col(key).alias("k"), F.array(*scaled).alias("v"))
    salts = max(1, -(-subject.count() // (len(boxes) * 16 * block)))  # a cell that many subject rows ask is met in several tasks
    near = cut(asked(rows, True))
    more = asked(rows.join(near, "k"), False)
    return near.unionByName(more).groupBy(F.col("k").alias(key)).agg(F.min("distance").alias("distance"))


def privacy(subject: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """score, duplicate_rate, mean_nearest: 1 less the risk of copied rows and of rows near the reference's."""
    s, r = subject.drop(key), reference.drop(key)
    names = [c for c in numeric_columns(s) if c in numeric_columns(r)]
    out = exact_duplicates(s, r).select(F.col("rate").alias("duplicate_rate"))
    if names:
        out = out.crossJoin(nearest_distances(subject, reference, names, key).agg(F.avg("distance").alias("mean_nearest")))
    else:
        out = out.withColumn("mean_nearest", F.lit(None).cast("double"))
    risk = F.greatest("duplicate_rate", 0.5 * F.col("duplicate_rate") + 0.5 * F.coalesce(F.exp(-F.col("mean_nearest")), F.lit(0.0)))
    return out.withColumn("score", clamp01(1 - risk))


def fairness(df: DataFrame, group: str, outcome: str) -> DataFrame:
    """score, representation_entropy, parity_gap, impact_ratio of an outcome by a sensitive column; a null group is one of its own."""
    n = df.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(F.count("*").alias("n"))
    spread = n.agg(entropy(F.col("n")).alias("representation_entropy"))
    if outcome in numeric_columns(df):
        mark = df.agg(F.median(F.col(outcome).cast("double")).alias("mark"))
        good = F.coalesce((F.col(outcome).cast("double") > F.col("mark")).cast("double"), F.lit(0.0))
    else:
        mark = df.agg(F.mode(F.col(outcome), True).alias("mark"))
        good = F.coalesce((F.col(outcome) == F.col("mark")).cast("double"), F.lit(0.0))
    rates = df.crossJoin(F.broadcast(mark)).groupBy(F.coalesce(F.col(group).cast("string"), F.lit("None")).alias("g")).agg(F.avg(good).alias("rate"))
    gaps = rates.agg((F.max("rate") - F.min("rate")).alias("parity_gap"), F.when(F.max("rate") > 0, F.try_divide(F.min("rate"), F.max("rate"))).otherwise(1.0).alias("impact_ratio"))
    return spread.crossJoin(gaps).withColumn("score", clamp01(0.5 * F.col("representation_entropy") + 0.5 * (1 - F.col("parity_gap"))))


def tstr_utility(subject: DataFrame, reference: DataFrame, target: str, seed: int = 7, trees: int = 25) -> DataFrame:
    """score, tstr, trtr: how well trees trained on the subject do on reference rows held back, against trees trained on the rest of the reference."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    names = [c for c in numeric_columns(subject) if c != target and c in numeric_columns(reference)]
    classes = target not in numeric_columns(reference) or reference.agg(F.count_distinct(target)).first()[0] <= 10
    make = VectorAssembler(inputCols=[f"_{c}" for c in names], outputCol="features", handleInvalid="keep")
    label = F.col("_y").cast("double")
    if classes:
        order = [r[0] for r in reference.select(F.col(target).cast("string").alias("y")).union(subject.select(F.col(target).cast("string"))).where("y is not null").groupBy("y").count().orderBy(F.desc("count"), "y").collect()]
        label = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(float(i)))])[F.col("_y").cast("string")]
    ready = lambda df: make.transform(df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_{c}") for c in names], F.col(target).alias("_y"), F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(10)).alias("_fold")).withColumn("label", label).where("label is not null"))
    real, made = ready(reference), ready(subject)
    train, test = real.where("_fold < 7"), real.where("_fold >= 7")

    def measure(rows: DataFrame) -> float:
        if classes and rows.select("label").distinct().count() < 2:
            constant = rows.agg(F.first("label")).first()[0]
            return float(test.agg(F.avg((F.col("label") == F.lit(constant)).cast("double"))).first()[0] or 0.0)
        kind = RandomForestClassifier if classes else RandomForestRegressor
        done = kind(numTrees=trees, seed=seed).fit(rows).transform(test)
        return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(done) if classes else max(0.0, RegressionEvaluator(metricName="r2").evaluate(done))

    tstr, trtr = measure(made), measure(train)
    ratio = tstr / trtr if trtr > 0 else 0.0
    return subject.sparkSession.createDataFrame([(float(min(1.0, max(0.0, ratio))), float(tstr), float(trtr))], "score double, tstr double, trtr double")


def weighted_aggregate(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """overall, band of (dimension, score) rows; plain mean if their weights sum to nothing, 0 without rows."""
    table = WEIGHTS | (weights or {})
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    w = F.coalesce(pairs[F.col("dimension")], F.lit(0.0))
    total = scores.agg(F.sum(w).alias("w"), F.sum(w * F.col("score")).alias("ws"), F.avg("score").alias("mean"))
    overall = F.round(F.when(F.col("w") > 0, F.try_divide(F.col("ws"), F.col("w"))).otherwise(F.coalesce("mean", F.lit(0.0))), 6)
    return total.select(overall.alias("overall"), F.when(overall >= 0.8, "strong").when(overall >= 0.6, "acceptable").otherwise("needs work").alias("band"))
