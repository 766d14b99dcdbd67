"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted to unit vectors of a bounded sample; every vector is indexed in the leaf that a greedy descent finds.
Leaves that hold more rows than their part of the sample promised are split again, each by a tree fitted to a bounded
sample of its own rows, until all are small, so a leaf's work does not grow with the table. A query visits leaves
best-bin-first: a priority queue holds a tree's open branches by distance, the nearest is opened first. How many leaves
are visited is calibrated for each tree: visits widen over sample queries until the share of their true neighbours found
reaches the wanted recall. Queries and vectors then meet leaf by leaf, in blocks. Vectors are scaled by a power of two
before any product, so no finite component overflows.

Defined results: vectors that are null, zero, of another length than most, or hold a null or non-finite component, and
those of null id, take no part; a query's own row is every row of its id, of whose several vectors the least asks; equal vectors are indexed once with their
smallest ids, as many as could be in a result; without candidates a query has no rows; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Lists, discard, map_rows, materialize, named

BRANCH, LEAF, SAMPLE, TRIALS = 8, 256, 20_000, 300
#: A leaf is split if it holds more than so many times the rows it should; its tree has fewer leaves than FAN.
SPLIT, SPLIT_SAMPLE, FAN = 4, 4096, 4096
#: Vectors and queries of a leaf that one task multiplies.
BLOCK = 4096


def _kmeans(x: np.ndarray, k: int, rng: np.random.RandomState, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        for j in range(k):
            own = x[at == j]
            centres[j] = own.mean(0) if len(own) else x[rng.randint(len(x))]
    return centres, np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)


class Tree:
    """``children[node]`` is a pair of centres and node numbers, or None at a leaf; ``leaf[node]`` numbers the leaves."""

    def __init__(self, x: np.ndarray, leaf_size: float, seed: int = 5):
        rng = np.random.RandomState(seed)
        self.children: list[tuple[np.ndarray, list[int]] | None] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(x, leaf_size, rng)

    def _grow(self, x: np.ndarray, leaf_size: float, rng: np.random.RandomState) -> int:
        node = len(self.children)
        self.children.append(None)
        self.leaf.append(-1)
        k = int(min(BRANCH, max(2, round(len(x) / max(1.0, leaf_size)))))
        if len(x) > 1.5 * leaf_size and len(x) >= 2 * k:
            centres, at = _kmeans(x, k, rng)
            used = [j for j in range(k) if (at == j).any()]
            if len(used) > 1:
                self.children[node] = (centres[used], [self._grow(x[at == j], leaf_size, rng) for j in used])
                return node
        self.leaf[node] = self.leaves
        self.leaves += 1
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            inner = self.children[node]
            if inner is None:
                out[rows] = self.leaf[node]
                continue
            centres, below = inner
            at = np.argmax(x[rows] @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
            todo += [(b, rows[at == j]) for j, b in enumerate(below) if (at == j).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in the order of best-bin-first search."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            while (inner := self.children[node]) is not None:
                centres, below = inner
                far = ((centres - q) ** 2).sum(1)
                best = int(np.argmin(far))
                for j, b in enumerate(below):
                    if j != best:
                        heapq.heappush(queue, (float(far[j]), b))
                node = below[best]
            out.append(self.leaf[node])
        return out


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float, seed: int = 9) -> int:
    """Fewest leaves at which sample queries find ``recall`` of their true ``k`` neighbours within the sample.

    In all rows true neighbours are at least as near as in the sample, so they share leaves at least as often."""
    if tree.leaves < 2 or len(x) < 3:
        return tree.leaves
    own = np.random.RandomState(seed).choice(len(x), min(TRIALS, len(x)), replace=False)
    at, ranks = tree.assign(x), []
    for i in own:
        near = x @ x[i]
        near[i] = -np.inf
        true = np.argpartition(-near, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        place = {leaf: n for n, leaf in enumerate(tree.visits(x[i], tree.leaves))}
        ranks += [place[leaf] for leaf in at[true]]
    return int(np.quantile(ranks, recall, method="higher")) + 1


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which makes their largest component less than 1 without rounding it."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(col, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _cogroup(left: DataFrame, right: DataFrame, keys: tuple[str, ...], fn, schema: str) -> DataFrame:
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, schema)


def _blocks(df: DataFrame, name: str) -> DataFrame:
    """Blocks that each leaf's rows are dealt to."""
    return df.groupBy("_leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))


INDEXED, ASKED = "_ids array<long>, _v array<double>, _leaf long, _whole boolean", "_id long, _v array<double>, _leaf long"


def _deepen(indexed: DataFrame, asked: DataFrame, dim: int, k: int, recall: float, leaf: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with every leaf split that holds too many rows; ``_whole`` marks leaves that no tree can split."""
    while True:
        big = materialize(indexed.where("not _whole").groupBy("_leaf").agg(F.count("*").alias("_n")).where(F.col("_n") > SPLIT * leaf), "big")
        if big.isEmpty():
            discard(big)
            return indexed, asked

        def fit(key, rows):
            x = _unit(_matrix(rows.column("_v"), dim))
            tree = Tree(x, max(8.0, leaf * len(x) / rows.column("_n")[0].as_py()))
            return pa.table({"_leaf": pa.array([key[0].as_py()], pa.int64()), "_tree": pa.array([pickle.dumps(tree)], pa.binary()), "_visits": pa.array([calibrate(tree, x, k, recall)], pa.int32())})

        some = F.pmod(F.xxhash64("_ids"), F.lit(1 << 20)) < F.lit(1 << 20) * F.least(F.lit(1.0), F.lit(sample) / F.col("_n"))  # none of over 1024 rows: no chance
        trees = materialize(indexed.join(big, "_leaf").where(some).select("_leaf", "_v", "_n").groupBy("_leaf").applyInArrow(fit, "_leaf long, _tree binary, _visits int"), "trees")

        def descend(rows: pa.Table, tree: pa.Table) -> pa.Table:
            at, whole = np.zeros(0, np.int64), True
            if rows.num_rows:
                made = pickle.loads(tree.column("_tree")[0].as_py())
                at, whole = made.assign(_unit(_matrix(rows.column("_v"), dim))) + tree.column("_leaf")[0].as_py() * FAN, made.leaves < 2
            return pa.table({"_ids": rows.column("_ids"), "_v": rows.column("_v"), "_leaf": pa.array(at, pa.int64()), "_whole": pa.array([whole] * len(at), pa.bool_())})

        def spread(rows: pa.Table, tree: pa.Table) -> pa.Table:
            out: dict[str, list] = {"_id": [], "_v": [], "_leaf": []}
            if rows.num_rows:
                made, most, up = pickle.loads(tree.column("_tree")[0].as_py()), tree.column("_visits")[0].as_py(), tree.column("_leaf")[0].as_py() * FAN
                for i, v, q in zip(rows.column("_id").to_pylist(), rows.column("_v").to_pylist(), _unit(_matrix(rows.column("_v"), dim))):
                    for x in made.visits(q, most):
                        for c, y in zip(out, (i, v, up + x)):
                            out[c].append(y)
            return pa.table({"_id": pa.array(out["_id"], pa.int64()), "_v": pa.array(out["_v"], pa.list_(pa.float64())), "_leaf": pa.array(out["_leaf"], pa.int64())})

        def split(rows: DataFrame, by: str, fn, schema: str) -> DataFrame:
            own = rows.join(big, "_leaf", "left_semi")
            cuts = _blocks(own, "_parts")
            dealt = own.join(cuts, "_leaf").withColumn("_part", F.pmod(F.xxhash64(by), "_parts").cast("int")).drop("_parts")
            each = trees.join(cuts, "_leaf").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
            return materialize(rows.join(big, "_leaf", "left_anti").unionByName(_cogroup(dealt, each, ("_leaf", "_part"), fn, schema)), "split")

        old = (indexed, asked, big, trees)
        indexed, asked = split(indexed, "_ids", descend, INDEXED), split(asked, "_id", spread, ASKED)
        discard(*old)


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, recall: float = 0.97, leaf: int = LEAF, sample: int = SAMPLE, split_sample: int = SPLIT_SAMPLE) -> DataFrame:
    """For each row whose id is divisible by ``every``: query_id, rank, vec_id, score (cosine) of its ``k`` nearest found.

    Plan: repeated rows are dropped, then equal vectors are cut to ``k + 1`` ids, both before they are shuffled too; the
    driver holds about ``sample`` vectors and a tree, which is broadcast and at most that large; each leaf of more than
    ``SPLIT * leaf`` rows is split by a tree of about ``split_sample`` of its rows, in one task, which goes to the blocks
    of its rows only; vectors and the queries that visit a leaf are shuffled by leaf, in blocks of ``BLOCK`` each, and a
    query's best per block are merged."""
    spark = vectors.sparkSession
    v = named(vec_col).cast("array<double>")
    read = vectors.select(named(id_col).cast("long").alias("_id"), v.alias("_v")).where(F.col("_id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    read = read.where(~F.exists("_v", bad)).where(F.exists("_v", lambda x: x != 0))
    dims = read.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims["d"]
    read = read.where(F.size("_v") == dim)
    order = W.partitionBy("_h", "_v").orderBy("_id")
    once = read.withColumn("_h", F.xxhash64("_v")).distinct()  # repeated rows must not crowd out other ids
    distinct = once.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).groupBy("_h", "_v").agg(F.sort_array(F.collect_set("_id")).alias("_ids"))
    distinct = materialize(distinct, "vectors")
    n = distinct.count()
    some = F.pmod(F.xxhash64("_ids"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sample / n)))
    x = _unit(_matrix(distinct.where(some).orderBy("_ids").limit(sample * 2).select("_v").toArrow().column(0), dim)) if n > 1 else np.ones((1, dim))
    tree = Tree(x, max(8.0, leaf * len(x) / n))
    visits = calibrate(tree, x, k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def index(rows: Lists) -> dict[str, list]:
        at = shared.value.assign(_unit(np.array(rows["_v"], np.float64).reshape(-1, dim))) if rows["_v"] else []
        return {"_leaf": [int(i) + 1 for i in at], "_whole": [False] * len(at)}

    def visit(rows: Lists) -> dict[str, list]:
        out: dict[str, list] = {"_id": [], "_v": [], "_leaf": []}
        for i, q in zip(rows["_id"], rows["_v"]):
            for x in shared.value.visits(_unit(np.array([q]))[0], visits):
                out["_id"].append(i)
                out["_v"].append(q)
                out["_leaf"].append(x + 1)
        return out

    queries = read.where(F.col("_id") % every == 0).groupBy("_id").agg(F.min("_v").alias("_v"))
    indexed = materialize(map_rows(distinct.select("_ids", "_v"), index, INDEXED), "index")
    asked = materialize(map_rows(queries.select("_id", "_v"), visit, ASKED), "asked")
    discard(distinct)
    indexed, asked = _deepen(indexed, asked, dim, k, recall, leaf, split_sample)
    cuts = _blocks(indexed, "_nv").join(_blocks(asked, "_nq"), "_leaf")
    left = indexed.join(cuts, "_leaf").select("_leaf", F.pmod(F.xxhash64("_ids"), "_nv").cast("int").alias("_bv"), F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)).alias("_bq"), "_ids", "_v")
    right = asked.join(cuts, "_leaf").select("_leaf", F.explode(F.sequence(F.lit(0), F.col("_nv") - 1)).alias("_bv"), F.pmod(F.xxhash64("_id"), "_nq").cast("int").alias("_bq"), "_id", "_v")

    def meet(vecs: pa.Table, asks: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if vecs.num_rows and asks.num_rows:
            m, q = _scaled(_matrix(vecs.column("_v"), dim)), _scaled(_matrix(asks.column("_v"), dim))
            ids = vecs.column("_ids").to_pylist()
            scores = (q @ m.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :])
            most = min(k + 1, len(m))
            for row, qid in zip(scores, asks.column("_id").to_pylist()):
                least = np.partition(row, len(m) - most)[len(m) - most]
                found = sorted((-row[j], i) for j in np.flatnonzero(row >= least) for i in ids[j] if i != qid)[:k]
                out["query_id"] += [qid] * len(found)
                out["vec_id"] += [i for _, i in found]
                out["score"] += [-s for s, _ in found]
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    met = _cogroup(left, right, ("_leaf", "_bv", "_bq"), meet, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
