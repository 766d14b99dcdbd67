"""Graphs made from rules, samples and rows: topologies, types, walks, questions, and the alignment of two ontologies."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions.rng import u01
from tessera.functions.shared import cut
from tessera.operators.graph import Ontology, both_ways, resolved
from tessera.operators.order import checked, ordinals, places, running


#: Draws of a block of pair numbers: a block is as long as so many draws are expected to reach, and has half as many more.
DRAWS = 1024


def _skipped(spark: SparkSession, spaces: list[tuple[int, float]], seed: int, purpose: str) -> DataFrame:
    """(space, at): numbers below each space's size, each chosen with the space's chance, independently.

    A geometric draw leads from one chosen number to the next, so work is that of the chosen ones. Numbers are dealt to
    blocks, which draw for themselves; the chance that a block's draws end before it does is below 1e-30."""
    made = [(i, n, float(p), max(1, int(DRAWS / p))) for i, (n, p) in enumerate(spaces) if n > 0 and p > 0]
    if not made:
        return spark.createDataFrame([], "space int, at long")
    ends = list(accumulate(-(-n // size) for _, n, _, size in made))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), "s")
    blocks = spark.range(ends[-1]).withColumn("s", F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("id"))))
    blocks = blocks.select(pick([x[0] for x in made]).alias("space"), pick([x[1] for x in made]).cast("long").alias("n"), pick([math.log1p(-p) if p < 1 else 0.0 for _, _, p, _ in made]).alias("miss"), pick([x[3] for x in made]).cast("long").alias("size"), (F.col("id") - pick([0, *ends])).alias("k"))
    draws = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(DRAWS + DRAWS // 2 - 1))))
    skip = F.when(F.col("miss") == 0, 1).otherwise(F.floor(F.log(F.lit(1.0) - u01(seed, purpose, "space", "k", "j")) / F.col("miss")) + 1).cast("long")
    upto = W.partitionBy("space", "k").orderBy("j").rowsBetween(W.unboundedPreceding, 0)
    at = draws.select("space", "n", "size", "k", (F.sum(skip).over(upto) - 1).alias("o")).where("o < size")
    return at.select("space", (F.col("k") * F.col("size") + F.col("o")).alias("at"), "n").where("at < n").drop("n")


def _triangle(at: Column) -> tuple[Column, Column]:
    """The pair a < b that has this number, counting b's pairs after those of all below it."""
    b = F.floor((F.sqrt(F.lit(8.0) * at + 1) + 1) / 2).cast("long")
    b = F.when(b * (b - 1) / 2 > at, b - 1).when(b * (b + 1) / 2 <= at, b + 1).otherwise(b)  # the root may be rounded
    return (at - b * (b - 1) / 2).cast("long"), b


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int) -> DataFrame:
    a, b = _triangle(F.col("at"))
    return _skipped(spark, [(n * (n - 1) // 2, p)], seed, "er").select(a.alias("a"), b.alias("b"))


def stochastic_blocks(spark: SparkSession, sizes: list[int], inside: float, across: float, seed: int) -> DataFrame:
    """Edges by chance, more likely within a block; blocks are ranges of node numbers. Each two blocks are a space of pairs of their own."""
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    within = [(starts[i], starts[i], sizes[i]) for i in range(len(sizes))]
    between = [(starts[i], starts[j], sizes[i]) for i in range(len(sizes)) for j in range(i + 1, len(sizes))]
    spaces = [(n * (n - 1) // 2, inside) for n in sizes] + [(sizes[i] * sizes[j], across) for i in range(len(sizes)) for j in range(i + 1, len(sizes))]
    table = F.broadcast(spark.createDataFrame([(k, x, y, n, k < len(sizes)) for k, (x, y, n) in enumerate(within + between)], "space int, x long, y long, width long, own boolean"))
    rows = _skipped(spark, spaces, seed, "sbm").join(table, "space")
    a, b = _triangle(F.col("at"))
    return rows.select((F.col("x") + F.when(F.col("own"), a).otherwise(F.col("at") % F.col("width"))).alias("a"), (F.col("y") + F.when(F.col("own"), b).otherwise(F.floor(F.col("at") / F.col("width")).cast("long"))).alias("b"))


def _power(u: Column, low: float, high: float, exponent: float) -> Column:
    """A draw of a power law between two bounds, by inversion."""
    e = 1 - exponent
    return F.pow(F.lit(low**e) + u * F.lit(high**e - low**e), F.lit(1 / e))


def _least_degree(average: float, high: float, exponent: float) -> float:
    """The lower bound at which a power law has this mean; the upper one if that is no more."""
    if average >= high:
        return high

    def mean(low: float) -> float:
        e, f = 1 - exponent, 2 - exponent
        return (e / f if f else e) * ((high**f - low**f) if f else math.log(high / low)) / (high**e - low**e)

    low, top = 1e-3, float(high)
    for _ in range(80):
        mid = (low + top) / 2
        low, top = (mid, top) if mean(mid) < average else (low, mid)
    return low


def lfr(spark: SparkSession, n: int, seed: int, degree_exponent: float = 3.0, size_exponent: float = 1.5, mixing: float = 0.1, average_degree: float = 5.0, min_community: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, community; pairs a < b): degrees and community sizes by power laws, a share ``mixing`` of each node's links going elsewhere.

    Communities are ranges of node numbers. A node's links within its community are half-edges that are paired in hashed
    order there, the others are paired in hashed order over all; loops, repeated pairs, and outer pairs that meet in one
    community drop, so degrees are met but for these. No step takes one node or link after another."""
    least = min(n, min_community or max(10, n // 10))
    high = max(least + 1.0, n / 2)
    drawn = spark.range(-(-n // least)).select("id", F.floor(_power(u01(seed, "lfr:size", "id"), least, high, size_exponent)).cast("long").alias("size"), F.lit(0).alias("g"))
    spans = running(drawn, ["g"], ["id"], ["size"]).select(F.col("id").alias("community"), (F.col("cum_size") - F.col("size")).alias("from"), "size").where(F.col("from") < n)
    # What is left for the last community may be too little for one of its own: it goes to the one before.
    spans = spans.withColumn("till", F.least(F.lit(n), F.col("from") + F.col("size")))
    spans = spans.where((F.lit(n) - F.col("from") >= least) | (F.col("community") == 0)).withColumn("till", F.when(F.lit(n) - F.col("till") < least, F.lit(n)).otherwise(F.col("till")))
    chunks = spans.withColumn("chunk", F.explode(F.sequence(F.col("from"), F.col("till") - 1, F.lit(100_000)))).repartition("community", "chunk")
    nodes = chunks.select(F.explode(F.sequence("chunk", F.least(F.col("till"), F.col("chunk") + 100_000) - 1)).alias("id"), "community", (F.col("till") - F.col("from")).alias("size"))
    most = max(2.0, min(n - 1.0, n**0.5 * average_degree))
    real = _power(u01(seed, "lfr:degree", "id"), _least_degree(average_degree, most, degree_exponent), most, degree_exponent)
    whole = lambda x, what: (F.floor(x) + (u01(seed, what, "id") < x - F.floor(x)).cast("int")).cast("int")
    nodes = cut(nodes.withColumn("degree", F.greatest(F.lit(1), whole(real, "lfr:round"))))
    nodes = nodes.withColumn("inner", F.least(whole(F.col("degree") * (1 - mixing), "lfr:inner"), (F.col("size") - 1).cast("int")))
    halves = lambda count, what: nodes.where(count > 0).select("id", "community", F.explode(F.sequence(F.lit(1), count)).alias("h")).withColumn("u", u01(seed, what, "id", "h"))
    near = places(halves(F.col("inner"), "lfr:near"), "community", ["u", "id", "h"]).withColumn("pair", F.floor(F.col("_k") / 2)).withColumn("far", F.lit(False))
    far = ordinals(halves(F.col("degree") - F.col("inner"), "lfr:far"), ["u", "id", "h"]).withColumn("pair", F.floor(F.col("_i") / 2)).withColumn("far", F.lit(True))
    ends = lambda df, *by: df.groupBy(*by, "pair").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"), (F.min("community") == F.max("community")).alias("same"), F.first("far").alias("far")).where("n = 2 and a <> b and not (far and same)").select("a", "b")
    return nodes.select("id", "community"), ends(near, "community").union(ends(far)).distinct()


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, seed: int) -> DataFrame:
    """A ring in which each node is joined to its k nearest, and a share of edges goes elsewhere."""
    ring = spark.range(n).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(max(1, k // 2)))).alias("j"))
    other = F.floor(u01(seed, "ws:to", "a", "j") * (n - 1)).cast("long")
    moved = F.when(other >= F.col("a"), other + 1).otherwise(other)
    rows = ring.select("a", F.when(u01(seed, "ws", "a", "j") < p, moved).otherwise((F.col("a") + F.col("j")) % n).alias("b"))
    return rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int, rounds: int = 40) -> DataFrame:
    """Preferential attachment by the copy model: half of a node's links go to an earlier node, half to where an earlier link goes.

    A link that copies holds the number of another link; following those numbers by joins, all links are resolved in a
    few rounds instead of one node after another."""
    links = spark.range(1, n).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    earlier = F.floor(u01(seed, "ba:node", "a", "j") * F.col("a")).cast("long")
    copies = (u01(seed, "ba", "a", "j") < 0.5) & (F.col("a") > 1)
    source = F.least(F.floor(u01(seed, "ba:link", "a", "j") * (F.col("a") - 1)) + 1, F.col("a") - 1).cast("long")
    slot = F.floor(u01(seed, "ba:slot", "a", "j") * m).cast("int")
    state = links.select("a", "j", F.when(~copies, earlier).alias("b"), F.when(copies, source).alias("pa"), F.when(copies, slot).alias("pj"))
    for _ in range(rounds):
        state = cut(state)
        if state.where("b is null").isEmpty():
            break
        known = state.select(F.col("a").alias("pa"), F.col("j").alias("pj"), F.col("b").alias("kb"), F.col("pa").alias("na"), F.col("pj").alias("nj"))
        state = state.join(known, ["pa", "pj"], "left").select("a", "j", F.coalesce("b", "kb").alias("b"), F.when(F.coalesce("b", "kb").isNull(), F.col("na")).alias("pa"), F.when(F.coalesce("b", "kb").isNull(), F.col("nj")).alias("pj"))
    return state.where("b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def assign_types(spark: SparkSession, n: int, types: list[str]) -> DataFrame:
    """(id, type): node types in turn."""
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.get(F.array(*map(F.lit, types)), F.pmod("id", F.lit(len(types))).cast("int")).alias("type"), F.lit("{}").alias("props"))


def map_edges(nodes: DataFrame, pairs: DataFrame, ontology: Ontology) -> DataFrame:
    """Typed edges of pairs by the first edge type that joins their types, else one that joins them the other way round; others drop."""
    n = nodes.select("id", "type")
    ranked = [(e.source, e.target, e.name, i) for i, e in enumerate(ontology.edges)]
    spark = nodes.sparkSession
    o = spark.createDataFrame(ranked, "s string, t string, name string, rank int").groupBy("s", "t").agg(F.min(F.struct("rank", "name"))["name"].alias("name"))
    e = pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).join(n.select(F.col("id").alias("a"), F.col("type").alias("ta")), "a").join(n.select(F.col("id").alias("b"), F.col("type").alias("tb")), "b")
    e = e.join(F.broadcast(o.select(F.col("s").alias("ta"), F.col("t").alias("tb"), F.col("name").alias("f"))), ["ta", "tb"], "left").join(F.broadcast(o.select(F.col("s").alias("tb"), F.col("t").alias("ta"), F.col("name").alias("r"))), ["ta", "tb"], "left")
    back = F.col("f").isNull()
    e = e.where("f is not null or r is not null").select(F.coalesce("f", "r").alias("type"), F.when(back, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("target"))
    return e.distinct().select(F.md5(F.concat_ws("|", "type", "source", "target")).alias("id"), "type", "source", "target", F.lit("{}").alias("props"))


def chung_lu(degrees: DataFrame, seed: int) -> DataFrame:
    """Pairs of nodes joined with the chance of their expected degrees' product over the degrees' sum.

    Each node's degree is dealt as that many half-edges, which a hash pairs: the same expectation, without a look at
    every pair of nodes."""
    halves = degrees.where("degree > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("degree").cast("int"))).alias("h")).select("id", "h", u01(seed, "chung-lu", "id", "h").alias("u"))
    at = ordinals(halves, ["u", "id", "h"]).select("id", F.floor(F.col("_i") / 2).alias("k"))
    ends = at.groupBy("k").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).where("n = 2 and a <> b")
    return ends.select("a", "b").distinct()


def graph_from_sample(nodes: DataFrame, edges: DataFrame, n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``n`` nodes whose types have the sample's shares, joined by edges of the sample's types at its mean degree per type."""
    spark = nodes.sparkSession
    shares = [(r["type"], r["count"]) for r in nodes.groupBy("type").count().orderBy("type").collect()]
    total, cum, run = sum(c for _, c in shares), [], 0
    for t, c in shares:
        run += c
        cum.append((t, run / total))
    u = u01(seed, "type", "id")
    kind = F.coalesce(*[F.when(u < b, F.lit(t)) for t, b in cum], F.lit(cum[-1][0]))
    new_nodes = spark.range(n).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), kind.alias("type"), F.lit("{}").alias("props"))
    ranked = cut(places(new_nodes, "type", ["id"]).withColumnRenamed("_k", "k"))
    sizes = new_nodes.groupBy("type").agg(F.count("*").alias("size"))
    rules = resolved(nodes, edges).where("source_type is not null and target_type is not null").groupBy("type", "source_type", "target_type").agg(F.count("*").alias("m"))
    rules = rules.join(nodes.groupBy(F.col("type").alias("source_type")).agg(F.count("*").alias("s")), "source_type").withColumn("per", F.col("m") / F.col("s"))
    out = ranked.select(F.col("id").alias("source"), F.col("type").alias("source_type")).join(F.broadcast(rules), "source_type")
    out = out.withColumn("c", (F.floor("per") + (u01(seed, "extra", "source", "type") < F.col("per") - F.floor("per")).cast("int")).cast("int")).where("c > 0").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("c"))))
    out = out.join(F.broadcast(sizes.select(F.col("type").alias("target_type"), "size")), "target_type").withColumn("k", F.floor(u01(seed, "to", "source", "type", "j") * F.col("size")).cast("long"))
    out = out.join(ranked.select(F.col("type").alias("target_type"), F.col("k").cast("long").alias("k"), F.col("id").alias("target")), ["target_type", "k"]).where("source <> target")
    return new_nodes, out.select(F.md5(F.concat_ws("|", "type", "source", "target")).alias("id"), "type", "source", "target", F.lit("{}").alias("props")).distinct()


def hybrid_props(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes with the properties of given rows (type, props), dealt in turn within each type; types without rows keep theirs."""
    a = places(nodes, "type", ["id"]).withColumnRenamed("_k", "k").drop("_size")
    b = places(rows, "type", ["props"]).select("type", F.col("_k").alias("k"), F.col("props").alias("new"))
    size = checked(rows.groupBy("type").agg(F.count("*").alias("size")))
    dealt = a.join(size, "type", "left").withColumn("k", F.when(F.col("size") > 0, F.col("k") % F.col("size")))
    return dealt.join(b, ["type", "k"], "left").select("id", "type", F.coalesce("new", "props").alias("props"))


def assemble(shards: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes by id and edges by (type, source, target), the first shard's where several have one."""
    n = [x.withColumn("_s", F.lit(i)) for i, (x, _) in enumerate(shards)]
    e = [x.withColumn("_s", F.lit(i)) for i, (_, x) in enumerate(shards)]
    def first(parts: list[DataFrame], keys: list[str]) -> DataFrame:
        rest = [c for c in parts[0].columns if c not in (*keys, "_s")]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        return both.groupBy(*keys).agg(F.min(F.struct("_s", *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])

    return first(n, ["id"]), first(e, ["type", "source", "target"])


def build_from_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposed nodes (type, key, props) once each by (type, key); proposed edges (type, source_type, source_key, target_type, target_key) whose ends are there, once each."""
    n = nodes.groupBy("type", "key").agg(F.min("props").alias("props")).select(F.concat_ws(":", "type", "key").alias("id"), "type", "key", "props")
    at = lambda s: n.select(F.col("type").alias(f"{s}_type"), F.col("key").alias(f"{s}_key"), F.col("id").alias(s))
    e = edges.join(at("source"), ["source_type", "source_key"]).join(at("target"), ["target_type", "target_key"]).select("type", "source", "target").distinct()
    return n.select("id", "type", "props"), e.select(F.md5(F.concat_ws("|", "type", "source", "target")).alias("id"), "type", "source", "target")


def sample_paths(pairs: DataFrame, walkers: int, hops: int, seed: int) -> DataFrame:
    """(walk, path): simple walks of the given number of hops over undirected pairs, one for each walker that doesn't get stuck; distinct paths only.

    All walkers take a step at once: a join with the neighbours that the path lacks, then the least by hash for each walker."""
    step = both_ways(pairs)
    starts = ordinals(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), ["id"])
    n = starts.count()
    spark = pairs.sparkSession
    w = spark.range(walkers).select(F.col("id").alias("walk"), F.floor(u01(seed, "start", "id") * n).cast("long").alias("_i")).join(starts, "_i").select("walk", F.array("id").alias("path"))
    for h in range(hops):
        near = w.withColumn("id", F.element_at("path", -1)).join(step, "id").where(~F.array_contains("path", F.col("other")))
        best = near.groupBy("walk").agg(F.min_by(F.struct("path", "other"), F.struct(u01(seed, f"step{h}", "walk", "other"), F.col("other"))).alias("s"))
        w = best.select("walk", F.concat("s.path", F.array("s.other")).alias("path"))
    return w.groupBy("path").agg(F.min("walk").alias("walk")).select("walk", "path")


def qa_chain(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Questions along walks: what is reached from the first node over the edges' types; the last node is the answer."""
    hops = paths.select("walk", "path", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("x"), F.slice("path", 2, F.size("path") - 1).alias("y"))).alias("at", "hop"))
    names = edges.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"), "type").groupBy("lo", "hi").agg(F.min("type").alias("type"))
    typed = hops.withColumn("lo", F.least("hop.x", "hop.y")).withColumn("hi", F.greatest("hop.x", "hop.y")).join(names, ["lo", "hi"])
    rows = typed.groupBy("walk", "path").agg(F.array_sort(F.collect_list(F.struct("at", "type"))).alias("t"))
    phrase = F.array_join(F.transform("t", lambda x: S.rel_phrase(x["type"])), ", then ")
    return rows.select("walk", F.concat(F.lit("Starting from "), F.get("path", 0), F.lit(", what is reached by: "), phrase, F.lit("?")).alias("question"), F.element_at("path", -1).alias("answer"), S.difficulty(F.size("path") - 1).alias("difficulty"))


def qa_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many edges of each type a node has: question and answer."""
    n = edges.groupBy("source", "type").agg(F.count("*").alias("n"))
    return n.select(F.col("source").alias("node"), F.concat(F.lit("How many times does "), "source", F.lit(" "), S.rel_phrase(F.col("type")), F.lit("?")).alias("question"), F.col("n").cast("string").alias("answer"))


def qa_exists(nodes: DataFrame, edges: DataFrame, ontology: Ontology) -> DataFrame:
    """Whether a node has an edge of each type that its own type allows: question and yes or no."""
    o = F.broadcast(ontology.edge_frame(nodes.sparkSession).select(F.col("name").alias("edge"), F.col("source_type").alias("type")))
    have = edges.select(F.col("source").alias("id"), F.col("type").alias("edge")).distinct().withColumn("has", F.lit("yes"))
    rows = nodes.select("id", "type").join(o, "type").join(have, ["id", "edge"], "left")
    return rows.select(F.col("id").alias("node"), F.concat(F.lit("Does "), "id", F.lit(" "), S.rel_phrase(F.col("edge")), F.lit(" anything?")).alias("question"), F.coalesce("has", F.lit("no")).alias("answer"))


def qa_compare(edges: DataFrame) -> DataFrame:
    """Which of two neighbours in id order has more edges of a type: question and answer; equal counts ask nothing."""
    n = edges.groupBy("type", "source").agg(F.count("*").alias("n"))
    at = ordinals(n, ["type", "source"]).drop("_n")
    after = at.select((F.col("_i") - 1).alias("_i"), "type", F.col("source").alias("other"), F.col("n").alias("m"))
    rows = at.join(after, ["_i", "type"]).where("n <> m")
    return rows.select("type", F.concat(F.lit("Which has more "), S.rel_phrase(F.col("type")), F.lit(" links, "), "source", F.lit(" or "), "other", F.lit("?")).alias("question"), F.when(F.col("n") > F.col("m"), F.col("source")).otherwise(F.col("other")).alias("answer"))


def qa_checks(items: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """n, answerable, multi_hop, grounded: shares of items (path, answer) whose nodes all exist, whose path is joined hop by hop
    to the answer, and that name known nodes at all."""
    rows = ordinals(items.select("path", "answer").distinct(), ["path", "answer"]).select(F.col("_i").alias("item"), "path", "answer")
    known = rows.select("item", F.explode("path").alias("id")).join(nodes.select("id").distinct().withColumn("ok", F.lit(1)), "id", "left").groupBy("item").agg(F.min(F.coalesce("ok", F.lit(0))).alias("all_known"), F.max(F.coalesce("ok", F.lit(0))).alias("any_known"))
    hops = rows.where(F.size("path") > 1).select("item", F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("x"), F.slice("path", 2, F.size("path") - 1).alias("y"))).alias("h"))
    joined = hops.select("item", F.least("h.x", "h.y").alias("a"), F.greatest("h.x", "h.y").alias("b")).join(pairs.withColumn("ok", F.lit(1)), ["a", "b"], "left").groupBy("item").agg(F.min(F.coalesce("ok", F.lit(0))).alias("walks"))
    out = rows.join(known, "item", "left").join(joined, "item", "left").na.fill(0)
    return out.agg(F.count("*").alias("n"), F.avg("all_known").alias("answerable"), F.avg(((F.col("walks") == 1) & (F.element_at("path", -1) == F.col("answer"))).cast("double")).alias("multi_hop"), F.avg("any_known").alias("grounded"))


def align(left: DataFrame, right: DataFrame, floor: float = 0.3, accept: float = 0.85, review: float = 0.5) -> DataFrame:
    """(source, target, score, predicate, route): each label's best match of the other ontology, ties by name.

    Labels that share a token meet by it. Without one the score is half of the likeness in characters, so only labels
    whose lengths allow the floor, and that have a character in common, are compared."""
    names = lambda df, c: cut(df.select(F.col("label").alias(c)).distinct().withColumn("words", S.tokenize_label(F.col(c))).withColumn("flat", F.array_join("words", " ")).withColumn("size", F.length("flat")))
    a, b = names(left, "source"), names(right, "target")
    word = lambda df, c: df.select(c, F.explode(F.array_distinct("words")).alias("word"))
    shared = word(a, "source").join(word(b, "target"), "word").select("source", "target").distinct()
    least = 2 * floor  # the likeness in characters that a pair without a shared token needs
    if least <= 1:
        reach = a.select("source", "size", "flat", F.explode(F.sequence(F.ceil(F.col("size") * least - 1e-9).cast("int"), F.floor(F.col("size") / least + 1e-9).cast("int"))).alias("length"))
        signs = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: F.length(x) > 0))
        by_size = reach.join(b.select("target", F.col("size").alias("length"), F.col("flat").alias("other")), "length")
        by_size = by_size.where((F.size(F.array_intersect(signs(F.col("flat")), signs(F.col("other")))) > 0) | ((F.col("size") == 0) & (F.col("length") == 0)))
        by_size = by_size.where(1 - F.levenshtein("flat", "other") / F.greatest("size", "length", F.lit(1)) >= least - 1e-9)
        shared = shared.union(by_size.select("source", "target")).distinct()
    scored = shared.withColumn("score", S.lexical_score(F.col("source"), F.col("target"))).where(F.col("score") >= floor)
    best = scored.groupBy("source").agg(F.min(F.struct((-F.col("score")).alias("s"), "target")).alias("b")).select("source", F.col("b.target").alias("target"), (-F.col("b.s")).alias("score"))
    route: Column = F.when(F.col("score") >= accept, "accept").when(F.col("score") >= review, "review").otherwise("drop")
    return best.select("source", "target", "score", S.predicate_for_score(F.col("score")).alias("predicate"), route.alias("route"))


def mapping_review(mappings: DataFrame) -> DataFrame:
    """One row if any mapping awaits review: how many, and their sources."""
    return mappings.where("route = 'review'").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).where("n > 0")


def engine(sample=None, topology: str | None = None, rows=None) -> str:
    """Which builder serves a request: sample first, then hybrid of topology and rows, then topology, then rows."""
    if sample is not None:
        return "sample"
    if topology and rows is not None:
        return "hybrid"
    return "topology" if topology else "rows"


def topology_pairs(spark: SparkSession, name: str, n: int, seed: int, params: dict | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, communities or None) of a named topology; parameters left out have their usual values, bounded by ``n``."""
    p = params or {}
    if name == "barabasi_albert":
        return barabasi_albert(spark, n, max(1, min(int(p.get("m", 2)), n - 1)), seed), None
    if name == "watts_strogatz":
        return watts_strogatz(spark, n, max(2, min(int(p.get("k", 4)), n - 1)), float(p.get("p", 0.1)), seed), None
    if name == "erdos_renyi":
        return erdos_renyi(spark, n, float(p.get("p", min(0.1, 10 / max(n, 1)))), seed), None
    if name == "stochastic_block_model":
        sizes = list(p.get("sizes") or p.get("blocks") or [n // 3 + (i < n % 3) for i in range(3)])
        table = spark.createDataFrame([(i, sum(sizes[:i]), sum(sizes[: i + 1])) for i in range(len(sizes))], "community long, lo long, hi long")
        communities = spark.range(sum(sizes)).join(F.broadcast(table), (F.col("id") >= F.col("lo")) & (F.col("id") < F.col("hi"))).select("id", "community")
        return stochastic_blocks(spark, sizes, float(p.get("p_in", 0.3)), float(p.get("p_out", 0.02)), seed), communities
    if name == "lfr":
        communities, pairs = lfr(spark, n, seed, float(p.get("tau1", 3.0)), float(p.get("tau2", 1.5)), float(p.get("mu", 0.1)), float(p.get("average_degree", 5)), p.get("min_community"))
        return pairs, communities
    raise ValueError(f"unknown topology {name!r}")


def build(spark: SparkSession, n: int, seed: int, ontology: Ontology | None = None, sample: tuple[DataFrame, DataFrame] | None = None, topology: str | None = None, rows: tuple[DataFrame, DataFrame] | None = None, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """A graph by the builder that ``engine`` names. ``rows`` are proposed nodes and edges; with a topology, its nodes' properties are dealt to the topology's."""
    kind = engine(sample, topology, rows)
    if kind == "sample":
        return graph_from_sample(*sample, n, seed)
    if kind == "rows":
        return build_from_rows(*rows)
    if not ontology or not ontology.nodes:
        raise ValueError("a topology needs node types")
    pairs, communities = topology_pairs(spark, topology, n, seed, params)
    names = [t.name for t in ontology.nodes]
    nodes = assign_types(spark, n, names)
    if communities is not None:  # a community is of one type
        nodes = communities.select(F.col("id").cast("string").alias("id"), F.get(F.array(*map(F.lit, names)), F.pmod("community", F.lit(len(names))).cast("int")).alias("type"), F.lit("{}").alias("props"))
    nodes = cut(nodes)
    if kind == "hybrid":
        nodes = cut(hybrid_props(nodes, rows[0].select("type", "props")))
    return nodes, map_edges(nodes, pairs, ontology)
