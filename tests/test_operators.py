"""Invariants that SQL can't show: determinism over partitions, exact no-ops, errors, round trips, and edge cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import generate as G
from tessera.operators import graph as X
from tessera.operators import graph_build as B
from tessera.operators import graph_perturb as R
from tessera.operators import judges, metadata, profile
from tessera.operators import order as O
from tessera.operators import perturb as P
from tessera.plans import evaluate
from tessera.sources import readers, writers


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, float(i % 37), ["a", "b", "c"][i % 3], f"word {i} and more") for i in range(300)], "k long, num double, cat string, text string").cache()


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("family,kind,column", [("noise", "gaussian", "num"), ("noise", "uniform", "num"), ("noise", "swap", "cat"), ("noise", "char", "text"), ("noise", "word", "text"), ("noise", "mask", "text"), ("drift", "temporal", "num"), ("drift", "progressive", "text"), ("outlier", None, "num"), ("bias", None, "cat"), ("edge", "boundary", "num")])
def test_perturbations_ignore_partitions_and_obey_seeds(rows, family, kind, column):
    run = lambda df, seed: P.perturb(df, family, column, ["k"], seed, 0.4, kind)
    first = run(rows, 3)
    assert first.dtypes == rows.dtypes and first.count() == rows.count()
    assert same(first, run(rows.repartition(7), 3))
    if family != "drift" or kind == "progressive":
        assert not same(first, run(rows, 4))


@pytest.mark.parametrize("family,kind,column", [("noise", "swap", "cat"), ("noise", "mask", "text"), ("outlier", None, "num"), ("edge", "nulls", "num"), ("edge", "format", "cat")])
def test_no_intensity_changes_nothing(rows, family, kind, column):
    assert same(P.perturb(rows, family, column, ["k"], 3, 0.0, kind), rows)


def test_unknown_perturbation(rows):
    with pytest.raises(NotImplementedError):
        P.perturb(rows, "image", "num", ["k"], 1, 0.1)


def test_bias_reaches_ratio(rows):
    share = P.bias_resample(rows, "cat", ["k"], 5, 0.9, "a").agg(F.avg((F.col("cat") == "a").cast("double"))).first()[0]
    assert abs(share - 0.9) < 0.01


@pytest.mark.parametrize("size", [7, 250_000])
def test_places_and_sums_are_those_of_one_order(rows, size):
    assert sorted((r["num"], r["k"], r["_i"]) for r in O.ordinals(rows, ["num", "k"], size).collect()) == [(a, k, i) for i, (a, k) in enumerate(sorted((float(k % 37), k) for k in range(300)))]
    got = {r["k"]: r for r in O.running(rows, ["cat"], ["num", "k"], ["k", "num"], size).collect()}
    seen = {}
    for num, k in sorted((float(k % 37), k) for k in range(300)):
        own = seen.setdefault(k % 3, [0, 0.0])
        own[0] += k
        own[1] += num
        assert got[k]["cum_k"] == own[0] and abs(got[k]["cum_num"] - own[1]) < 1e-9
    assert all(got[k]["all_k"] == seen[k % 3][0] for k in range(300))
    assert O.running(rows.limit(0), ["cat"], ["k"], ["num"]).count() == 0 and O.ordinals(rows.limit(0), ["k"]).count() == 0


def test_large_and_small_value_tables_give_the_same(rows, monkeypatch):
    ways = [P.categorical_swap(rows, "cat", ["k"], 3, 0.5), P.rotate(rows, "cat"), P.categorical_swap(rows, "text", ["k"], 3, 0.5)]
    small = [x.collect() for x in ways]
    monkeypatch.setattr(O, "SMALL", 0)
    for a, b in zip(small, [P.categorical_swap(rows, "cat", ["k"], 3, 0.5), P.rotate(rows, "cat"), P.categorical_swap(rows, "text", ["k"], 3, 0.5)]):
        assert sorted(map(tuple, a)) == sorted(map(tuple, b.collect()))
    changed = {r["k"]: r["text"] for r in small[2]}
    assert 100 < sum(changed[k] != f"word {k} and more" for k in range(300)) < 200 and set(changed.values()) <= {f"word {k} and more" for k in range(300)}


@pytest.mark.parametrize("cell,block", [(512, 4096), (8, 5)])
def test_nearest_rows_are_exact(spark, monkeypatch, cell, block):
    import numpy as np

    monkeypatch.setattr(judges, "CELL", cell)
    rng = np.random.RandomState(1)
    a = np.concatenate([rng.standard_normal((60, 2)) * 50, np.zeros((10, 2)), rng.randint(0, 3, (30, 2))])
    b = np.concatenate([rng.standard_normal((300, 2)) * 20, np.ones((200, 2)), rng.randint(0, 4, (100, 2))])
    make = lambda x: spark.createDataFrame([(i, float(u), None if i % 41 == 40 else float(v)) for i, (u, v) in enumerate(x)], "key long, u double, v double")
    got = {r["key"]: r["distance"] for r in judges.nearest_distances(make(a), make(b), ["u", "v"], "key", block).collect()}
    holes = lambda x: np.array([np.nan if i % 41 == 40 else v for i, v in enumerate(x)])
    bu, bv = b[:, 0], holes(b[:, 1])
    scale = lambda x, of: np.nan_to_num((x - np.nanmean(of)) / np.nanstd(of))
    x, y = np.stack([scale(a[:, 0], bu), scale(holes(a[:, 1]), bv)], 1), np.stack([scale(bu, bu), scale(bv, bv)], 1)
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2).min(1))
    assert len(got) == 100 and all(abs(got[i] - want[i]) < 1e-9 for i in range(100))
    assert judges.nearest_distances(make(a).limit(0), make(b), ["u", "v"], "key").count() == 0
    assert {r["distance"] for r in judges.nearest_distances(make(a), make(b).limit(0), ["u", "v"], "key").collect()} == {None}


def test_empty_tables(spark, rows):
    none = rows.limit(0)
    assert P.perturb(none, "noise", "num", ["k"], 1, 0.5, "gaussian").count() == 0
    assert profile.profile_columns(none).count() == 4
    assert judges.diversity(none).count() == 1


def test_profile_of_constants_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0)], "a long, b double")
    got = {r["column"]: r for r in profile.profile_columns(df).collect()}
    assert got["a"]["std_value"] == 0.0 and got["b"]["null_rate"] == 0.5 and got["b"]["std_value"] == 0.0
    assert [r["r"] for r in profile.correlations(df).where("a <> b").collect()] == [None, None]


def test_identical_tables_are_faithful_and_not_private(rows):
    assert judges.fidelity(rows.drop("text"), rows.drop("text")).first()["score"] == 1.0
    got = judges.privacy(rows.select("k", "num"), rows.select("k", "num"), "k").first()
    assert got["duplicate_rate"] == 1.0 and got["score"] == 0.0


def test_weights(spark):
    scores = lambda *x: spark.createDataFrame(list(x), "dimension string, score double")
    assert judges.weighted_aggregate(scores(("fidelity", 1.0), ("privacy", 0.0))).first()["overall"] == round(0.22 / 0.39, 6)
    assert judges.weighted_aggregate(scores(("fidelity", 1.0), ("privacy", 0.0)), {"fidelity": 3.0, "privacy": 1.0}).first()["overall"] == 0.75
    assert judges.weighted_aggregate(scores(("odd", 0.4))).first()["overall"] == 0.4
    assert judges.weighted_aggregate(scores()).first()["overall"] == 0.0


def test_directive_errors(spark):
    fields = [G.FieldSpec("a", "integer")]
    for rule in ({"value": 1}, {"field": "b", "rate": 0.1}, {"field": "a"}, {"field": "a", "rate": 0.1, "value": "null"}):
        with pytest.raises(G.DirectiveError):
            G.directives(spark, fields, [rule], 0, 5, 1)


def test_shards_of_a_table_are_its_ranges(spark):
    fields = [G.FieldSpec("a", "integer"), G.FieldSpec("n", "name"), G.FieldSpec("t", "text")]
    assert same(G.table(spark, fields, 0, 60, 2), G.table(spark, fields, 0, 25, 2).union(G.table(spark, fields, 25, 35, 2)))
    assert G.shard_plan(0) == [(0, 0)] and G.shard_plan(450, "text") == [(0, 200), (200, 200), (400, 50)]


def test_copula_keeps_marginals(spark, rows):
    got = G.Copula(rows, [G.FieldSpec("num", "float"), G.FieldSpec("cat", "categorical")]).sample(spark, 0, 2000, 3)
    r = got.agg(F.min("num"), F.max("num"), F.avg("num"), F.count_distinct("cat")).first()
    assert 0 <= r[0] and r[1] <= 36 and abs(r[2] - 18) < 2 and r[3] == 3
    for name in ("ctgan", "tvae", "sdv"):
        with pytest.raises(NotImplementedError):
            G.synthesizer(name)


def test_tasks():
    assert evaluate.text_shape(["label", "text"]) == "classification" and evaluate.text_shape(["messages"]) == "chat"
    assert evaluate.detect_task("tabular", ["a"], "a", True) == "tabular_regression"


ONTO = X.Ontology((X.NodeType("P", (X.Prop("age", "integer", constraints={"min": 0, "max": 120}),)), X.NodeType("C")), (X.EdgeType("AT", "P", "C"), X.EdgeType("KNOWS", "P", "P", False)))


@pytest.fixture(scope="module")
def people(spark):
    n = spark.createDataFrame([(f"p{i}", "P", f'{{"age":{20 + i}}}') for i in range(8)] + [(f"c{i}", "C", "{}") for i in range(3)], "id string, type string, props string")
    e = spark.createDataFrame([(f"e{i}", "AT", f"p{i}", f"c{i % 3}", "{}") for i in range(8)] + [("k", "KNOWS", "p0", "p1", "{}"), ("k2", "KNOWS", "p1", "p3", "{}")], "id string, type string, source string, target string, props string")
    return n.cache(), e.cache()


def test_graph_measures(people):
    n, e = people
    assert X.constraint_check(n, e, ONTO).count() == 0
    assert X.ontology_pass_rate(n, e, ONTO).first()["rate"] == 1.0
    p = X.to_undirected(n, e)
    assert {r["component"] for r in X.components(n, p).collect()} == {"c0", "c2"}
    assert X.triangles(p, X.degree(n, p)).count() == 0
    assert X.graph_privacy(n, e, n, e).first()["score"] == 0.0


def test_average_path_is_over_all_pairs(spark, monkeypatch):
    joined = {(0, i) for i in range(1, 121)} | {(i, i + 1) for i in range(120, 126)} | {(300, 301)}
    around = {}
    for a, b in joined:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    total, n = 0, 127
    for s in range(n):
        far, todo = {s: 0}, [s]
        for x in todo:
            for y in around[x]:
                if y not in far:
                    far[y] = far[x] + 1
                    todo.append(y)
        total += sum(far.values())
    nodes = spark.createDataFrame([(f"n{i}",) for i in around], "id string")
    pairs = spark.createDataFrame([tuple(sorted((f"n{a}", f"n{b}"))) for a, b in joined], "a string, b string")
    want = total / (n * (n - 1))
    assert X.average_path(nodes, pairs).first()[0] == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(X, "BITS", 100)
    assert X.average_path(nodes, pairs).first()[0] == pytest.approx(want, abs=1e-12)
    assert X.average_path(nodes.limit(0), pairs.limit(0)).first()[0] == 0.0


def test_average_path_holds_no_bitmaps_of_leaves_and_broadcasts_none(spark, monkeypatch):
    joined = {(i, (i + 1) % 7) for i in range(7)} | {(1, 4)} | {(i % 7, 10 + i) for i in range(60)} | {(10 + i, 100 + i) for i in range(9)} | {(100, 110), (110, 111), (900, 901)}
    around = {}
    for a, b in joined:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    total, inside = 0, [x for x in around if x < 900]
    for s in inside:
        far, todo = {s: 0}, [s]
        for x in todo:
            for y in around[x]:
                if y not in far:
                    far[y] = far[x] + 1
                    todo.append(y)
        total += sum(far.values())
    nodes = spark.createDataFrame([(f"n{i}",) for i in around], "id string")
    pairs = spark.createDataFrame([tuple(sorted((f"n{a}", f"n{b}"))) for a, b in joined], "a string, b string")
    plans, kept, construct = [], X.cut, X.F.bitmap_construct_agg

    def written(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "bitmap" in plan:
            plans.append(plan)
        return kept(df)

    monkeypatch.setattr(X, "cut", written)
    for block in (1 << 15, 3):
        monkeypatch.setattr(X, "BITS", block)
        assert X.average_path(nodes, pairs).first()[0] == pytest.approx(total / (len(inside) * (len(inside) - 1)), abs=1e-12)
    assert len(plans) > 4 and not any("Broadcast" in x for x in plans)

    def refused(c):
        raise AssertionError("bitmaps of a tree")

    monkeypatch.setattr(X.F, "bitmap_construct_agg", refused)
    star = spark.createDataFrame([("a", f"b{i}") for i in range(50)], "a string, b string")
    ends = spark.createDataFrame([("a",), *[(f"b{i}",) for i in range(50)]], "id string")
    assert X.average_path(ends, star).first()[0] == pytest.approx((2 * 50 + 50 * 49 * 2) / (51 * 50), abs=1e-12)
    monkeypatch.setattr(X.F, "bitmap_construct_agg", construct)
    assert X.average_path(ends.limit(1), star.limit(0)).first()[0] == 0.0


@pytest.mark.parametrize("judge, first", [("structural_fidelity", "clustering"), ("graph_tstr", "greedy_communities"), ("graph_privacy", "fingerprints")])
def test_graph_judges_read_written_pairs(people, monkeypatch, judge, first):
    class Met(Exception):
        pass

    def meet(nodes, pairs, *more):
        assert pairs.inputFiles()  # else they are made again by every measure
        raise Met

    monkeypatch.setattr(X, first, meet)
    with pytest.raises(Met):
        getattr(X, judge)(*people, *people)


def test_graph_utility_learns_from_shared_numbers(spark):
    def graph(p, own):
        node = lambda i: (f"{p}{i}", "AB"[i % 2], f'{{"the size": {i % 2 * 10 + i / 1000}, "text": "{i % 2}", "{own}": {i % 2}, "flag": {"true" if i % 2 else "false"}}}')
        nodes = [node(i) for i in range(160)] + [(f"{p}x", "A", None), (f"{p}y", "A", "{}")]
        return spark.createDataFrame(nodes, "id string, type string, props string"), spark.createDataFrame([(f"{p}e", "E", f"{p}x", f"{p}y", "{}")], "id string, type string, source string, target string, props string")

    a, b = graph("a", "mine"), graph("b", "yours")
    assert X.numeric_properties(a[0]) == {"the size", "mine"}
    got = X.graph_tstr(*a, *b).first()
    assert min(got["tstr"], got["trtr"]) > 0.9


def test_corruption_breaks_rules_and_keeps_degrees(people):
    n, e = people
    bad = R.violate_ontology(n, e, ONTO, 3, 0.5)
    assert X.constraint_check(*bad, ONTO).count() >= 5
    swapped = R.rewire_preserving(e, 3, 1.0)
    count = lambda df: sorted(r["target"] for r in df.collect())
    assert count(swapped) == count(e) and not same(swapped, e)
    assert same(R.rewire(n, e, 3, 0.0), e) and R.drop_edges(e, 3, 0.2).count() == 8
    moved = R.rewire(n, e, 3, 1.0).join(e.select("id", F.col("target").alias("old")), "id")
    assert moved.where("target = old or target = source").count() == 0
    extra = R.inject_violations(e, 4, 1)
    assert X.constraint_check(n, extra, ONTO).where("kind = 'dangling_edge'").count() == 4


def test_preferential_attachment_has_hubs(spark):
    deg = [r["degree"] for r in X.both_ways(B.barabasi_albert(spark, 300, 2, 1)).groupBy("id").agg(F.count("*").alias("degree")).collect()]
    assert max(deg) > 4 * sum(deg) / len(deg)


def test_pairs_by_chance(spark):
    pairs = [(r["a"], r["b"]) for r in B.erdos_renyi(spark, 700, 0.03, 5).collect()]
    n = 700 * 699 / 2 * 0.03
    assert len(set(pairs)) == len(pairs) and all(0 <= a < b < 700 for a, b in pairs) and abs(len(pairs) - n) < 5 * n**0.5
    assert sorted((r["a"], r["b"]) for r in B.erdos_renyi(spark, 70, 1.0, 5).collect()) == [(a, b) for a in range(70) for b in range(a + 1, 70)]
    assert B.erdos_renyi(spark, 50, 0.0, 5).count() == 0 and B.erdos_renyi(spark, 1, 0.5, 5).count() == 0
    blocks = [(r["a"], r["b"]) for r in B.stochastic_blocks(spark, [30, 1, 50], 1.0, 0.1, 5).collect()]
    side = lambda x: 0 if x < 30 else 1 if x < 31 else 2
    assert len(set(blocks)) == len(blocks) and sum(side(a) == side(b) for a, b in blocks) == 30 * 29 / 2 + 50 * 49 / 2
    across = sum(side(a) != side(b) for a, b in blocks)
    assert abs(across - 0.1 * (30 + 1500 + 50)) < 60


def test_lfr_has_its_shape(spark):
    nodes, pairs = B.lfr(spark, 4000, 3, mixing=0.2, average_degree=8, min_community=100)
    comm = {r["id"]: r["community"] for r in nodes.collect()}
    edges = [(r["a"], r["b"]) for r in pairs.collect()]
    sizes = {}
    for c in comm.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert sorted(comm) == list(range(4000)) and min(sizes.values()) >= 100 and len(sizes) > 3
    assert len(set(edges)) == len(edges) and all(a < b for a, b in edges)
    outer = sum(comm[a] != comm[b] for a, b in edges) / len(edges)
    assert 0.12 < outer < 0.25 and 6 < 2 * len(edges) / 4000 < 9
    degree = {}
    for a, b in edges:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    assert max(degree.values()) > 5 * 8
    for n in (1, 5, 30):
        nodes, pairs = B.lfr(spark, n, 3)
        assert sorted(r["id"] for r in nodes.collect()) == list(range(n)) and pairs.where("a >= b").count() == 0


def plain_greedy(names, edges):
    """Communities by trying every union."""
    parts = [{x} for x in names]
    m = len(edges)

    def quality(ps):
        out = 0.0
        for p in ps:
            inside = sum(a in p and b in p for a, b in edges)
            ends = sum((a in p) + (b in p) for a, b in edges)
            out += inside / m - (ends / (2 * m)) ** 2
        return out

    best = quality(parts)
    while True:
        tried = [(quality([p for k, p in enumerate(parts) if k not in (i, j)] + [parts[i] | parts[j]]), -i, -j) for i in range(len(parts)) for j in range(i + 1, len(parts))]
        if not tried or max(tried)[0] <= best + 1e-12:
            return best
        best, i, j = max(tried)
        parts = [p for k, p in enumerate(parts) if k not in (-i, -j)] + [parts[-i] | parts[-j]]


@pytest.mark.parametrize("most", [500_000, 30])
def test_greedy_communities(spark, most):
    import random

    for seed in range(3):
        draw = random.Random(seed)
        names = [f"n{i:02d}" for i in range(24)]
        edges = sorted({tuple(sorted((a, b))) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and draw.random() < (0.6 if i // 8 == j // 8 else 0.05)})
        nodes = spark.createDataFrame([(x,) for x in [*names, "alone"]], "id string")
        pairs = spark.createDataFrame(edges, "a string, b string")
        got = X.greedy_communities(nodes, pairs, most)
        assert got.count() == 25 and got.where("id = 'alone' and community = 'alone'").count() == 1
        assert got.groupBy("community").agg(F.min("id").alias("least")).where("least <> community").count() == 0
        q = X.modularity(pairs, got).first()[0]
        assert q > 0 and (most < 100 or q >= plain_greedy(names, edges) - 0.02)  # contracted first, a graph this small is blurred
    assert X.greedy_communities(nodes.limit(2), pairs.limit(0)).count() == 2


def test_greedy_communities_ignore_size(spark):
    import random

    for seed in range(2):
        draw = random.Random(seed)
        edges = sorted({tuple(sorted((f"{g}{int(n * draw.random() ** 2):02d}", f"{g}{draw.randrange(n):02d}"))) for g, n in (("c", 24), ("a", 9), ("d", 2), ("b", 40)) for _ in range(2 * n)})
        edges = [e for e in edges if e[0] != e[1]] + [("e1", f"e2{i}") for i in range(5)]
        nodes = spark.createDataFrame([(x,) for x in sorted({x for e in edges for x in e}) + ["alone"]], "id string")
        pairs = spark.createDataFrame(edges, "a string, b string")
        whole = X.greedy_communities(nodes, pairs)
        for most in (1, 20, len(edges) - 1):
            assert same(X.greedy_communities(nodes, pairs, most), whole), most
        numbers = {x: i for i, x in enumerate(sorted({x for e in edges for x in e}))}
        into = X.merge_greedily({(numbers[a], numbers[b]): 1 for a, b in edges}, dict.fromkeys(range(len(numbers)), 0))
        assert {r["id"]: r["community"] for r in whole.collect()} == {x: sorted(numbers)[into[i]] for x, i in numbers.items()} | {"alone": "alone"}


def test_a_greedy_merge_does_not_walk_a_hub(monkeypatch):
    pushes, push = [0], X.heapq.heappush
    monkeypatch.setattr(X.heapq, "heappush", lambda *a: (pushes.__setitem__(0, pushes[0] + 1), push(*a))[1])
    hubs = {0: range(4, 700), 1: range(700, 1400), 2: range(1400, 2000)}  # three stars, whose hubs are all joined with 3
    edges = {(h, x): 1 for h, leaves in hubs.items() for x in leaves} | {(h, 3): 1 for h in hubs}
    into = X.merge_greedily(edges, dict.fromkeys(range(2000), 0))
    assert all(into[x] == into[h] for h, leaves in hubs.items() for x in leaves)
    assert len(set(into.values())) == 3
    assert pushes[0] < 10 * len(edges)


def test_greedy_merges_are_those_of_the_definition():
    import random

    def plain(edges, loops):
        m2, of = 2 * (sum(edges.values()) + sum(loops.values())), {i: i for i in loops}
        a = {i: 2 * loops[i] + sum(w for e, w in edges.items() if i in e) for i in loops}
        joined = dict(edges)
        while joined:
            g, i, j = min((a[i] * a[j] - m2 * w, i, j) for (i, j), w in joined.items())
            if g >= 0:
                break
            a[i] += a.pop(j)
            of = {x: i if c == j else c for x, c in of.items()}
            moved = [(sorted(i if x == j else x for x in e), w) for e, w in joined.items()]
            joined = {}
            for (x, y), w in moved:
                if x != y:
                    joined[x, y] = joined.get((x, y), 0) + w
        return of

    for seed in range(300):
        draw = random.Random(seed)
        n = draw.choice([2, 5, 12, 30])
        edges = {tuple(sorted(e)): draw.randint(1, 1 + seed % 3) for e in ((int(n * draw.random() ** 2), draw.randrange(n)) for _ in range(3 * n)) if e[0] != e[1]}
        loops = {i: draw.randint(0, seed % 2) for i in range(n)}
        assert X.merge_greedily(edges, loops) == plain(edges, loops), seed


def test_engines(spark, people):
    n, e = people
    for asked in ({"topology": t} for t in ("barabasi_albert", "watts_strogatz", "erdos_renyi", "stochastic_block_model", "lfr")):
        nodes, edges = B.build(spark, 40, 3, ONTO, **asked)
        assert nodes.count() == 40 and {r["type"] for r in nodes.collect()} == {"P", "C"}
        assert X.constraint_check(nodes.withColumn("props", F.lit('{"age":3}')), edges, ONTO).count() == 0
    assert B.build(spark, 25, 3, sample=people)[0].count() == 25
    with pytest.raises(ValueError):
        B.build(spark, 5, 3, ONTO, topology="odd")
    with pytest.raises(ValueError):
        B.build(spark, 5, 3, topology="lfr")


def test_alignment_finds_every_best_match(spark):
    import random

    draw = random.Random(4)
    words = ["".join(draw.choice("abcde") for _ in range(draw.randint(1, 7))) for _ in range(30)] + [""]
    name = lambda: " ".join(draw.choice(words) for _ in range(draw.randint(1, 3)))
    left, right = ([name() for _ in range(60)] for _ in range(2))
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "label string")
    every = frame(left).distinct().withColumnRenamed("label", "source").crossJoin(frame(right).distinct().withColumnRenamed("label", "target")).withColumn("score", S.lexical_score(F.col("source"), F.col("target")))
    want = {}
    for r in every.where("score >= 0.3").collect():
        want[r["source"]] = max(want.get(r["source"], (0, "")), (r["score"], r["target"]), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
    got = {r["source"]: (r["score"], r["target"]) for r in B.align(frame(left), frame(right)).collect()}
    assert {k: round(v[0], 9) for k, v in got.items()} == {k: round(v[0], 9) for k, v in want.items()}


def test_walks_are_simple(people):
    n, e = people
    p = X.to_undirected(n, e)
    w = B.sample_paths(p, 30, 2, 4)
    assert w.count() and w.where("size(array_distinct(path)) <> 3").count() == 0
    got = B.qa_checks(w.select("path", F.element_at("path", -1).alias("answer")), n, p).first()
    assert got["answerable"] == got["multi_hop"] == got["grounded"] == 1.0


@pytest.fixture(scope="module")
def odd_people(spark):
    n = spark.createDataFrame([('a "quoted" <id>', "P & Q", '{"text":"line\\n\\"two\\" \\\\ <b>&\\t,;\\u0001","n":-3,"x":1.5,"yes":true,"none":null}'), ("b", "C", "{}"), ("c", "C", '{"text":"plain"}')], "id string, type string, props string")
    e = spark.createDataFrame([("e 1", "KNOWS", 'a "quoted" <id>', "b", '{"since":"2020-01-02T03:04:05"}'), ("e2", "AT", "b", "c", "{}")], "id string, type string, source string, target string, props string")
    return n.cache(), e.cache()


def document(df):
    return "\n".join(r["value"] for r in df.orderBy("part").collect())


@pytest.mark.parametrize("kind", writers.GRAPH_FORMATS)
def test_graph_formats_are_written(people, odd_people, kind, tmp_path):
    for i, g in enumerate((people, odd_people)):
        made = writers.write_graph(*g, ONTO, kind, str(tmp_path / f"{kind}{i}"))
        assert made["format"] == kind and made["rows"] == g[0].count() + g[1].count()
        read = g[0].sparkSession.read
        assert (read.parquet if kind in ("gnn", "parquet") else read.text)(made["path"]).count() > 0


def test_jsonld_and_rdfxml_hold_the_triples(odd_people):
    import json
    import xml.etree.ElementTree as ET

    t = writers.triples(*odd_people)
    want = {(r["s"].strip("<>"), r["p"].strip("<>"), r["o"]) for r in t.collect()}
    lines = {r["value"] for r in writers.ntriples(t).collect()}
    assert len(lines) == len(want) and not any("\n" in x for x in lines)
    found = set()
    for node in json.loads(document(writers.jsonld(t))):
        for key, values in node.items():
            if key == "@id":
                continue
            for v in values:
                if key == "@type":
                    found.add((node["@id"], writers.RDF + "type", ("iri", v)))
                else:
                    found.add((node["@id"], key, ("iri", v["@id"]) if "@id" in v else (v.get("@type", ""), v["@value"])))
    plain = {(s, p, ("iri", o.strip("<>")) if o[0] != '"' else ((o.rsplit("^^<", 1)[1][:-1] if o.endswith(">") else ""), json.loads(o.rsplit("^^<", 1)[0] if o.endswith(">") else o))) for s, p, o in want}
    assert found == plain
    root, found, r = ET.fromstring(document(writers.rdfxml(t))), set(), "{" + writers.RDF + "}"
    for node in root:
        s = node.get(r + "about") or "_:" + node.get(r + "nodeID")
        for child in node:
            o = child.get(r + "resource") or (("_:" + child.get(r + "nodeID")) if child.get(r + "nodeID") else None)
            found.add((s, child.tag[1:].replace("}", ""), ("iri", o) if o else (child.get(r + "datatype", ""), child.text or "")))
    assert found == {(s, p, (k, v.replace("\u0001", "\ufffd") if k != "iri" else v)) for s, p, (k, v) in plain}


def test_xml_graphs_parse_and_come_back(spark, odd_people, tmp_path):
    import json
    import xml.etree.ElementTree as ET

    n, e = odd_people
    doc = document(writers.graphml(n, e))
    root = ET.fromstring(doc)
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    declared = {k.get("id") for k in root.findall(ns + "key")}
    assert {d.get("key") for d in root.iter(ns + "data")} <= declared and len(root[-1].findall(ns + "node")) == 3
    (tmp_path / "g.graphml").write_text(doc)
    nodes, edges = readers.scan_graphml(spark, str(tmp_path / "g.graphml"))
    back = {r["id"]: (r["type"], json.loads(r["props"])) for r in nodes.collect()}
    assert back['a "quoted" <id>'][0] == "P & Q" and back['a "quoted" <id>'][1]["n"] == "-3" and back["c"] == ("C", {"text": "plain"})
    assert {(r["id"], r["type"], r["source"], r["target"]) for r in edges.collect()} == {("e 1", "KNOWS", 'a "quoted" <id>', "b"), ("e2", "AT", "b", "c")}
    root = ET.fromstring(document(writers.gexf(n, e)))
    values = [x.get("value") for x in root.iter("{http://gexf.net/1.3}attvalue")]
    assert "1.5" in values and "plain" in values and "2020-01-02T03:04:05" in values


def test_neo4j_files_hold_nodes_edges_and_properties(odd_people):
    import csv
    import io

    files = {}
    for r in writers.neo4j_csv(*odd_people).orderBy("file", "part", "id").collect():
        files.setdefault(r["file"], []).append(r["value"])
    tables = {k: list(csv.reader(io.StringIO("\n".join(v)))) for k, v in files.items()}
    assert set(tables) == {"nodes_P_Q.csv", "nodes_C.csv", "edges_KNOWS.csv", "edges_AT.csv"}
    assert tables["nodes_C.csv"] == [["id:ID", ":LABEL", "text"], ["b", "C", ""], ["c", "C", "plain"]]
    assert tables["edges_KNOWS.csv"] == [[":START_ID", ":END_ID", ":TYPE", "since"], ['a "quoted" <id>', "b", "KNOWS", "2020-01-02T03:04:05"]]
    assert tables["nodes_P_Q.csv"][0] == ["id:ID", ":LABEL", "n", "none", "text", "x", "yes"] and tables["nodes_P_Q.csv"][1][4] == 'line\n"two" \\ <b>&\t,;\x01'


def test_templates(spark):
    from tessera.operators import templates

    for key, t in templates.TEMPLATES.items():
        df = templates.generate(spark, key, 3, 50)
        assert df.count() == 50 and df.columns == [f.name for f in t.fields]
    with pytest.raises(ValueError):
        templates.generate(spark, "odd", 3)


def test_reports_have_every_judge_that_applies(spark, rows, people):
    t = rows.withColumn("y", F.pmod("k", F.lit(2)).cast("string")).drop("text")
    scores, total = evaluate.run(t, t, key="k", sensitive="cat", outcome="num", target="y", task="tabular_classification", columns={"label": "y"})
    got = {r["dimension"]: r["score"] for r in scores.collect()}
    assert set(got) == {"diversity", "fidelity", "privacy", "utility", "bias", "task_quality"} and got["fidelity"] == 1.0 and got["privacy"] == 0.0 and got["task_quality"] > 0.99
    assert 0 <= total.first()["overall"] <= 1
    assert evaluate.run(t, task="chat")[0].where("dimension = 'task_quality'").count() == 0  # no column of a chat
    over, _ = evaluate.run(t, overrides={"diversity": 0.25})
    assert over.first()["score"] == 0.25
    graphs = {r["dimension"]: r["score"] for r in evaluate.run_graph(people, people, ONTO)[0].collect()}
    assert set(graphs) == {"graph_connectivity", "graph_ontology", "graph_privacy", "graph_structure", "graph_utility"}
    assert graphs["graph_structure"] == 1.0 and graphs["graph_ontology"] == 1.0 and graphs["graph_privacy"] == 0.0


def test_connectivity_and_overlap_of_a_small_graph(people):
    n, e = people
    got = X.connectivity(n, e, ONTO).first()
    assert (got["giant_fraction"], got["isolated_fraction"], got["relation_coverage"], got["node_type_coverage"]) == (8 / 11, 0.0, 1.0, 1.0) and abs(got["score"] - (8 / 11 + 3) / 4) < 1e-12
    assert tuple(X.edge_overlap(n, e, n, e.where("type = 'AT'")).first()) == (10, 8)


def test_unknown_formats(people, rows, tmp_path):
    with pytest.raises(ValueError):
        writers.export_graph(*people, ONTO, "odd")
    with pytest.raises(ValueError):
        writers.export(rows, str(tmp_path / "x"), "odd")
    with pytest.raises(ValueError):
        readers.scan(rows.sparkSession, "x.odd")


def test_upsert_and_replace(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert same(metadata.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], t.schema), ["k"]), spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], t.schema))
    assert same(metadata.delete(t, t.where("k = 1").select("k")), t.where("k = 2"))


def test_scalars(spark):
    df = spark.createDataFrame([("How many?", "WorksAt", "   x  ", None)], "q string, l string, s string, n string")
    r = df.select(S.question_type(F.col("q")), S.tokenize_label(F.col("l")), S.strip(F.col("s")), S.nonempty(F.col("n")), S.clamp01(F.lit(float("nan"))), S.bigram_overlap(F.col("n"), F.col("q"))).first()
    assert list(r) == ["how", ["works", "at"], "x", False, 0.0, 0.0]


def test_stream(spark, tmp_path, rows):
    from tessera.streaming.perturb_stream import perturb_stream

    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stats = P.column_stats(rows, ["num"])
    for i, (family, kind, intensity) in enumerate([("edge", "nulls", 0.5), ("noise", "gaussian", 0.3), ("noise", "uniform", 0.3), ("outlier", None, 0.4), ("edge", "boundary", 0.4), ("drift", "covariate", 0.5)]):
        out = str(tmp_path / f"out{i}")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        perturb_stream(stream, lambda df, n, out=out: df.write.mode("append").parquet(out), str(tmp_path / f"cp{i}"), family, "num", ["k"], 3, intensity, kind, stats).awaitTermination()
        near = lambda df: sorted((r["k"], round(r["num"] or -1.0, 9)) for r in df.collect())
        assert near(spark.read.parquet(out)) == near(P.perturb(rows, family, "num", ["k"], 3, intensity, kind))


@pytest.mark.parametrize("family,kind,column", [("noise", "swap", "cat"), ("noise", None, "cat"), ("drift", "temporal", "num"), ("drift", "concept", "cat"), ("bias", None, "cat"), ("noise", "gaussian", "num")])
def test_streams_refuse_what_needs_the_whole_table(spark, tmp_path, rows, family, kind, column):
    from tessera.streaming.perturb_stream import perturb_stream

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        perturb_stream(stream, lambda df, n: None, str(tmp_path / "cp"), family, column, ["k"], 3, 0.5, kind)


def test_subjects_of_many_triples_have_blocks(spark, monkeypatch):
    import json

    monkeypatch.setattr(writers, "TRIPLES", 10)
    n = spark.createDataFrame([(f"n{i}", "T", "{}") for i in range(60)], "id string, type string, props string")
    e = spark.createDataFrame([(f"e{i}", "R", "n0", f"n{i}", "{}") for i in range(1, 60)], "id string, type string, source string, target string, props string")
    t = writers.triples(n, e)
    blocks = [r["value"] for r in writers.turtle(t).collect()]
    own = [b for b in blocks if b.startswith(f"<{writers.BASE}node/n0> ")]
    assert len(own) > 3 and sum(b.count(f"<{writers.BASE}node/n") - 1 for b in own) == 59
    nodes = [x for x in json.loads(document(writers.jsonld(t))) if x.get("@id", "").endswith("node/n0")]
    assert len(nodes) == len(own) and sum(len(x.get(f"{writers.BASE}relation/R", [])) for x in nodes) == 59


def test_entropy_of_groups(spark):
    import math

    sizes = [5, 1, 14]
    p = [x / 20 for x in sizes]
    want = -sum(x * math.log(x) for x in p) / math.log(3)
    df = spark.createDataFrame([(x,) for x in sizes], "n long")
    assert abs(df.agg(judges.entropy(F.col("n"))).first()[0] - want) < 1e-12
    assert df.limit(1).agg(judges.entropy(F.col("n"))).first()[0] == 0.0 and df.limit(0).agg(judges.entropy(F.col("n"))).first()[0] == 0.0
