"""Queries of the graph operators, over two graphs made of the tables.

The party graph has regions, nations, customers and suppliers; the parts graph joins parts on successive lines of an order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.rng import u01_sql as u
from tessera.operators import graph as X
from tessera.operators import graph_build as B
from tessera.operators import graph_perturb as R
from tessera.operators.graph import EdgeType, NodeType, Ontology, Prop
from tessera.plans.metrics import _LEX_TOK
from tessera.plans.registry import query, read
from tessera.plans.tables import r6, rounded

ONTOLOGY = Ontology(
    (NodeType("Region", (Prop("name"),)), NodeType("Nation", (Prop("name"),)), NodeType("Customer", (Prop("name"), Prop("segment", constraints={"choices": ["BUILDING", "MACHINERY", "AUTOMOBILE"]}), Prop("balance", "float", constraints={"min": 0.0, "max": 9000.0}))), NodeType("Supplier", (Prop("name"), Prop("balance", "float", constraints={"min": 0.0})))),
    (EdgeType("IN_REGION", "Nation", "Region"), EdgeType("CUSTOMER_OF", "Customer", "Nation", max_per_source=1), EdgeType("SUPPLIER_OF", "Supplier", "Nation")),
)


def party(spark, d) -> tuple[DataFrame, DataFrame]:
    r, n, c, s = (read(spark, d, t) for t in ("region", "nation", "customer", "supplier"))
    node = lambda df, p, k, kind, *props: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.lit(kind).alias("type"), F.to_json(F.struct(*props)).alias("props"))
    nodes = node(r, "r", "r_regionkey", "Region", F.col("r_name").alias("name")).union(node(n, "n", "n_nationkey", "Nation", F.col("n_name").alias("name")))
    nodes = nodes.union(node(c, "c", "c_custkey", "Customer", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))).union(node(s, "s", "s_suppkey", "Supplier", F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))
    edge = lambda df, kind, a, x, b, y: df.select(F.concat(F.lit(f"{kind}:"), F.col(x).cast("string")).alias("id"), F.lit(kind).alias("type"), F.concat(F.lit(a), F.col(x).cast("string")).alias("source"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target"), F.lit("{}").alias("props"))
    return nodes, edge(n, "IN_REGION", "n", "n_nationkey", "r", "n_regionkey").union(edge(c, "CUSTOMER_OF", "c", "c_custkey", "n", "c_nationkey")).union(edge(s, "SUPPLIER_OF", "s", "s_suppkey", "n", "s_nationkey"))


NODES = """(SELECT 'r' || r_regionkey AS id, 'Region' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, 'Nation' FROM nation UNION ALL SELECT 'c' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 's' || s_suppkey, 'Supplier' FROM supplier)"""
EDGES = """(SELECT 'IN_REGION:' || n_nationkey AS id, 'IN_REGION' AS type, 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation UNION ALL SELECT 'CUSTOMER_OF:' || c_custkey, 'CUSTOMER_OF', 'c' || c_custkey, 'n' || c_nationkey FROM customer
UNION ALL SELECT 'SUPPLIER_OF:' || s_suppkey, 'SUPPLIER_OF', 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


def parts(spark, d) -> tuple[DataFrame, DataFrame]:
    li = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    nxt = li.select("l_orderkey", "l_linenumber", "p", F.lead("p").over(W.partitionBy("l_orderkey").orderBy("l_linenumber")).alias("q")).where("q is not null")
    edges = nxt.select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.lit("WITH").alias("type"), F.col("p").cast("string").alias("source"), F.col("q").cast("string").alias("target"), F.lit("{}").alias("props"))
    return read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("type"), F.lit("{}").alias("props")), edges


PEDGES = "(SELECT l_orderkey || ':' || l_linenumber AS id, 'WITH' AS type, p::VARCHAR AS source, q::VARCHAR AS target FROM (SELECT l_orderkey, l_linenumber, p, lead(p) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS q FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)) WHERE q IS NOT NULL)"
PNODES = "(SELECT p_partkey::VARCHAR AS id, p_type AS type FROM part)"
PAIRS = f"pairs AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM {PEDGES} WHERE source <> target AND source IN (SELECT id FROM {PNODES}) AND target IN (SELECT id FROM {PNODES})), both_ways AS (SELECT a AS id, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs), deg AS (SELECT n.id, count(other) AS degree FROM {PNODES} n LEFT JOIN both_ways USING (id) GROUP BY 1)"


@query("to_undirected", f"WITH {PAIRS} SELECT a, b FROM pairs")
def to_undirected(spark, d):
    return X.to_undirected(*parts(spark, d))


@query("degree", f"WITH {PAIRS} SELECT id, degree FROM deg")
def degree(spark, d):
    n, e = parts(spark, d)
    return X.degree(n, X.to_undirected(n, e))


@query("multi_degree", f"SELECT n.id, count(e.id) AS degree FROM {PNODES} n LEFT JOIN (SELECT source AS id FROM {PEDGES} UNION ALL SELECT target FROM {PEDGES}) e ON n.id = e.id GROUP BY 1")
def multi_degree(spark, d):
    return X.incident(*parts(spark, d))


_COMP = f"""party AS (SELECT least(source, target) AS a, greatest(source, target) AS b FROM {EDGES}), ways AS (SELECT a AS x, b AS y FROM party UNION ALL SELECT b, a FROM party)"""


@query("connected_components", f"""WITH n AS (SELECT n_nationkey AS k, n_regionkey AS g FROM nation), c AS (SELECT 'r' || r_regionkey AS id, r_regionkey AS g FROM region UNION ALL SELECT 'n' || k, g FROM n
UNION ALL SELECT 'c' || c_custkey, g FROM customer JOIN n ON k = c_nationkey UNION ALL SELECT 's' || s_suppkey, g FROM supplier JOIN n ON k = s_nationkey) SELECT id, min(id) OVER (PARTITION BY g) AS component FROM c""")
def connected_components(spark, d):
    n, e = party(spark, d)
    return X.components(n, X.to_undirected(n, e))


@query("giant_fraction", """WITH n AS (SELECT n_nationkey AS k, n_regionkey AS g FROM nation), c AS (SELECT r_regionkey AS g FROM region UNION ALL SELECT g FROM n UNION ALL SELECT g FROM customer JOIN n ON k = c_nationkey UNION ALL SELECT g FROM supplier JOIN n ON k = s_nationkey)
SELECT round(max(m) / sum(m), 6)::DOUBLE AS giant_fraction FROM (SELECT count(*) AS m FROM c GROUP BY g)""")
def giant_fraction(spark, d):
    return rounded(X.connectivity(*party(spark, d), ONTOLOGY).select("giant_fraction"), "giant_fraction")


@query("isolated_fraction", f"WITH {PAIRS} SELECT round(avg(CASE WHEN degree = 0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS isolated_fraction FROM deg")
def isolated_fraction(spark, d):
    n, e = parts(spark, d)
    return X.degree(n, X.to_undirected(n, e)).agg(r6(F.avg((F.col("degree") == 0).cast("double")), "isolated_fraction"))


@query("relation_coverage", f"SELECT round(count(DISTINCT type) / 3.0, 6)::DOUBLE AS relation_coverage FROM {EDGES} WHERE type IN ('IN_REGION', 'CUSTOMER_OF', 'SUPPLIER_OF')")
def relation_coverage(spark, d):
    return rounded(X.connectivity(*party(spark, d), ONTOLOGY).select("relation_coverage"), "relation_coverage")


@query("node_type_coverage", f"SELECT round(count(DISTINCT type) / 4.0, 6)::DOUBLE AS node_type_coverage FROM {NODES}")
def node_type_coverage(spark, d):
    return rounded(X.connectivity(*party(spark, d), ONTOLOGY).select("node_type_coverage"), "node_type_coverage")


@query("connectivity_score", """WITH n AS (SELECT n_nationkey AS k, n_regionkey AS g FROM nation), c AS (SELECT r_regionkey AS g FROM region UNION ALL SELECT g FROM n UNION ALL SELECT g FROM customer JOIN n ON k = c_nationkey UNION ALL SELECT g FROM supplier JOIN n ON k = s_nationkey),
f AS (SELECT max(m) / sum(m) AS giant FROM (SELECT count(*) AS m FROM c GROUP BY g)), i AS (SELECT (SELECT count(*) FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)) / (SELECT count(*) FROM c)::DOUBLE AS alone)
SELECT round(giant, 6)::DOUBLE AS giant_fraction, round(alone, 6)::DOUBLE AS isolated_fraction, 1.0::DOUBLE AS relation_coverage, 1.0::DOUBLE AS node_type_coverage, round((giant + (1 - alone) + 2) / 4, 6)::DOUBLE AS score FROM f, i""")
def connectivity_score(spark, d):
    return rounded(X.connectivity(*party(spark, d), ONTOLOGY), "giant_fraction", "isolated_fraction", "relation_coverage", "node_type_coverage", "score")


_TRI = """tri AS (SELECT unnest([x.a, x.b, y.b]) AS id FROM pairs x JOIN pairs y ON x.b = y.a JOIN pairs z ON z.a = x.a AND z.b = y.b), t AS (SELECT deg.id, degree, (SELECT count(*) FROM tri WHERE tri.id = deg.id) AS triangles FROM deg)"""


@query("triangles", f"WITH {PAIRS}, {_TRI} SELECT id, triangles FROM t WHERE triangles > 0")
def triangles(spark, d):
    n, e = parts(spark, d)
    p = X.to_undirected(n, e)
    return X.triangles(p, X.degree(n, p))


@query("clustering", f"WITH {PAIRS}, {_TRI} SELECT id, round(CASE WHEN degree < 2 THEN 0 ELSE 2 * triangles / (degree * (degree - 1))::DOUBLE END, 6) AS clustering FROM t")
def clustering(spark, d):
    n, e = parts(spark, d)
    return X.clustering(n, X.to_undirected(n, e)).select("id", r6("clustering", "clustering"))


@query("average_clustering", f"WITH {PAIRS}, {_TRI} SELECT round(avg(CASE WHEN degree < 2 THEN 0 ELSE 2 * triangles / (degree * (degree - 1))::DOUBLE END), 6) AS average_clustering FROM t")
def average_clustering(spark, d):
    n, e = parts(spark, d)
    return X.clustering(n, X.to_undirected(n, e)).agg(r6(F.avg("clustering"), "average_clustering"))


@query("avg_neighbour_degree", f"WITH {PAIRS} SELECT deg.id, round(coalesce(avg(o.degree), 0), 6)::DOUBLE AS neighbour_degree FROM deg LEFT JOIN both_ways b ON deg.id = b.id LEFT JOIN deg o ON o.id = b.other GROUP BY 1")
def avg_neighbour_degree(spark, d):
    n, e = parts(spark, d)
    return rounded(X.neighbour_degree(n, X.to_undirected(n, e)), "neighbour_degree")


@query("degree_assortativity", f"WITH {PAIRS} SELECT round(corr(x.degree, y.degree), 6) AS assortativity FROM both_ways b JOIN deg x ON x.id = b.id JOIN deg y ON y.id = b.other")
def degree_assortativity(spark, d):
    n, e = parts(spark, d)
    return rounded(X.assortativity(n, X.to_undirected(n, e)), "assortativity")


@query("degree_ks", f"""WITH {PAIRS}, k AS (SELECT degree AS x, (SELECT type FROM {PNODES} p WHERE p.id = deg.id) AS type FROM deg), n AS (SELECT x, sum(CASE WHEN type LIKE 'ECONOMY%' THEN 1 ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN type LIKE 'ECONOMY%' THEN 0 ELSE 1 END)::DOUBLE AS r FROM k GROUP BY x)
SELECT 'degree' AS "column", round(max(abs(cs / ns - cr / nr)), 6) AS ks FROM (SELECT sum(s) OVER w AS cs, sum(r) OVER w AS cr, sum(s) OVER () AS ns, sum(r) OVER () AS nr FROM n WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING))""")
def degree_ks(spark, d):
    from tessera.operators.judges import ks

    n, e = parts(spark, d)
    k = X.degree(n, X.to_undirected(n, e)).join(n.select("id", "type"), "id")
    return rounded(ks(k.where("type like 'ECONOMY%'"), k.where("type not like 'ECONOMY%'"), ["degree"]), "ks")


@query("modularity", f"""WITH {PAIRS}, l AS (SELECT id, type AS c FROM {PNODES}), m AS (SELECT count(*)::DOUBLE AS m FROM pairs), o AS (SELECT x.c, y.c AS oc FROM both_ways b JOIN l x ON x.id = b.id JOIN l y ON y.id = b.other)
SELECT round(sum(inside / (2 * m) - (deg / (2 * m)) * (deg / (2 * m))), 6)::DOUBLE AS modularity FROM (SELECT c, count(*)::DOUBLE AS deg, (count(*) FILTER (WHERE c = oc))::DOUBLE AS inside FROM o GROUP BY c), m""")
def modularity(spark, d):
    n, e = parts(spark, d)
    return rounded(X.modularity(X.to_undirected(n, e), n.select("id", F.col("type").alias("community"))), "modularity")


@query("modularity_greedy")
def modularity_greedy(spark, d):
    n, e = party(spark, d)
    p = X.to_undirected(n, e)
    return rounded(X.modularity(p, X.greedy_communities(n, p)), "modularity")


def _propagated_sql(rounds: int) -> str:
    """CTEs of label propagation over the party graph, a round after another."""
    out = f"pr AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM {EDGES}), bw AS (SELECT a AS id, b AS other FROM pr UNION ALL SELECT b, a FROM pr), l0 AS (SELECT id, id AS c FROM {NODES})"
    for i in range(rounds):
        out += f", l{i + 1} AS (SELECT id, c FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, c) AS r FROM (SELECT bw.id, l.c FROM bw JOIN l{i} l ON l.id = bw.other UNION ALL SELECT id, c FROM l{i}) GROUP BY id, c) WHERE r = 1)"
    return out


@query("modularity_propagated", f"""WITH {_propagated_sql(8)}, m AS (SELECT count(*)::DOUBLE AS m FROM pr), o AS (SELECT x.c, y.c AS oc FROM bw JOIN l8 x ON x.id = bw.id JOIN l8 y ON y.id = bw.other)
SELECT round(sum(inside / (2 * m) - (deg / (2 * m)) * (deg / (2 * m))), 6)::DOUBLE AS modularity FROM (SELECT c, count(*)::DOUBLE AS deg, (count(*) FILTER (WHERE c = oc))::DOUBLE AS inside FROM o GROUP BY c), m""")
def modularity_propagated(spark, d):
    n, e = party(spark, d)
    p = X.to_undirected(n, e)
    return rounded(X.modularity(p, X.label_communities(n, p)), "modularity")


_SHORTEST = f"""WITH RECURSIVE g AS (SELECT 'r' || r_regionkey AS id, r_regionkey AS g FROM region UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
giant AS (SELECT g FROM (SELECT g, count(*) AS n, min(id) AS low FROM g GROUP BY 1) ORDER BY n DESC, low LIMIT 1), nd AS (SELECT id FROM g WHERE g IN (SELECT g FROM giant)), w AS (SELECT source AS a, target AS b FROM {EDGES} WHERE source IN (SELECT id FROM nd) UNION SELECT target, source FROM {EDGES} WHERE source IN (SELECT id FROM nd)),
d AS (SELECT id AS s, id AS t, 0 AS dist FROM nd UNION SELECT d.s, w.b, d.dist + 1 FROM d JOIN w ON w.a = d.t WHERE d.dist < 4), m AS (SELECT s, t, min(dist) AS dist FROM d GROUP BY 1, 2)
SELECT round(sum(dist) / ((SELECT count(*) FROM nd) * ((SELECT count(*) FROM nd) - 1))::DOUBLE, 6) AS average_path FROM m"""


@query("avg_shortest_path", _SHORTEST)
def avg_shortest_path(spark, d):
    n, e = party(spark, d)
    return rounded(X.average_path(n, X.to_undirected(n, e)), "average_path")


@query("laplacian_spectrum")
def laplacian_spectrum(spark, d):
    n, e = party(spark, d)
    values = X.spectrum(n, X.to_undirected(n, e))
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(values)], "place int, value double")


def _halves(spark, d):
    """Two graphs to compare: customers' side and suppliers' side of the party graph."""
    n, e = party(spark, d)
    return (n.where("type <> 'Supplier'"), e.where("type <> 'SUPPLIER_OF'")), (n.where("type <> 'Customer'"), e.where("type <> 'CUSTOMER_OF'"))


@query("spectral_distance")
def spectral_distance(spark, d):
    (a, ae), (b, be) = _halves(spark, d)
    return spark.createDataFrame([(round(X.spectral_distance(X.spectrum(a, X.to_undirected(a, ae)), X.spectrum(b, X.to_undirected(b, be))), 6),)], "distance double")


@query("structural_fidelity_score")
def structural_fidelity_score(spark, d):
    a, b = _halves(spark, d)
    return X.structural_fidelity(*a, *b)


def _prints_sql(p: str, nodes: str, edges: str) -> str:
    """CTEs of one graph: pairs, both ways, degrees, clustering and fingerprints, each named with a prefix."""
    return f"""{p}n AS (SELECT DISTINCT id FROM {nodes}), {p}p AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM {edges} WHERE source <> target AND source IN (SELECT id FROM {p}n) AND target IN (SELECT id FROM {p}n)),
{p}w AS (SELECT a AS id, b AS other FROM {p}p UNION ALL SELECT b, a FROM {p}p), {p}d AS (SELECT n.id, count(w.other) AS degree FROM {p}n n LEFT JOIN {p}w w ON w.id = n.id GROUP BY 1),
{p}t AS (SELECT id, count(*) AS triangles FROM (SELECT unnest([x.a, x.b, y.b]) AS id FROM {p}p x JOIN {p}p y ON x.b = y.a JOIN {p}p z ON z.a = x.a AND z.b = y.b) GROUP BY 1),
{p}c AS (SELECT d.id, degree, CASE WHEN degree < 2 THEN 0.0 ELSE 2 * coalesce(triangles, 0) / (degree * (degree - 1))::DOUBLE END AS clustering FROM {p}d d LEFT JOIN {p}t t ON t.id = d.id),
{p}f AS (SELECT c.id, md5(c.degree || '|' || coalesce(nds, '') || '|' || printf('%.2f', clustering::DOUBLE)) AS print FROM {p}c c LEFT JOIN (SELECT id, string_agg(nd || 'x' || k, ',' ORDER BY nd) AS nds FROM (SELECT w.id, d.degree AS nd, count(*) AS k FROM {p}w w JOIN {p}d d ON d.id = w.other GROUP BY 1, 2) GROUP BY 1) s ON s.id = c.id),
{p}e AS (SELECT least(x.degree, y.degree) AS x, greatest(x.degree, y.degree) AS y FROM {p}p p JOIN {p}d x ON x.id = p.a JOIN {p}d y ON y.id = p.b)"""


_TWO = _prints_sql("s", f"(SELECT id FROM {NODES} WHERE type <> 'Supplier')", f"(SELECT * FROM {EDGES} WHERE type <> 'SUPPLIER_OF')") + ", " + _prints_sql("r", f"(SELECT id FROM {NODES} WHERE type <> 'Customer')", f"(SELECT * FROM {EDGES} WHERE type <> 'CUSTOMER_OF')")


@query("graph_privacy_score", f"""WITH {_TWO}, h AS (SELECT (SELECT avg((print IN (SELECT print FROM rf))::INT) FROM sf) AS n, (SELECT avg((EXISTS (SELECT 1 FROM re WHERE re.x = se.x AND re.y = se.y))::INT) FROM se) AS e)
SELECT round(n, 6) AS node_hit_rate, round(e, 6) AS edge_hit_rate, round(1 - (n + e) / 2, 6) AS score FROM h""")
def graph_privacy_score(spark, d):
    a, b = _halves(spark, d)
    return rounded(X.graph_privacy(*a, *b), "node_hit_rate", "edge_hit_rate", "score")


@query("graph_fingerprint_match", f"WITH {_TWO} SELECT id FROM sf WHERE print IN (SELECT print FROM rf)")
def graph_fingerprint_match(spark, d):
    a, b = _halves(spark, d)
    own, ref = X.fingerprints(a[0], X.to_undirected(*a)), X.fingerprints(b[0], X.to_undirected(*b))
    return own.join(ref.select("print").distinct(), "print", "left_semi").select("id")


@query("graph_tstr")
def graph_tstr(spark, d):
    a, b = _halves(spark, d)
    return rounded(X.graph_tstr(*a, *b), "score", "tstr", "trtr")


@query("edge_endpoint_lookup", f"SELECT e.id, e.type, a.type AS source_type, b.type AS target_type FROM {EDGES} e LEFT JOIN {NODES} a ON a.id = e.source LEFT JOIN {NODES} b ON b.id = e.target")
def edge_endpoint_lookup(spark, d):
    return X.resolved(*party(spark, d)).select("id", "type", "source_type", "target_type")


@query("ontology_lookup", f"SELECT e.id, o.source_type, o.target_type FROM {EDGES} e LEFT JOIN (VALUES ('IN_REGION', 'Nation', 'Region'), ('CUSTOMER_OF', 'Customer', 'Nation'), ('SUPPLIER_OF', 'Supplier', 'Nation')) o(type, source_type, target_type) USING (type)")
def ontology_lookup(spark, d):
    _, e = party(spark, d)
    return e.join(F.broadcast(ONTOLOGY.edge_frame(spark).withColumnRenamed("name", "type")), "type", "left").select("id", "source_type", "target_type")


@query("dangling_edge_filter", f"SELECT id FROM {EDGES} WHERE source NOT LIKE 's%' AND target NOT LIKE 's%'")
def dangling_edge_filter(spark, d):
    n, e = party(spark, d)
    return X.dangling_filter(n.where("type <> 'Supplier'"), e).select("id")


_VIOL = """SELECT 'node' AS element, 'c' || c_custkey AS id, 'not_in_choices' AS kind, 'segment' AS property FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') UNION ALL
SELECT 'node', 'c' || c_custkey, CASE WHEN c_acctbal < 0 THEN 'below_min' ELSE 'above_max' END, 'balance' FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000 UNION ALL SELECT 'node', 's' || s_suppkey, 'below_min', 'balance' FROM supplier WHERE s_acctbal < 0"""


@query("constraint_check", _VIOL)
def constraint_check(spark, d):
    return X.constraint_check(*party(spark, d), ONTOLOGY)


@query("ontology_pass_rate", f"""SELECT n AS n_checks, n - f AS n_passed, round((n - f) / n::DOUBLE, 6) AS rate FROM (SELECT (SELECT 2 * count(*) FROM region) + (SELECT 3 * count(*) FROM nation) + (SELECT 5 * count(*) FROM customer) + (SELECT 4 * count(*) FROM supplier) AS n), (SELECT count(*) AS f FROM ({_VIOL}))""")
def ontology_pass_rate(spark, d):
    return rounded(X.ontology_pass_rate(*party(spark, d), ONTOLOGY), "rate")


@query("shacl_validate", f"SELECT kind, count(*) AS n FROM ({_VIOL}) GROUP BY 1")
def shacl_validate(spark, d):
    """Shapes of the ontology (presence, datatype, class, bounds) as counts of broken rules."""
    return X.constraint_check(*party(spark, d), ONTOLOGY).groupBy("kind").agg(F.count("*").alias("n"))


@query("graph_metrics", f"SELECT 'node' AS element, type, count(*) AS n FROM {NODES} GROUP BY 2 UNION ALL SELECT 'node', NULL, count(*) FROM {NODES} UNION ALL SELECT 'edge', type, count(*) FROM {EDGES} GROUP BY 2 UNION ALL SELECT 'edge', NULL, count(*) FROM {EDGES}")
def graph_metrics(spark, d):
    return X.graph_metrics(*party(spark, d))


@query("graph_topdegree_subgraph", f"""WITH g AS (SELECT n.id, count(e.id) AS k FROM {PNODES} n LEFT JOIN (SELECT source AS id FROM {PEDGES} UNION ALL SELECT target FROM {PEDGES}) e ON n.id = e.id GROUP BY 1), t AS (SELECT id FROM g ORDER BY k DESC, id LIMIT 50)
SELECT (SELECT count(*) FROM t) AS n_nodes, count(*) AS n_edges FROM {PEDGES} WHERE source IN (SELECT id FROM t) AND target IN (SELECT id FROM t)""")
def graph_topdegree_subgraph(spark, d):
    n, e = X.topdegree_subgraph(*parts(spark, d), 50)
    return n.agg(F.count("*").alias("n_nodes")).crossJoin(e.agg(F.count("*").alias("n_edges")))


@query("infer_ontology", f"""SELECT 'node' AS kind, type AS name, CASE type WHEN 'Customer' THEN 'balance,name,segment' WHEN 'Supplier' THEN 'balance,name' ELSE 'name' END AS detail FROM {NODES} GROUP BY type
UNION ALL SELECT 'edge', e.type, a.type || '->' || b.type FROM {EDGES} e JOIN {NODES} a ON a.id = e.source JOIN {NODES} b ON b.id = e.target GROUP BY 2, 3""")
def infer_ontology(spark, d):
    return X.infer_ontology(*party(spark, d))


@query("triple_sample", f"""SELECT e.id, '(' || a.type || ' ' || e.source || ') -[' || e.type || ']-> (' || b.type || ' ' || e.target || ')' AS triple FROM (SELECT * FROM {EDGES} ORDER BY {u(3, 'triple', 'id')}, id LIMIT 20) e JOIN {NODES} a ON a.id = e.source JOIN {NODES} b ON b.id = e.target""")
def triple_sample(spark, d):
    return X.triple_sample(*party(spark, d), 20, 3)


@query("verbatim_subgraph_overlap", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM nation) AS n_shared")
def verbatim_subgraph_overlap(spark, d):
    a, b = _halves(spark, d)
    return X.edge_overlap(*a, *b)


# --- corruption ---------------------------------------------------------------------------------------------------------
@query("graph_dropout_edges", f"SELECT id FROM {EDGES} WHERE id NOT IN (SELECT id FROM {EDGES} ORDER BY {u(8, 'drop:edge', 'id')}, id LIMIT (SELECT round_even(0.2 * count(*), 0)::BIGINT FROM {EDGES}))")
def graph_dropout_edges(spark, d):
    return R.drop_edges(party(spark, d)[1], 8, 0.2).select("id")


_LEFT = f"(SELECT id FROM {NODES} WHERE id NOT IN (SELECT id FROM {NODES} ORDER BY {u(8, 'drop:node', 'id')}, id LIMIT (SELECT round_even(0.2 * count(*), 0)::BIGINT FROM {NODES})))"


@query("graph_dropout_nodes", f"SELECT 'node' AS part, id FROM {_LEFT} UNION ALL SELECT 'edge', id FROM {EDGES} WHERE source IN (SELECT id FROM {_LEFT}) AND target IN (SELECT id FROM {_LEFT})")
def graph_dropout_nodes(spark, d):
    n, e = R.drop_nodes(*party(spark, d), 8, 0.2)
    return n.select(F.lit("node").alias("part"), "id").union(e.select(F.lit("edge"), "id"))


@query("graph_dropout_both", f"""WITH e AS (SELECT id FROM {EDGES} WHERE source IN (SELECT id FROM {_LEFT}) AND target IN (SELECT id FROM {_LEFT})), k AS (SELECT round_even(0.2 * count(*), 0)::BIGINT AS k FROM e)
SELECT 'node' AS part, id FROM {_LEFT} UNION ALL SELECT 'edge', id FROM e WHERE id NOT IN (SELECT id FROM e ORDER BY {u(8, 'drop:edge', 'id')}, id LIMIT (SELECT k FROM k))""")
def graph_dropout_both(spark, d):
    n, e = R.drop_both(*party(spark, d), 8, 0.2)
    return n.select(F.lit("node").alias("part"), "id").union(e.select(F.lit("edge"), "id"))


@query("graph_rewire", f"""WITH p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM {NODES}), n AS (SELECT count(*) AS n FROM p), h AS (SELECT id FROM {EDGES} ORDER BY {u(8, 'rewire', 'id')}, id LIMIT (SELECT round_even(0.3 * count(*), 0)::BIGINT FROM {EDGES})),
x AS (SELECT e.id, e.source, least(a.i, b.i) AS lo, greatest(a.i, b.i) AS hi, floor({u(8, 'rewire:to', 'e.id')} * (n - 2))::BIGINT AS k FROM {EDGES} e JOIN h ON h.id = e.id JOIN p a ON a.id = e.source JOIN p b ON b.id = e.target, n),
y AS (SELECT id, source, CASE WHEN k + (CASE WHEN k >= lo THEN 1 ELSE 0 END) >= hi THEN k + (CASE WHEN k >= lo THEN 1 ELSE 0 END) + 1 ELSE k + (CASE WHEN k >= lo THEN 1 ELSE 0 END) END AS k FROM x)
SELECT y.id, y.source, p.id AS target FROM y JOIN p ON p.i = y.k UNION ALL SELECT id, source, target FROM {EDGES} WHERE id NOT IN (SELECT id FROM h)""")
def graph_rewire(spark, d):
    return R.rewire(*party(spark, d), 8, 0.3).select("id", "source", "target")


@query("graph_rewire_degree_preserving", f"""WITH h AS (SELECT id, type, target, {u(8, 'swap', 'id')} AS u FROM {EDGES} ORDER BY u, id LIMIT (SELECT round_even(0.3 * count(*), 0)::BIGINT // 2 * 2 FROM {EDGES})), i AS (SELECT *, row_number() OVER (ORDER BY type, u, id) - 1 AS i FROM h),
s AS (SELECT x.id, y.target FROM i x JOIN i y ON x.i // 2 = y.i // 2 AND x.i <> y.i AND x.type = y.type) SELECT e.id, e.source, coalesce(s.target, e.target) AS target FROM {EDGES} e LEFT JOIN s ON s.id = e.id""")
def graph_rewire_degree_preserving(spark, d):
    return R.rewire_preserving(party(spark, d)[1], 8, 0.3).select("id", "source", "target")


@query("graph_ontology_violation", f"""WITH n AS (SELECT 'r' || r_regionkey AS id, 'Region' AS type, NULL::DOUBLE AS balance FROM region UNION ALL SELECT 'n' || n_nationkey, 'Nation', NULL FROM nation UNION ALL SELECT 'c' || c_custkey, 'Customer', c_acctbal FROM customer UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_acctbal FROM supplier),
hn AS (SELECT id FROM n ORDER BY {u(8, 'violate:node', 'id')}, id LIMIT (SELECT round_even(0.2 * count(*), 0)::BIGINT FROM n)), he AS (SELECT id FROM {EDGES} ORDER BY {u(8, 'violate:edge', 'id')}, id LIMIT (SELECT round_even(0.2 * count(*), 0)::BIGINT FROM {EDGES})), low AS (SELECT type, min(id) AS id FROM n GROUP BY 1)
SELECT 'node' AS part, id, CASE WHEN id IN (SELECT id FROM hn) AND type IN ('Region', 'Nation') THEN 'undeclared_type' ELSE type END AS type, CASE WHEN id NOT IN (SELECT id FROM hn) THEN balance WHEN type = 'Customer' THEN 9001.0 WHEN type = 'Supplier' THEN -1.0 END AS balance, NULL AS target FROM n
UNION ALL SELECT 'edge', e.id, e.type, NULL, CASE WHEN e.id IN (SELECT id FROM he) THEN (SELECT min(id) FROM low WHERE low.type <> t.type) ELSE e.target END FROM {EDGES} e JOIN n t ON t.id = e.target""")
def graph_ontology_violation(spark, d):
    n, e = R.violate_ontology(*party(spark, d), ONTOLOGY, 8, 0.2)
    nodes = n.select(F.lit("node").alias("part"), "id", "type", X.prop("balance").cast("double").alias("balance"), F.lit(None).cast("string").alias("target"))
    return nodes.union(e.select(F.lit("edge"), "id", "type", F.lit(None).cast("double"), "target"))


@query("inject_violations", f"""SELECT id, target FROM {EDGES} UNION ALL SELECT 'violation-' || range, 'missing-' || range FROM range(30)""")
def inject_violations(spark, d):
    return R.inject_violations(party(spark, d)[1], 30, 8).select("id", "target")


# --- building -----------------------------------------------------------------------------------------------------------
def _skip_sql(purpose: str, spaces: list[tuple[int, float]]) -> str:
    """(space, at): chosen pair numbers, each a geometric draw after the one before it in its block."""
    one = lambda i, n, p: f"SELECT {i} AS space, {n} AS n, {int(B.DRAWS / p)} AS size, k.range AS k, j.range AS j, floor(ln(1.0 - {u(2, purpose, str(i), 'k.range', 'j.range')}) / {math.log1p(-p)!r}::DOUBLE)::BIGINT + 1 AS skip FROM range({-(-n // int(B.DRAWS / p))}) k, range({B.DRAWS + B.DRAWS // 2}) j"
    draws = " UNION ALL ".join(one(i, n, p) for i, (n, p) in enumerate(spaces))
    return f"(SELECT space, (k * size + o)::BIGINT AS pos FROM (SELECT space, n, size, k, sum(skip) OVER (PARTITION BY space, k ORDER BY j) - 1 AS o FROM ({draws})) WHERE o < size AND k * size + o < n)"


#: The greatest b whose pairs' numbers begin at or below this one.
_TRIANGLE = "(SELECT space, pos, CASE WHEN b * (b - 1) // 2 > pos THEN b - 1 WHEN b * (b + 1) // 2 <= pos THEN b + 1 ELSE b END AS b FROM (SELECT *, floor((sqrt(8.0 * pos + 1) + 1) / 2)::BIGINT AS b FROM {t}))"


@query("erdos_renyi", f"SELECT pos - b * (b - 1) // 2 AS a, b FROM {_TRIANGLE.format(t=_skip_sql('er', [(79_800, 0.02)]))}")
def erdos_renyi(spark, d):
    return B.erdos_renyi(spark, 400, 0.02, 2)


_SBM = _skip_sql("sbm", [(4950, 0.1)] * 3 + [(10_000, 0.005)] * 3)


@query("stochastic_block_model", f"""SELECT 100 * space + pos - b * (b - 1) // 2 AS a, 100 * space + b AS b FROM {_TRIANGLE.format(t=_SBM)} WHERE space < 3 UNION ALL
SELECT CASE space WHEN 5 THEN 100 ELSE 0 END + pos % 100, CASE space WHEN 3 THEN 100 ELSE 200 END + pos // 100 FROM {_SBM} WHERE space >= 3""")
def stochastic_block_model(spark, d):
    return B.stochastic_blocks(spark, [100, 100, 100], 0.1, 0.005, 2)


def _lfr_sql(n: int, seed: int, least: int, high: float, mixing: float, average: float) -> str:
    most = max(2.0, min(n - 1.0, n**0.5 * average))
    low = B._least_degree(average, most, 3.0)
    power = lambda draw, a, b, e: f"pow({a ** (1 - e)!r}::DOUBLE + {draw} * {b ** (1 - e) - a ** (1 - e)!r}::DOUBLE, {1 / (1 - e)!r}::DOUBLE)"
    whole = lambda x, draw: f"(floor({x}) + CASE WHEN {draw} < {x} - floor({x}) THEN 1 ELSE 0 END)::INT"
    paired = "SELECT min(id) AS a, max(id) AS b, count(*) AS n, min(c) = max(c) AS same"
    return f"""WITH z AS (SELECT range AS c, floor({power(u(seed, 'lfr:size', 'range'), float(least), high, 1.5)})::BIGINT AS size FROM range({-(-n // least)})), f AS (SELECT c, sum(size) OVER (ORDER BY c) - size AS lo, size FROM z),
s AS (SELECT c, lo, CASE WHEN {n} - least({n}, lo + size) < {least} THEN {n} ELSE least({n}, lo + size) END AS hi FROM f WHERE lo < {n} AND ({n} - lo >= {least} OR c = 0)),
v AS (SELECT range AS id, c, hi - lo AS size, {power(u(seed, 'lfr:degree', 'range'), low, most, 3.0)} AS x FROM range({n}) JOIN s ON range >= lo AND range < hi), d AS (SELECT id, c, size, greatest(1, {whole('x', u(seed, 'lfr:round', 'id'))}) AS degree FROM v),
i AS (SELECT id, c, degree, least({whole(f'(degree * {1 - mixing!r}::DOUBLE)', u(seed, 'lfr:inner', 'id'))}, size - 1)::INT AS own FROM d), hn AS (SELECT id, c, unnest(range(1, own + 1)) AS h FROM i), hf AS (SELECT id, c, unnest(range(1, degree - own + 1)) AS h FROM i),
kn AS (SELECT id, c, (row_number() OVER (PARTITION BY c ORDER BY {u(seed, 'lfr:near', 'id', 'h')}, id, h) - 1) // 2 AS k FROM hn), kf AS (SELECT id, c, (row_number() OVER (ORDER BY {u(seed, 'lfr:far', 'id', 'h')}, id, h) - 1) // 2 AS k FROM hf)
SELECT DISTINCT a, b FROM (SELECT a, b FROM ({paired} FROM kn GROUP BY c, k) WHERE n = 2 AND a <> b UNION ALL SELECT a, b FROM ({paired} FROM kf GROUP BY k) WHERE n = 2 AND a <> b AND NOT same)"""


@query("lfr", _lfr_sql(3000, 2, 300, 1500.0, 0.1, 5.0))
def lfr(spark, d):
    return B.lfr(spark, 3000, 2)[1]


@query("watts_strogatz", f"""SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT a, CASE WHEN {u(2, 'ws', 'a', 'j')} < 0.1 THEN CASE WHEN k >= a THEN k + 1 ELSE k END ELSE (a + j) % 500 END AS b FROM
(SELECT x.range AS a, y.range AS j, floor({u(2, 'ws:to', 'x.range', 'y.range')} * 499)::BIGINT AS k FROM range(500) x, range(1, 4) y)) WHERE a <> b""")
def watts_strogatz(spark, d):
    return B.watts_strogatz(spark, 500, 6, 0.1, 2)


@query("barabasi_albert", f"""WITH RECURSIVE l AS (SELECT a.range AS a, j.range AS j, floor({u(1, 'ba:node', 'a.range', 'j.range')} * a.range)::BIGINT AS earlier, {u(1, 'ba', 'a.range', 'j.range')} < 0.5 AND a.range > 1 AS copies,
least(floor({u(1, 'ba:link', 'a.range', 'j.range')} * (a.range - 1))::BIGINT + 1, a.range - 1) AS pa, floor({u(1, 'ba:slot', 'a.range', 'j.range')} * 2)::BIGINT AS pj FROM range(1, 2000) a, range(2) j),
r AS (SELECT a, j, a AS ca, j AS cj FROM l UNION ALL SELECT r.a, r.j, l.pa, l.pj FROM r JOIN l ON l.a = r.ca AND l.j = r.cj WHERE l.copies)
SELECT DISTINCT least(r.a, l.earlier) AS a, greatest(r.a, l.earlier) AS b FROM r JOIN l ON l.a = r.ca AND l.j = r.cj WHERE NOT l.copies AND r.a <> l.earlier""")
def barabasi_albert(spark, d):
    return B.barabasi_albert(spark, 2000, 2, 1)


@query("assign_node_types", "SELECT range::VARCHAR AS id, ['Nation', 'Customer', 'Supplier'][range % 3 + 1] AS type FROM range(300)")
def assign_node_types(spark, d):
    return B.assign_types(spark, 300, ["Nation", "Customer", "Supplier"]).select("id", "type")


@query("map_edges", """WITH p AS (SELECT x.range AS a, y.range AS b FROM range(30) x, range(30) y WHERE x.range < y.range), t AS (SELECT a::VARCHAR AS a, b::VARCHAR AS b, a % 3 AS ta, b % 3 AS tb FROM p)
SELECT CASE WHEN ta = 1 OR tb = 1 THEN 'CUSTOMER_OF' ELSE 'SUPPLIER_OF' END AS type, CASE WHEN tb = 0 THEN a ELSE b END AS source, CASE WHEN tb = 0 THEN b ELSE a END AS target FROM t WHERE (ta = 0) <> (tb = 0)""")
def map_edges(spark, d):
    n = B.assign_types(spark, 30, ["Nation", "Customer", "Supplier"])
    return B.map_edges(n, B.erdos_renyi(spark, 30, 1.0, 2), ONTOLOGY).select("type", "source", "target")


@query("edge_type_by_endpoint_types", f"SELECT DISTINCT a.type AS source_type, b.type AS target_type, e.type AS name FROM {EDGES} e JOIN {NODES} a ON a.id = e.source JOIN {NODES} b ON b.id = e.target")
def edge_type_by_endpoint_types(spark, d):
    return X.resolved(*party(spark, d)).select("source_type", "target_type", F.col("type").alias("name")).distinct()


@query("graph_from_sample", f"""WITH t AS (SELECT type, count(*) AS c FROM {NODES} GROUP BY 1), cum AS (SELECT type, sum(c) OVER (ORDER BY type) / (sum(c) OVER ())::DOUBLE AS hi FROM t),
n AS (SELECT 'n' || range AS id, (SELECT coalesce(min(type), (SELECT max(type) FROM cum)) FROM cum WHERE {u(6, 'type', 'range')} < hi) AS type FROM range(3000)), k AS (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY type) AS size FROM n),
g AS (SELECT e.type, a.type AS source_type, b.type AS target_type, count(*) AS m FROM {EDGES} e JOIN {NODES} a ON a.id = e.source JOIN {NODES} b ON b.id = e.target GROUP BY 1, 2, 3), r AS (SELECT g.*, m / t.c::DOUBLE AS per FROM g JOIN t ON t.type = g.source_type),
o AS (SELECT k.id AS source, r.type, target_type, (floor(per) + CASE WHEN {u(6, 'extra', 'k.id', 'r.type')} < per - floor(per) THEN 1 ELSE 0 END)::INT AS c FROM k JOIN r ON r.source_type = k.type), j AS (SELECT source, type, target_type, unnest(range(1, c + 1)) AS j FROM o),
z AS (SELECT DISTINCT j.type, source, k.id AS target FROM (SELECT j.*, floor({u(6, 'to', 'source', 'type', 'j')} * size)::BIGINT AS k FROM j JOIN (SELECT DISTINCT type AS tt, size FROM k) ON tt = target_type) j JOIN k ON k.type = j.target_type AND k.k = j.k WHERE source <> k.id)
SELECT 'node' AS element, type, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'node', NULL, count(*) FROM n UNION ALL SELECT 'edge', type, count(*) FROM z GROUP BY 2 UNION ALL SELECT 'edge', NULL, count(*) FROM z""")
def graph_from_sample(spark, d):
    n, e = B.graph_from_sample(*party(spark, d), 3000, 6)
    return X.graph_metrics(n, e)


@query("chung_lu", f"""WITH {PAIRS}, h AS (SELECT id, unnest(range(1, degree + 1)) AS h FROM deg), o AS (SELECT id, (row_number() OVER (ORDER BY {u(6, 'chung-lu', 'id', 'h')}, id, h) - 1) // 2 AS k FROM h)
SELECT DISTINCT a, b FROM (SELECT min(id) AS a, max(id) AS b, count(*) AS n FROM o GROUP BY k) WHERE n = 2 AND a <> b""")
def chung_lu(spark, d):
    n, e = parts(spark, d)
    return B.chung_lu(X.degree(n, X.to_undirected(n, e)), 6)


@query("graph_hybrid", "SELECT id, type, props FROM (SELECT range::VARCHAR AS id, ['A', 'B'][range % 2 + 1] AS type FROM range(10)), LATERAL (SELECT CASE WHEN type = 'A' THEN ['{\"x\":1}', '{\"x\":2}'][((id::INT // 2) % 2) + 1] ELSE '{}' END AS props)")
def graph_hybrid(spark, d):
    rows = spark.createDataFrame([("A", '{"x":1}'), ("A", '{"x":2}')], "type string, props string")
    return B.hybrid_props(B.assign_types(spark, 10, ["A", "B"]), rows)


def _proposed(spark, d):
    """Canned proposals: nations and regions, each said twice, and one edge to a region that isn't there."""
    n = read(spark, d, "nation")
    nodes = n.select(F.lit("Nation").alias("type"), F.col("n_name").alias("key"), F.lit("{}").alias("props")).union(read(spark, d, "region").select(F.lit("Region"), "r_name", F.lit("{}")))
    e = n.join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("IN").alias("type"), F.lit("Nation").alias("source_type"), F.col("n_name").alias("source_key"), F.lit("Region").alias("target_type"), F.col("r_name").alias("target_key"))
    return nodes.union(nodes), e.union(e).union(e.limit(1).withColumn("target_key", F.lit("nowhere")))


@query("graph_llm_build", "SELECT 'Nation:' || n_name AS source, 'Region:' || r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_llm_build(spark, d):
    return B.build_from_rows(*_proposed(spark, d))[1].select("source", "target")


@query("natural_key_resolution", "SELECT 'Nation:' || n_name AS id, 'Nation' AS type FROM nation UNION ALL SELECT 'Region:' || r_name, 'Region' FROM region")
def natural_key_resolution(spark, d):
    return B.build_from_rows(*_proposed(spark, d))[0].select("id", "type")


@query("assemble_graph", f"SELECT 'node' AS part, count(*) AS n FROM {NODES} UNION ALL SELECT 'edge', count(*) FROM {EDGES}")
def assemble_graph(spark, d):
    n, e = B.assemble([*_halves(spark, d)])
    return n.agg(F.lit("node").alias("part"), F.count("*").alias("n")).union(e.agg(F.lit("edge").alias("part"), F.count("*").alias("n")))


@query("union_dedup_graph", f"SELECT id, type FROM {NODES}")
def union_dedup_graph(spark, d):
    return B.assemble([*_halves(spark, d)])[0].select("id", "type")


def _walks(spark, d):
    n, e = party(spark, d)
    p = X.to_undirected(n, e)
    return n, e, p, B.sample_paths(p, 200, 2, 12)


def _step_sql(walks: str, hop: int) -> str:
    draw = u(12, f"step{hop}", "walk", "other")
    return f"(SELECT walk, list_append(path, other) AS path FROM (SELECT walk, path, other, row_number() OVER (PARTITION BY walk ORDER BY {draw}, other) AS r FROM {walks} x JOIN bw ON bw.id = x.path[-1] WHERE NOT list_contains(path, other)) WHERE r = 1)"


_PATHS = f"""pr AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM {EDGES}), bw AS (SELECT a AS id, b AS other FROM pr UNION ALL SELECT b, a FROM pr), ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM bw)),
w0 AS (SELECT range AS walk, [id] AS path FROM range(200) JOIN ids ON i = floor({u(12, 'start', 'range')} * n)::BIGINT), w AS (SELECT path, min(walk) AS walk FROM {_step_sql(_step_sql('w0', 0), 1)} GROUP BY path)"""


@query("sample_paths", f"WITH {_PATHS} SELECT walk, path FROM w")
def sample_paths(spark, d):
    return _walks(spark, d)[3]


@query("adjacency_expand", f"SELECT a.id AS start, b.target AS step, c.target AS reached FROM {NODES} a JOIN {EDGES} b ON b.source = a.id JOIN {EDGES} c ON c.source = b.target")
def adjacency_expand(spark, d):
    n, e = party(spark, d)
    one = n.select(F.col("id").alias("start")).join(e.select(F.col("source").alias("start"), F.col("target").alias("step")), "start")
    return one.join(e.select(F.col("source").alias("step"), F.col("target").alias("reached")), "step").select("start", "step", "reached")


@query("qa_chained_relation", f"""WITH {_PATHS}, nm AS (SELECT least(source, target) AS a, greatest(source, target) AS b, lower(replace(min(type), '_', ' ')) AS phrase FROM {EDGES} GROUP BY 1, 2)
SELECT walk, 'Starting from ' || path[1] || ', what is reached by: ' || x.phrase || ', then ' || y.phrase || '?' AS question, path[-1] AS answer, 'easy' AS difficulty
FROM w JOIN nm x ON x.a = least(path[1], path[2]) AND x.b = greatest(path[1], path[2]) JOIN nm y ON y.a = least(path[2], path[3]) AND y.b = greatest(path[2], path[3])""")
def qa_chained_relation(spark, d):
    _, e, _, w = _walks(spark, d)
    return B.qa_chain(w, e)


@query("qa_aggregation_count", f"SELECT source AS node, 'How many times does ' || source || ' ' || lower(replace(type, '_', ' ')) || '?' AS question, count(*)::VARCHAR AS answer FROM {EDGES} GROUP BY source, type")
def qa_aggregation_count(spark, d):
    return B.qa_counts(*party(spark, d))


@query("qa_existence", f"""SELECT n.id AS node, 'Does ' || n.id || ' ' || lower(replace(o.name, '_', ' ')) || ' anything?' AS question, CASE WHEN EXISTS (SELECT 1 FROM {EDGES} e WHERE e.source = n.id AND e.type = o.name) THEN 'yes' ELSE 'no' END AS answer
FROM {NODES} n JOIN (VALUES ('IN_REGION', 'Nation'), ('CUSTOMER_OF', 'Customer'), ('SUPPLIER_OF', 'Supplier')) o(name, type) USING (type)""")
def qa_existence(spark, d):
    return B.qa_exists(*party(spark, d), ONTOLOGY)


@query("qa_comparison", f"""WITH n AS (SELECT type, source, count(*) AS n FROM {PEDGES} GROUP BY 1, 2), l AS (SELECT type, source, n, lead(source) OVER (ORDER BY source) AS other, lead(n) OVER (ORDER BY source) AS m FROM n)
SELECT type, 'Which has more with links, ' || source || ' or ' || other || '?' AS question, CASE WHEN n > m THEN source ELSE other END AS answer FROM l WHERE other IS NOT NULL AND n <> m""")
def qa_comparison(spark, d):
    return B.qa_compare(parts(spark, d)[1])


def _checks_sql(*columns: str) -> str:
    known = f"(SELECT walk, bool_and(x IN (SELECT id FROM {NODES})) AS every_one, bool_or(x IN (SELECT id FROM {NODES})) AS some_one FROM (SELECT walk, unnest(path) AS x FROM w) GROUP BY 1)"
    joined = "(SELECT walk, bool_and(EXISTS (SELECT 1 FROM pr WHERE pr.a = least(x, y) AND pr.b = greatest(x, y))) AS walks FROM (SELECT walk, unnest(path[:-2]) AS x, unnest(path[2:]) AS y FROM w) GROUP BY 1)"
    values = {"answerable": "avg(every_one::INT)", "multi_hop": "avg(walks::INT)", "grounded": "avg(some_one::INT)"}
    return f"WITH {_PATHS} SELECT count(*) AS n, " + ", ".join(f"{values[c]}::DOUBLE AS {c}" for c in columns) + f" FROM {known} JOIN {joined} USING (walk)"


for _name, _col in (("graph_qa_answerable", "answerable"), ("graph_qa_multi_hop", "multi_hop"), ("graph_qa_groundedness", "grounded")):
    @query(_name, _checks_sql(_col))
    def _checks(spark, d, col=_col):
        n, _, p, w = _walks(spark, d)
        return B.qa_checks(w.select("path", F.element_at("path", -1).alias("answer")), n, p).select("n", col)


@query("path_resolution", _checks_sql("answerable", "multi_hop", "grounded"))
def path_resolution(spark, d):
    n, _, p, w = _walks(spark, d)
    return B.qa_checks(w.select("path", F.element_at("path", -1).alias("answer")), n, p)


def _mappings(spark, d):
    left = read(spark, d, "part").select(F.col("p_brand").alias("label")).union(read(spark, d, "customer").select(F.col("c_mktsegment").alias("label")))
    return B.align(left, read(spark, d, "part").select(F.col("p_type").alias("label")).union(read(spark, d, "part").select(F.upper("p_brand").alias("label"))))


_ALIGNED = f"""(SELECT source, target, score, CASE WHEN score >= 0.95 THEN 'exactMatch' WHEN score >= 0.8 THEN 'closeMatch' ELSE 'relatedMatch' END AS predicate, CASE WHEN score >= 0.85 THEN 'accept' WHEN score >= 0.5 THEN 'review' ELSE 'drop' END AS route FROM
(SELECT source, target, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS r FROM (SELECT source, target, CASE WHEN p = q THEN 1.0 ELSE 0.5 * len(list_intersect(x, y)) / greatest(1, len(list_distinct(list_concat(x, y))))::DOUBLE + 0.5 * (1 - levenshtein(p, q) / greatest(1, length(p), length(q))::DOUBLE) END AS score
FROM (SELECT source, x, array_to_string(x, ' ') AS p FROM (SELECT source, {_LEX_TOK.format('source')} AS x FROM (SELECT p_brand AS source FROM part UNION SELECT c_mktsegment FROM customer))),
(SELECT target, y, array_to_string(y, ' ') AS q FROM (SELECT target, {_LEX_TOK.format('target')} AS y FROM (SELECT p_type AS target FROM part UNION SELECT upper(p_brand) FROM part)))) WHERE score >= 0.3) WHERE r = 1)"""


@query("ontology_align", f"SELECT source, target, round(score, 6)::DOUBLE AS score, predicate, route FROM {_ALIGNED}")
def ontology_align(spark, d):
    return rounded(_mappings(spark, d), "score")


@query("ontology_align_candidates", f"SELECT source, target, round(score, 6)::DOUBLE AS score FROM {_ALIGNED} WHERE route <> 'drop'")
def ontology_align_candidates(spark, d):
    return rounded(_mappings(spark, d).where("route <> 'drop'").select("source", "target", "score"), "score")


@query("mapping_review_task", f"SELECT count(*) AS n, string_agg(source, ',' ORDER BY source) AS sources FROM {_ALIGNED} WHERE route = 'review' HAVING count(*) > 0")
def mapping_review_task(spark, d):
    return B.mapping_review(_mappings(spark, d))
