"""Queries of sources, sinks, metadata and evaluation. What is written goes to the folder that all nodes share, and is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.shared import cut
from tessera.operators import metadata
from tessera.plans import evaluate
from tessera.plans.graphs import EDGES, NODES, ONTOLOGY, party
from tessera.plans.registry import ORACLES, query, read
from tessera.plans.tables import REFERENCE, SUBJECT, rounded, split_orders
from tessera.sources import readers, writers


def _folder(spark) -> str:
    cut(spark.range(1))  # sets the folder of a local session
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{uuid.uuid4().hex}"


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query("scan_parquet", "SELECT * FROM customer")
def scan_parquet(spark, d):
    return readers.scan(spark, f"{d}/customer.parquet")


def _trip(kind: str, ending: str):
    def run(spark, d):
        path = f"{_folder(spark)}.{ending}"
        writers.export(read(spark, d, "nation"), path, kind)
        return readers.scan(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))

    return run


for _name, _kind, _ending in (("scan_csv", "csv", "csv"), ("scan_jsonl", "json", "jsonl"), ("export_csv", "csv", "csv"), ("export_json", "json", "jsonl"), ("export_parquet", "parquet", "parquet")):
    query(_name, _NATION)(_trip(_kind, _ending))


@query("export_format_rule", "SELECT n AS rows, CASE WHEN n > 500000 THEN 'parquet' ELSE 'csv' END AS format FROM (VALUES (10::BIGINT), (500000), (500001), (2000000)) t(n)")
def export_format_rule(spark, d):
    return spark.createDataFrame([(n, writers.resolve_format(n)) for n in (10, 500_000, 500_001, 2_000_000)], "rows long, format string")


@query("export_arrow", "SELECT count(*) AS n, sum(c_custkey)::BIGINT AS key_sum FROM customer")
def export_arrow(spark, d):
    """Arrow streams of all partitions, read back."""
    import pyarrow as pa

    def back(batches):
        for b in batches:
            for raw in b.column("stream").to_pylist():
                yield from pa.ipc.open_stream(raw).read_all().select(["c_custkey"]).to_batches()

    rows = writers.arrow_streams(read(spark, d, "customer")).mapInArrow(back, "c_custkey long")
    return rows.agg(F.count("*").alias("n"), F.sum("c_custkey").alias("key_sum"))


@query("scan_media_manifest", "SELECT event_id AS idx, event_type AS label FROM events")
def scan_media_manifest(spark, d):
    path = _folder(spark)
    rows = read(spark, d, "events").select(F.col("event_id").alias("idx"), F.col("event_type").alias("label"))
    doc = rows.withColumn("part", F.pmod("idx", F.lit(16))).groupBy("part").agg(F.to_json(F.struct(F.collect_list(F.struct("idx", "label")).alias("items"))).alias("value")).select("value")
    doc.write.text(path)
    return _lines(spark, path, "idx long, label string")


def _lines(spark, path: str, schema: str):
    """Manifests that stand one on a line, as several shards write them."""
    text = spark.read.text(path)
    listed = F.coalesce(F.get_json_object("value", "$.items"), F.col("value"))
    return text.select(F.explode(F.from_json(listed, f"array<struct<{schema}>>")).alias("r")).select("r.*")


@query("scan_graph_json", f"SELECT 'node' AS part, id, type FROM {NODES} UNION ALL SELECT 'edge', id, type FROM {EDGES}")
def scan_graph_json(spark, d):
    """Written as one document, as this format is, and read back."""
    n, e = party(spark, d)
    path = _folder(spark)
    one = n.agg(F.collect_list(F.struct("id", "type", F.parse_json("props").alias("properties"))).alias("nodes")).crossJoin(e.agg(F.collect_list(F.struct("id", "type", "source", "target")).alias("edges")))
    one.select(F.to_json(F.struct("nodes", "edges")).alias("value")).write.text(path)
    nodes, edges = readers.scan_graph(spark, path)
    return nodes.select(F.lit("node").alias("part"), "id", "type").union(edges.select(F.lit("edge"), "id", "type"))


@query("scan_graphml", f"SELECT 'node' AS part, id, type FROM {NODES} UNION ALL SELECT 'edge', id, type FROM {EDGES}")
def scan_graphml(spark, d):
    path = _folder(spark)
    writers.graphml(*party(spark, d)).orderBy("part").select("value").coalesce(1).write.text(path)
    nodes, edges = readers.scan_graphml(spark, path)
    return nodes.select(F.lit("node").alias("part"), "id", "type").union(edges.select(F.lit("edge"), "id", "type"))


@query("scan_graphrag_qa", "SELECT n_nationkey::VARCHAR AS id, 'Where is ' || n_name || '?' AS question FROM nation")
def scan_graphrag_qa(spark, d):
    path = _folder(spark)
    rows = read(spark, d, "nation").select(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question")).alias("r"))
    rows.agg(F.to_json(F.struct(F.collect_list("r").alias("items"))).alias("value")).write.text(path)
    return readers.scan_qa(spark, path).select("id", "question")


def _mapping_rows(spark, d):
    n = read(spark, d, "nation")
    return n.select(F.concat(F.lit("a:"), "n_name").alias("subject_id"), F.when(F.col("n_regionkey") > 2, "skos:exactMatch").otherwise("skos:oddMatch").alias("predicate_id"), F.concat(F.lit("b:"), F.lower("n_name")).alias("object_id"), F.lit(0.5).alias("confidence"), F.lit("lexical").alias("matcher"))


@query("scan_sssom_tsv", "SELECT 'a:' || n_name AS subject_id, CASE WHEN n_regionkey > 2 THEN 'exactMatch' ELSE 'relatedMatch' END AS predicate_id, 'b:' || lower(n_name) AS object_id FROM nation")
def scan_sssom_tsv(spark, d):
    path = _folder(spark)
    body = writers.sssom(_mapping_rows(spark, d)).select(F.lit(2).alias("k"), "value")
    head = spark.createDataFrame([(0, "# subject_source: a"), (1, "subject_id\tpredicate_id\tobject_id\tconfidence\tmatcher")], "k int, value string")
    head.union(body).coalesce(1).sortWithinPartitions("k", "value").select("value").write.text(path)
    return readers.scan_sssom(spark, path)[1].select("subject_id", "predicate_id", "object_id")


@query("sssom_tsv", "SELECT 'a:' || n_name || chr(9) || CASE WHEN n_regionkey > 2 THEN 'skos:exactMatch' ELSE 'skos:oddMatch' END || chr(9) || 'b:' || lower(n_name) || chr(9) || '0.5' || chr(9) || 'lexical' AS value FROM nation")
def sssom_tsv(spark, d):
    return writers.sssom(_mapping_rows(spark, d))


@query("sssom_json", "SELECT '{\"subject_id\":\"a:' || n_name || '\",\"object_id\":\"b:' || lower(n_name) || '\"}' AS value FROM nation")
def sssom_json(spark, d):
    return writers.manifest(_mapping_rows(spark, d).select("subject_id", "object_id"), "subject_id")


# --- graph formats ------------------------------------------------------------------------------------------------------
@query("graph_to_rdf", f"""SELECT '<http://example.org/graph/node/' || id || '>' AS s, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' AS p, '<http://example.org/graph/type/' || type || '>' AS o FROM {NODES}
UNION ALL SELECT '<http://example.org/graph/node/' || source || '>', '<http://example.org/graph/relation/' || type || '>', '<http://example.org/graph/node/' || target || '>' FROM {EDGES}""")
def graph_to_rdf(spark, d):
    n, e = party(spark, d)
    return writers.triples(n.withColumn("props", F.lit("{}")), e)


def _titled(spark, d):
    """The party graph with names as its only properties."""
    n, e = party(spark, d)
    return n.withColumn("props", F.to_json(F.struct(F.get_json_object("props", "$.name").alias("name")))), e


TITLED = """(SELECT 'r' || r_regionkey AS id, 'Region' AS type, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name FROM customer UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name FROM supplier)"""
_IRI, _TYPE = "http://example.org/graph/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TRIPLES = f"""(SELECT '<{_IRI}node/' || id || '>' AS s, '<{_TYPE}>' AS p, '<{_IRI}type/' || type || '>' AS o FROM {TITLED} UNION ALL SELECT '<{_IRI}node/' || id || '>', '<{_IRI}property/name>', '"' || name || '"' FROM {TITLED}
UNION ALL SELECT '<{_IRI}node/' || source || '>', '<{_IRI}relation/' || type || '>', '<{_IRI}node/' || target || '>' FROM {EDGES})"""


def _document(head: str, body: str, tail: str, last: int = 2) -> str:
    return f"SELECT 0 AS part, '{head}' AS value UNION ALL {body} UNION ALL SELECT {last}, '{tail}'"


_JSONLD = _document("[{}", f"""SELECT 1, ',{{"@id":"' || s || '",' || string_agg(m, ',' ORDER BY m) || '}}' FROM (SELECT trim(s, '<>') AS s, k || ':[' || string_agg(v, ',' ORDER BY v) || ']' AS m FROM
(SELECT s, CASE WHEN p = '<{_TYPE}>' THEN '"@type"' ELSE '"' || trim(p, '<>') || '"' END AS k, CASE WHEN p = '<{_TYPE}>' THEN '"' || trim(o, '<>') || '"' WHEN o LIKE '<%' THEN '{{"@id":"' || trim(o, '<>') || '"}}' ELSE '{{"@value":' || o || '}}' END AS v FROM {_TRIPLES}) GROUP BY s, k) GROUP BY s""", "]")
_RDFXML = _document('<?xml version="1.0" encoding="UTF-8"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">', f"""SELECT 1, '<rdf:Description rdf:about="' || s || '">' || string_agg(l, '' ORDER BY l) || '</rdf:Description>' FROM
(SELECT trim(s, '<>') AS s, '<q:' || q || ' xmlns:q="' || left(p, length(p) - length(q)) || '"' || CASE WHEN o LIKE '<%' THEN ' rdf:resource="' || trim(o, '<>') || '"/>' ELSE '>' || trim(o, '"') || '</q:' || q || '>' END AS l FROM
(SELECT s, trim(p, '<>') AS p, regexp_extract(trim(p, '<>'), '[A-Za-z_]+$') AS q, o FROM {_TRIPLES})) GROUP BY s""", "</rdf:RDF>")
_GRAPHML = _document('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="name" for="all" attr.name="name" attr.type="string"/><key id="type" for="all" attr.name="type" attr.type="string"/><graph edgedefault="directed">',
    f"""SELECT 1, '<node id="' || id || '"><data key="type">' || type || '</data><data key="name">' || name || '</data></node>' FROM {TITLED} UNION ALL SELECT 2, '<edge id="' || id || '" source="' || source || '" target="' || target || '"><data key="type">' || type || '</data></edge>' FROM {EDGES}""", "</graph></graphml>", 3)
_GEXF = _document('<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><attributes class="node"><attribute id="name" title="name" type="string"/></attributes><attributes class="edge"></attributes><nodes>',
    f"""SELECT 1, '<node id="' || id || '" label="' || type || '"><attvalues><attvalue for="name" value="' || name || '"/></attvalues></node>' FROM {TITLED} UNION ALL SELECT 2, '</nodes><edges>' UNION ALL
SELECT 3, '<edge id="' || id || '" label="' || type || '" source="' || source || '" target="' || target || '"><attvalues></attvalues></edge>' FROM {EDGES}""", "</edges></graph></gexf>", 4)
_JSON = f"""SELECT 'nodes' AS part, id, '{{"id":"' || id || '","properties":{{"name":"' || name || '"}},"type":"' || type || '"}}' AS value FROM {TITLED} UNION ALL
SELECT 'edges', id, '{{"id":"' || id || '","properties":{{}},"source":"' || source || '","target":"' || target || '","type":"' || type || '"}}' FROM {EDGES}"""
_NEO4J = f"""SELECT DISTINCT 'nodes_' || type || '.csv' AS file, 0 AS part, '' AS id, 'id:ID,:LABEL,name' AS value FROM {TITLED} UNION ALL SELECT 'nodes_' || type || '.csv', 1, id, id || ',' || type || ',' || name FROM {TITLED} UNION ALL
SELECT DISTINCT 'edges_' || type || '.csv', 0, '', ':START_ID,:END_ID,:TYPE' FROM {EDGES} UNION ALL SELECT 'edges_' || type || '.csv', 1, id, source || ',' || target || ',' || type FROM {EDGES}"""


@query("graph_to_rdf_properties", f"SELECT s || ' ' || p || ' ' || o || ' .' AS value FROM {_TRIPLES}")
def graph_to_rdf_properties(spark, d):
    return writers.ntriples(writers.triples(*_titled(spark, d)))


for _name, _kind, _sql in (("graph_to_turtle", "turtle", f"SELECT s || ' ' || string_agg(p || ' ' || o, ' ;' || chr(10) || '    ' ORDER BY p || ' ' || o) || ' .' AS value FROM {_TRIPLES} GROUP BY s"), ("graph_to_jsonld", "jsonld", _JSONLD), ("graph_to_rdfxml", "rdfxml", _RDFXML),
                           ("graph_to_gexf", "gexf", _GEXF), ("graph_to_graphml", "graphml", _GRAPHML), ("graph_to_json", "json", _JSON), ("graph_to_neo4j_files", "neo4j_csv", _NEO4J)):
    @query(_name, _sql)
    def _graph(spark, d, kind=_kind):
        return writers.export_graph(*_titled(spark, d), ONTOLOGY, kind)


_W3 = "http://www.w3.org/"


@query("ontology_to_owl", f"""WITH c AS (SELECT unnest(['Region', 'Nation', 'Customer', 'Supplier']) AS c), p AS (SELECT * FROM (VALUES ('Region', 'name', 'string'), ('Nation', 'name', 'string'), ('Customer', 'name', 'string'), ('Customer', 'segment', 'string'), ('Customer', 'balance', 'double'), ('Supplier', 'name', 'string'), ('Supplier', 'balance', 'double')) t(c, p, x)),
r AS (SELECT * FROM (VALUES ('IN_REGION', 'Nation', 'Region'), ('CUSTOMER_OF', 'Customer', 'Nation'), ('SUPPLIER_OF', 'Supplier', 'Nation')) t(r, a, b)) SELECT '<{_IRI}type/' || c || '>' AS s, '<{_TYPE}>' AS p, '<{_W3}2002/07/owl#Class>' AS o FROM c
UNION ALL SELECT '<{_IRI}property/' || c || '.' || p || '>', '<{_TYPE}>', '<{_W3}2002/07/owl#DatatypeProperty>' FROM p UNION ALL SELECT '<{_IRI}property/' || c || '.' || p || '>', '<{_W3}2000/01/rdf-schema#domain>', '<{_IRI}type/' || c || '>' FROM p
UNION ALL SELECT '<{_IRI}property/' || c || '.' || p || '>', '<{_W3}2000/01/rdf-schema#range>', '<{_W3}2001/XMLSchema#' || x || '>' FROM p UNION ALL SELECT '<{_IRI}relation/' || r || '>', '<{_TYPE}>', '<{_W3}2002/07/owl#ObjectProperty>' FROM r
UNION ALL SELECT '<{_IRI}relation/' || r || '>', '<{_W3}2000/01/rdf-schema#domain>', '<{_IRI}type/' || a || '>' FROM r UNION ALL SELECT '<{_IRI}relation/' || r || '>', '<{_W3}2000/01/rdf-schema#range>', '<{_IRI}type/' || b || '>' FROM r""")
def ontology_to_owl(spark, d):
    return writers.owl(spark, ONTOLOGY)


@query("graph_to_cypher", f"""SELECT 0 AS part, id, 'CREATE (:' || type || ' {{_nid: ''' || id || '''}});' AS value FROM {NODES} UNION ALL
SELECT 1, id, 'MATCH (a {{_nid: ''' || source || '''}}), (b {{_nid: ''' || target || '''}}) CREATE (a)-[:' || type || ' {{_eid: ''' || id || '''}}]->(b);' FROM {EDGES}""")
def graph_to_cypher(spark, d):
    n, e = party(spark, d)
    return writers.cypher(n.withColumn("props", F.lit("{}")), e)


@query("graph_to_neo4j_csv", "SELECT 'c' || c_custkey AS \"id:ID\", 'Customer' AS \":LABEL\", c_name AS name, c_mktsegment AS segment FROM customer")
def graph_to_neo4j_csv(spark, d):
    return writers.neo4j_nodes(party(spark, d)[0], "Customer", ["name", "segment"])


@query("graph_to_neo4j_edges", f"SELECT source AS \":START_ID\", target AS \":END_ID\", type AS \":TYPE\" FROM {EDGES} WHERE type = 'CUSTOMER_OF'")
def graph_to_neo4j_edges(spark, d):
    return writers.neo4j_edges(party(spark, d)[1], "CUSTOMER_OF")


@query("graph_to_gnn", f"WITH p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM {NODES}) SELECT a.i AS src, b.i AS dst FROM {EDGES} e JOIN p a ON a.id = e.source JOIN p b ON b.id = e.target")
def graph_to_gnn(spark, d):
    return writers.gnn_edge_index(*party(spark, d))


@query("graph_to_gnn_types", f"SELECT row_number() OVER (ORDER BY id) - 1 AS idx, [(type = 'Customer')::INT, (type = 'Nation')::INT, (type = 'Region')::INT, (type = 'Supplier')::INT] AS one_hot FROM {NODES}")
def graph_to_gnn_types(spark, d):
    return writers.gnn_one_hot(party(spark, d)[0])


@query("graph_to_parquet", f"SELECT id AS edge_id, source, target, type, true AS directed FROM {EDGES}")
def graph_to_parquet(spark, d):
    return writers.edge_list(party(spark, d)[1], ONTOLOGY)


@query("qa_to_jsonl", "SELECT '{\"id\":\"' || n_nationkey || '\",\"question\":\"Where is ' || n_name || '?\"}' AS value FROM nation")
def qa_to_jsonl(spark, d):
    return writers.manifest(read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question")), "id")


@query("qa_manifest", "SELECT role AS type, turn AS hops, count(*) AS n FROM conversations GROUP BY 1, 2")
def qa_manifest(spark, d):
    return read(spark, d, "conversations").groupBy(F.col("role").alias("type"), F.col("turn").alias("hops")).agg(F.count("*").alias("n"))


@query("text_artifact", "SELECT '{\"item_id\":' || item_id || ',\"n\":' || length(text) || '}' AS value FROM benchmark")
def text_artifact(spark, d):
    return writers.manifest(read(spark, d, "benchmark").select("item_id", F.length("text").alias("n")), "item_id")


@query("media_manifest", "SELECT '{\"index\":' || p_partkey || ',\"label\":\"' || p_type || '\"}' AS value FROM part")
def media_manifest(spark, d):
    return writers.manifest(read(spark, d, "part").select(F.col("p_partkey").alias("index"), F.col("p_type").alias("label")), "index")


def _report(spark, d):
    s, r = split_orders(spark, d)
    return evaluate.run(s, r, key="o_orderkey", sensitive="o_orderpriority", outcome="o_totalprice")


_REPORT = f"""WITH s AS {SUBJECT}, r AS {REFERENCE}, p AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM s GROUP BY o_orderpriority), e AS (SELECT -sum(p * ln(p)) / ln(count(*)) AS entropy, max(p) AS top FROM p),
u AS (SELECT (count(DISTINCT o_totalprice) + count(DISTINCT o_custkey) + count(DISTINCT o_orderpriority)) / (3.0::DOUBLE * count(*)) AS uniq FROM s), f AS ({ORACLES['fidelity_score']}), m AS (SELECT median(o_totalprice) AS mid FROM s),
g AS (SELECT max(rate) - min(rate) AS gap FROM (SELECT avg((o_totalprice > mid)::INT) AS rate FROM s, m GROUP BY o_orderpriority)), z AS (SELECT stddev_pop(o_totalprice) AS a, stddev_pop(o_custkey) AS b FROM r),
d AS (SELECT avg((EXISTS (SELECT 1 FROM r WHERE r.o_totalprice = s.o_totalprice AND r.o_custkey = s.o_custkey AND r.o_orderpriority = s.o_orderpriority))::INT) AS dup FROM s),
nn AS (SELECT avg(near) AS near FROM (SELECT s.o_orderkey, min(sqrt(((s.o_totalprice - r.o_totalprice) / a) * ((s.o_totalprice - r.o_totalprice) / a) + ((s.o_custkey - r.o_custkey) / b) * ((s.o_custkey - r.o_custkey) / b))) AS near FROM s, r, z GROUP BY 1))
SELECT 'diversity' AS dimension, round((uniq + entropy) / 2 * (1 - greatest(0.0, top - 0.6) / 0.4), 6)::DOUBLE AS score FROM u, e UNION ALL SELECT 'fidelity', score FROM f UNION ALL SELECT 'bias', round(0.5 * entropy + 0.5 * (1 - gap), 6)::DOUBLE FROM e, g
UNION ALL SELECT 'privacy', round(1 - greatest(dup, 0.5 * dup + 0.5 * exp(-near)), 6)::DOUBLE FROM d, nn"""


@query("evaluation_report", _REPORT)
def evaluation_report(spark, d):
    return rounded(_report(spark, d)[0], "score")


@query("render_report_json")
def render_report_json(spark, d):
    scores, total = _report(spark, d)
    cards, all_ = [r.asDict() for r in scores.collect()], total.first()
    return spark.createDataFrame([(writers.report_json(all_["overall"], all_["band"], cards), writers.report_html(all_["overall"], all_["band"], cards))], "json string, html string")


# --- metadata and tasks -------------------------------------------------------------------------------------------------
@query("point_lookup", "SELECT * FROM supplier WHERE s_nationkey = 3")
def point_lookup(spark, d):
    return metadata.lookup(read(spark, d, "supplier"), s_nationkey=3)


@query("upsert", "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'changed' ELSE s_name END AS s_name FROM supplier")
def upsert(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_name")
    new = read(spark, d, "supplier").where("s_nationkey < 5").select("s_suppkey", F.lit("changed").alias("s_name"))
    return metadata.upsert(s, new, ["s_suppkey"])


@query("replace_scope", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey <> 4 UNION ALL SELECT -1, 4")
def replace_scope(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return metadata.replace(s, spark.createDataFrame([(-1, 4)], s.schema), ["s_nationkey"])


@query("delete_rows", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def delete_rows(spark, d):
    gone = read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return metadata.delete(read(spark, d, "supplier"), gone).select("s_suppkey")


@query("task_detection", "SELECT * FROM (VALUES ('documents', 'text_generic'), ('conversations', 'text_generic'), ('lineitem', 'tabular_classification'), ('orders', 'tabular_regression'), ('nation', 'tabular_generic')) t(name, task)")
def task_detection(spark, d):
    cols = lambda t: read(spark, d, t).columns
    rows = [("documents", evaluate.detect_task("text", cols("documents"))), ("conversations", evaluate.detect_task("text", cols("conversations"))), ("lineitem", evaluate.detect_task("tabular", cols("lineitem"), "l_returnflag")), ("orders", evaluate.detect_task("tabular", cols("orders"), "o_totalprice", True)), ("nation", evaluate.detect_task("tabular", cols("nation")))]
    return spark.createDataFrame(rows, "name string, task string")
