"""Sinks: tables in four formats, Arrow streams, manifests, reports, mapping sets, and property graphs in twelve formats.

Graph formats are projections to rows of text or triples, so any size is written by the executors; the short heads and
tails of single documents are rows too.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import cypher_escape, local_name, safe_filename
from tessera.operators.graph import Ontology
from tessera.operators.order import ordinals

#: Fixed value: rows beyond which a table is written as Parquet if no format is asked for.
LARGE_ROWS = 500_000
TABLE_FORMATS = ("parquet", "csv", "json", "arrow")
GRAPH_FORMATS = ("turtle", "ntriples", "jsonld", "rdfxml", "owl", "graphml", "gexf", "cypher", "neo4j_csv", "gnn", "parquet", "json")
BASE = "http://example.org/graph/"
RDF, RDFS, OWL, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"


def resolve_format(rows: int, wanted: str | None = None) -> str:
    return wanted or ("parquet" if rows > LARGE_ROWS else "csv")


def arrow_streams(df: DataFrame) -> DataFrame:
    """(part, stream): each partition's rows as one Arrow IPC stream."""
    schema = df.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as out:
            for b in batches:
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema)], schema=schema))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "stream"])

    return df.mapInArrow(run, "part int, stream binary")


def export(df: DataFrame, path: str, wanted: str | None = None) -> dict:
    """Write a table and say what was written; unknown formats are an error."""
    rows = df.count()
    kind = resolve_format(rows, wanted)
    if kind not in TABLE_FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    w = df.write.mode("errorifexists")
    if kind == "parquet":
        w.parquet(path)
    elif kind == "csv":
        w.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    elif kind == "json":
        w.option("ignoreNullFields", "false").json(path)
    else:
        arrow_streams(df).write.mode("errorifexists").parquet(path)
    return {"format": kind, "path": path, "rows": rows}


def manifest(df: DataFrame, order: str) -> DataFrame:
    """Records as JSON lines in the order of a column."""
    return df.orderBy(order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def report_json(overall: float, band: str, cards: list[dict]) -> str:
    return json.dumps({"overall": overall, "band": band, "cards": sorted(cards, key=lambda c: c["dimension"])}, sort_keys=True)


def report_html(overall: float, band: str, cards: list[dict]) -> str:
    rows = "".join(f"<section><h2>{html.escape(c['dimension'])}</h2><p>{c['score']:.3f}</p><p>{html.escape(c.get('rationale', ''))}</p></section>" for c in sorted(cards, key=lambda c: c["dimension"]))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Evaluation</title></head><body><h1>{overall:.3f} ({html.escape(band)})</h1>{rows}</body></html>"


def sssom(mappings: DataFrame) -> DataFrame:
    """Lines of a tab-separated mapping set, by subject, object and matcher; tabs and line ends in cells become blanks."""
    cols = ["subject_id", "predicate_id", "object_id", "confidence", "matcher"]
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ") for c in cols]
    return mappings.orderBy("subject_id", "object_id", "matcher").select(F.concat_ws("\t", *clean).alias("value"))


# --- graphs -------------------------------------------------------------------------------------------------------------
def _iri(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"<{BASE}{kind}/"), local_name(name), F.lit(">"))


def _quoted(x: Column) -> Column:
    """The text in double quotes, escaped as JSON and N-Triples both have it."""
    whole = F.to_json(F.struct(x.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _literal(x: Column) -> Column:
    """A literal in triple notation, typed by the look of its value."""
    kind = F.when(x.rlike(r"^-?\d+$"), "integer").when(x.rlike(r"^-?\d+\.\d+(?:[eE][-+]?\d+)?$"), "double").when(x.isin("true", "false"), "boolean").when(x.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), "dateTime")
    return F.when(kind.isNotNull(), F.concat(_quoted(x), F.lit(f"^^<{XSD}"), kind, F.lit(">"))).otherwise(_quoted(x))


def _props(df: DataFrame) -> DataFrame:
    return df.select("*", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v")).where("v is not null")


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, p, o): types, properties and edges; an edge's properties stand on a statement of its own."""
    rdf = lambda x: F.lit(f"<{RDF}{x}>")
    node = lambda c: _iri("node", F.col(c))
    n = nodes.select(node("id").alias("s"), rdf("type").alias("p"), _iri("type", F.col("type")).alias("o"))
    n = n.union(_props(nodes).select(node("id"), _iri("property", F.col("k")), _literal(F.col("v"))))
    e = edges.select(node("source"), _iri("relation", F.col("type")), node("target"))
    p = _props(edges)
    st = F.concat(F.lit("_:stmt-"), local_name(F.col("id")))
    owners = p.select("id", "source", "type", "target").distinct()
    r = owners.select(st, rdf("type"), rdf("Statement")).union(owners.select(st, rdf("subject"), node("source"))).union(owners.select(st, rdf("predicate"), _iri("relation", F.col("type")))).union(owners.select(st, rdf("object"), node("target")))
    return n.union(e).union(r).union(p.select(st, _iri("property", F.col("k")), _literal(F.col("v"))))


def ntriples(t: DataFrame) -> DataFrame:
    return t.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


#: Triples of a block; a subject of more has several blocks, which all three syntaxes allow.
TRIPLES = 1000


def _dealt(t: DataFrame) -> DataFrame:
    """Triples with ``b``, the number of their block within the subject's."""
    many = t.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > TRIPLES).select("s", F.ceil(F.col("n") / TRIPLES).cast("int").alias("parts"))
    return t.join(many, "s", "left").withColumn("b", F.coalesce(F.pmod(F.xxhash64("p", "o"), "parts"), F.lit(0))).drop("parts")


def turtle(t: DataFrame) -> DataFrame:
    """One block a subject, or several of a subject of many triples."""
    own = _dealt(t).groupBy("s", "b").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "o"))).alias("po"))
    return own.select(F.concat(F.col("s"), F.lit(" "), F.array_join("po", " ;\n    "), F.lit(" .")).alias("value"))


def _parts(df: DataFrame, head: str, tail: str) -> DataFrame:
    """(part, value): a document's head, its rows and its tail; sorted by part they are the document."""
    one = lambda part, text: df.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit(text).alias("value"))
    return one(0, head).union(df.select(F.lit(1).alias("part"), "value")).union(one(2, tail))


def _bare(c: str) -> Column:
    return F.regexp_replace(c, "^<|>$", "")


def _quote_of(o: str) -> Column:
    """A literal's quoted text; empty for a resource."""
    return F.regexp_extract(o, r'(?s)^(".*")(?:\^\^<[^<>]*>)?$', 1)


def _datatype_of(o: str) -> Column:
    return F.regexp_extract(o, r'(?s)^".*"\^\^<([^<>]*)>$', 1)


def jsonld(t: DataFrame) -> DataFrame:
    """(part, value): an expanded JSON-LD document, a line for each subject's block; the list's first element is an empty node, which means nothing."""
    text, kind = _quote_of("o"), _datatype_of("o")
    value = F.when(text == "", F.concat(F.lit('{"@id":'), _quoted(_bare("o")), F.lit("}"))).when(kind == "", F.concat(F.lit('{"@value":'), text, F.lit("}"))).otherwise(F.concat(F.lit('{"@value":'), text, F.lit(',"@type":'), _quoted(kind), F.lit("}")))
    is_type = F.col("p") == f"<{RDF}type>"
    key, value = F.when(is_type, F.lit('"@type"')).otherwise(_quoted(_bare("p"))), F.when(is_type, _quoted(_bare("o"))).otherwise(value)
    by = _dealt(t).select("s", "b", key.alias("k"), value.alias("v")).groupBy("s", "b", "k").agg(F.array_sort(F.collect_set("v")).alias("v"))
    own = by.select("s", "b", F.concat("k", F.lit(":["), F.array_join("v", ","), F.lit("]")).alias("m")).groupBy("s", "b").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return _parts(own.select(F.concat(F.lit(',{"@id":'), _quoted(_bare("s")), F.lit(","), F.array_join("m", ","), F.lit("}")).alias("value")), "[{}", "]")


def rdfxml(t: DataFrame) -> DataFrame:
    """(part, value): an RDF/XML document, a description for each subject's block.

    A predicate's name in XML is the longest end of its IRI that may be one; an IRI without such an end is an error."""
    name = F.regexp_extract(_bare("p"), r"([A-Za-z_][A-Za-z0-9_-]*)$", 1)
    name = F.when(name == "", F.raise_error(F.concat(F.lit("no name in XML for "), "p"))).otherwise(name)
    ns = F.substr(_bare("p"), F.lit(1), F.length(_bare("p")) - F.length(name))
    blank = lambda c, full, node: F.when(F.col(c).startswith("_:"), F.concat(F.lit(f'{node}="'), F.substr(F.col(c), F.lit(3)))).otherwise(F.concat(F.lit(f'{full}="'), _xml(_bare(c))))
    text = F.from_json(F.concat(F.lit('{"v":'), _quote_of("o"), F.lit("}")), "v string")["v"]
    kind = F.when(_datatype_of("o") != "", F.concat(F.lit(' rdf:datatype="'), _xml(_datatype_of("o")), F.lit('"'))).otherwise("")
    head = F.concat(F.lit("<q:"), name, F.lit(' xmlns:q="'), _xml(ns), F.lit('"'))
    line = F.when(_quote_of("o") == "", F.concat(head, F.lit(" "), blank("o", "rdf:resource", "rdf:nodeID"), F.lit('"/>'))).otherwise(F.concat(head, kind, F.lit(">"), _xml(text), F.lit("</q:"), name, F.lit(">")))
    own = _dealt(t).select("s", "b", line.alias("l")).groupBy("s", "b").agg(F.array_sort(F.collect_list("l")).alias("l"))
    body = own.select(F.concat(F.lit("<rdf:Description "), blank("s", "rdf:about", "rdf:nodeID"), F.lit('">'), F.array_join("l", ""), F.lit("</rdf:Description>")).alias("value"))
    return _parts(body, f'<?xml version="1.0" encoding="UTF-8"?><rdf:RDF xmlns:rdf="{RDF}">', "</rdf:RDF>")


def owl(spark, ontology: Ontology) -> DataFrame:
    """(s, p, o) of an ontology: classes, object properties with domain and range, datatype properties named by type and property."""
    iri = lambda kind, name: f"<{BASE}{kind}/{name}>"
    rows = []
    for t in ontology.nodes:
        rows.append((iri("type", t.name), f"<{RDF}type>", f"<{OWL}Class>"))
        if t.subclass_of:
            rows.append((iri("type", t.name), f"<{RDFS}subClassOf>", iri("type", t.subclass_of)))
        for p in t.props:
            s = iri("property", f"{t.name}.{p.name}")
            rows += [(s, f"<{RDF}type>", f"<{OWL}DatatypeProperty>"), (s, f"<{RDFS}domain>", iri("type", t.name)), (s, f"<{RDFS}range>", f"<{XSD}{ {'float': 'double', 'datetime': 'dateTime'}.get(p.datatype, p.datatype)}>")]
    for e in ontology.edges:
        s = iri("relation", e.name)
        rows += [(s, f"<{RDF}type>", f"<{OWL}ObjectProperty>"), (s, f"<{RDFS}domain>", iri("type", e.source)), (s, f"<{RDFS}range>", iri("type", e.target))]
    return spark.createDataFrame(rows, "s string, p string, o string")


def _xml(x: Column) -> Column:
    """Text for an XML element or attribute; characters that XML can't hold become the replacement character."""
    x = F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "\ufffd")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def property_names(df: DataFrame, kind: str | None = None) -> list[str]:
    """Names of properties in order, of one type or of all; as many as the schema has come to the driver."""
    own = df if kind is None else df.where(F.col("type") == kind)
    return sorted(r["k"] for r in own.select(F.explode(F.json_object_keys("props")).alias("k")).distinct().collect())


def _entries(reserved: tuple[str, ...] = ()) -> Column:
    """Properties as (key, value) in order of their keys, without nulls and reserved names."""
    held = F.array_sort(F.map_entries(F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))))
    return F.filter(held, lambda e: e["value"].isNotNull() & ~e["key"].isin(*reserved)) if reserved else F.filter(held, lambda e: e["value"].isNotNull())


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): head with the keys, node, edge and tail lines; sorted by part they make a GraphML document."""
    data = lambda: F.array_join(F.transform(_entries(("type",)), lambda e: F.concat(F.lit('<data key="'), _xml(e["key"]), F.lit('">'), _xml(e["value"]), F.lit("</data>"))), "")
    one = lambda part, text: nodes.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit(text).alias("value"))
    esc = lambda x: html.escape(x, quote=True)
    keys = "".join(f'<key id="{esc(k)}" for="all" attr.name="{esc(k)}" attr.type="string"/>' for k in sorted({"type", *property_names(nodes), *property_names(edges)}))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="type">'), _xml(F.col("type")), F.lit("</data>"), data(), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge id="'), _xml(F.col("id")), F.lit('" source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('"><data key="type">'), _xml(F.col("type")), F.lit("</data>"), data(), F.lit("</edge>")).alias("value"))
    return one(0, f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">').union(n).union(e).union(one(3, "</graph></graphml>"))


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): head with the attributes, node, edge and tail lines; sorted by part they make a GEXF document."""
    one = lambda part, text: nodes.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit(text).alias("value"))
    esc = lambda x: html.escape(x, quote=True)
    declare = lambda kind, names: f'<attributes class="{kind}">' + "".join(f'<attribute id="{esc(k)}" title="{esc(k)}" type="string"/>' for k in names) + "</attributes>"
    values = lambda: F.concat(F.lit("<attvalues>"), F.array_join(F.transform(_entries(), lambda e: F.concat(F.lit('<attvalue for="'), _xml(e["key"]), F.lit('" value="'), _xml(e["value"]), F.lit('"/>'))), ""), F.lit("</attvalues>"))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('" label="'), _xml(F.col("type")), F.lit('">'), values(), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(3).alias("part"), F.concat(F.lit('<edge id="'), _xml(F.col("id")), F.lit('" label="'), _xml(F.col("type")), F.lit('" source="'), _xml(F.col("source")), F.lit('" target="'), _xml(F.col("target")), F.lit('">'), values(), F.lit("</edge>")).alias("value"))
    head = f'<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">{declare("node", property_names(nodes))}{declare("edge", property_names(edges))}<nodes>'
    return one(0, head).union(n).union(one(2, "</nodes><edges>")).union(e).union(one(4, "</edges></graph></gexf>"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, value): a CREATE for each node, then a MATCH and CREATE for each edge; sorted by part and id."""
    fields = F.array_join(F.transform(_entries(("_nid", "_eid")), lambda e: F.concat(F.lit(", "), local_name(e["key"]), F.lit(": '"), cypher_escape(e["value"]), F.lit("'"))), "")
    q = lambda c: F.concat(F.lit("'"), cypher_escape(F.col(c)), F.lit("'"))
    n = nodes.select(F.lit(0).alias("part"), "id", F.concat(F.lit("CREATE (:"), local_name(F.col("type")), F.lit(" {_nid: "), q("id"), fields, F.lit("});")).alias("value"))
    e = edges.select(F.lit(1).alias("part"), "id", F.concat(F.lit("MATCH (a {_nid: "), q("source"), F.lit("}), (b {_nid: "), q("target"), F.lit("}) CREATE (a)-[:"), local_name(F.col("type")), F.lit(" {_eid: "), q("id"), fields, F.lit("}]->(b);")).alias("value"))
    return n.union(e)


def _held(props: list[str]) -> list[Column]:
    """The listed properties, empty where missing."""
    fields = F.from_json("props", "map<string,string>")
    return [F.coalesce(fields[p], F.lit("")).alias(p) for p in props]


def neo4j_nodes(nodes: DataFrame, kind: str, props: list[str] | None = None) -> DataFrame:
    """The node file of one type: id, label, and the listed properties, by default all that the type's nodes have."""
    props = property_names(nodes, kind) if props is None else props
    return nodes.where(F.col("type") == kind).select(F.col("id").alias("id:ID"), F.col("type").alias(":LABEL"), *_held(props))


def neo4j_edges(edges: DataFrame, kind: str, props: list[str] | None = None) -> DataFrame:
    """The edge file of one type: its ends, its type, and its properties."""
    props = property_names(edges, kind) if props is None else props
    return edges.where(F.col("type") == kind).select(F.col("source").alias(":START_ID"), F.col("target").alias(":END_ID"), F.col("type").alias(":TYPE"), *_held(props))


def neo4j_csv(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, part, id, value): lines of one CSV file for each type of node and of edge, headers first; files, parts and ids in order."""
    cell = lambda x: F.when(x.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    plain = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in '",\r\n') else x
    out = []
    for df, name, ends, head in ((nodes, "nodes", ("id", "type"), ["id:ID", ":LABEL"]), (edges, "edges", ("source", "target", "type"), [":START_ID", ":END_ID", ":TYPE"])):
        keys: dict[str, list[str]] = {}
        for r in df.select("type", F.explode_outer(F.json_object_keys("props")).alias("k")).distinct().collect():
            keys.setdefault(r["type"], []).extend([r["k"]] if r["k"] is not None else [])
        file = F.concat(F.lit(f"{name}_"), safe_filename(F.col("type")), F.lit(".csv"))
        fields = F.from_json("props", "map<string,string>")
        own = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.array(*map(F.lit, sorted(k))).cast("array<string>") for k in keys.values()])) if keys else F.create_map().cast("map<string,array<string>>")
        cells = F.concat(F.array(*[cell(F.col(c)) for c in ends]), F.transform(own[F.col("type")], lambda k: cell(F.coalesce(fields[k], F.lit("")))))
        out.append(df.select(file.alias("file"), F.lit(1).alias("part"), "id", F.array_join(cells, ",").alias("value")))
        heads = [(k, ",".join(map(plain, [*head, *sorted(v)]))) for k, v in keys.items()]
        out.append(df.sparkSession.createDataFrame(heads, "type string, value string").select(file.alias("file"), F.lit(0).alias("part"), F.lit("").alias("id"), "value"))
    return out[0].union(out[1]).union(out[2]).union(out[3])


def gnn_edge_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): edges by the places of their ends in id order; dangling ones drop."""
    at = ordinals(nodes.select("id"), ["id"])
    return edges.join(at.select(F.col("id").alias("source"), F.col("_i").alias("src")), "source").join(at.select(F.col("id").alias("target"), F.col("_i").alias("dst")), "target").select("src", "dst")


def gnn_one_hot(nodes: DataFrame) -> DataFrame:
    """(idx, one_hot): node types in name order. The list of types is as long as each row that is made of it."""
    kinds = nodes.agg(F.array_sort(F.collect_set("type")).alias("kinds"))
    rows = ordinals(nodes.select("id", "type"), ["id"]).crossJoin(F.broadcast(kinds))
    return rows.select(F.col("_i").alias("idx"), F.transform("kinds", lambda k: (k == F.col("type")).cast("int")).alias("one_hot"))


def edge_list(edges: DataFrame, ontology: Ontology) -> DataFrame:
    o = F.broadcast(ontology.edge_frame(edges.sparkSession).select(F.col("name").alias("type"), "directed").distinct())
    return edges.join(o, "type", "left").select(F.col("id").alias("edge_id"), "source", "target", "type", F.coalesce("directed", F.lit(True)).alias("directed"))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, value): nodes and edges as JSON objects with keys in order, to be joined in order of part and id."""
    n = nodes.select(F.lit("nodes").alias("part"), "id", F.to_json(F.struct("id", F.parse_json("props").alias("properties"), "type")).alias("value"))
    return n.union(edges.select(F.lit("edges").alias("part"), "id", F.to_json(F.struct("id", F.parse_json("props").alias("properties"), "source", "target", "type")).alias("value")))


def export_graph(nodes: DataFrame, edges: DataFrame, ontology: Ontology, kind: str) -> DataFrame:
    """A graph in one of twelve formats, as rows; text has a column ``value``, whose order the columns before it give."""
    spark = nodes.sparkSession
    made = {
        "turtle": lambda: turtle(triples(nodes, edges)), "ntriples": lambda: ntriples(triples(nodes, edges)), "jsonld": lambda: jsonld(triples(nodes, edges)), "rdfxml": lambda: rdfxml(triples(nodes, edges)),
        "owl": lambda: ntriples(owl(spark, ontology)), "graphml": lambda: graphml(nodes, edges), "gexf": lambda: gexf(nodes, edges), "cypher": lambda: cypher(nodes, edges),
        "neo4j_csv": lambda: neo4j_csv(nodes, edges), "gnn": lambda: gnn_edge_index(nodes, edges), "parquet": lambda: edge_list(edges, ontology), "json": lambda: node_link(nodes, edges),
    }
    if kind not in made:
        raise ValueError(f"unknown graph format {kind!r}")
    return made[kind]()


def write_graph(nodes: DataFrame, edges: DataFrame, ontology: Ontology, kind: str, path: str) -> dict:
    """Write a graph and say what was written: files of text in the order of their names, or of Parquet; ``neo4j_csv`` is a folder for each file."""
    out = export_graph(nodes, edges, ontology, kind)
    if "value" not in out.columns:
        out.write.mode("errorifexists").parquet(path)
    elif kind == "neo4j_csv":
        out.orderBy("file", "part", "id").select("file", "value").write.mode("errorifexists").partitionBy("file").text(path)
    else:
        order = [c for c in out.columns if c != "value"]
        (out.orderBy(*order) if order else out).select("value").write.mode("errorifexists").text(path)
    return {"format": kind, "path": path, "rows": nodes.count() + edges.count()}
