"""Sources: tables by extension, JSON documents and manifests, graphs, question sets and mapping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH_NODE = "id string, type string, properties string"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A table by its extension; others are an error."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind == "jsonl":
        return spark.read.json(path)
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    raise ValueError(f"can't read {kind!r} files")


def scan_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON document that is a list of them, or has them under ``items``."""
    text = spark.read.option("wholetext", True).text(path)
    listed = F.coalesce(F.get_json_object("value", "$.items"), F.col("value"))
    return text.select(F.explode(F.from_json(listed, f"array<struct<{schema}>>")).alias("r")).select("r.*")


def scan_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link document; properties stay JSON text."""
    text = spark.read.option("wholetext", True).text(path)
    if text.where(F.get_json_object("value", "$.nodes").isNull() | F.get_json_object("value", "$.edges").isNull()).limit(1).count():
        raise ValueError("a graph document needs nodes and edges")
    part = lambda name, schema: text.select(F.explode(F.from_json(F.get_json_object("value", f"$.{name}"), f"array<struct<{schema}>>")).alias("r")).select("r.*")
    return part("nodes", GRAPH_NODE).withColumnRenamed("properties", "props"), part("edges", "id string, type string, source string, target string, properties string").withColumnRenamed("properties", "props")


def scan_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file: types by their data keys ``type``, ``label`` or ``labels``, ``Node`` and ``REL`` without; other data of nodes are properties."""
    data = "data ARRAY<STRUCT<_key: STRING, _VALUE: STRING>>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(f"{schema}, {data}").load(path)
    entries = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"])))
    n = read("node", "_id STRING").withColumn("m", entries)
    rest = F.map_filter("m", lambda k, v: ~k.isin("type", "label", "labels"))
    nodes = n.select(F.col("_id").alias("id"), F.coalesce(F.col("m")["type"], F.col("m")["label"], F.col("m")["labels"], F.lit("Node")).alias("type"), F.to_json(rest).alias("props"))
    e = read("edge", "_id STRING, _source STRING, _target STRING").withColumn("m", entries)
    name = F.coalesce(F.col("m")["type"], F.col("m")["label"], F.lit("REL"))
    edges = e.select(F.coalesce("_id", F.md5(F.concat_ws("|", name, "_source", "_target"))).alias("id"), name.alias("type"), F.col("_source").alias("source"), F.col("_target").alias("target"), F.lit("{}").alias("props"))
    return nodes, edges


def scan_qa(spark: SparkSession, path: str) -> DataFrame:
    return scan_manifest(spark, path, "id string, question string, answer string, type string, hops int")


def scan_sssom(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """(preamble, mappings) of a tab-separated mapping set; unknown predicates become relatedMatch."""
    lines = spark.read.text(path)
    head = dict(x["value"][1:].strip().partition(": ")[::2] for x in lines.where(F.col("value").startswith("#")).limit(100).collect())
    rows = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(path)
    known = F.element_at(F.split("predicate_id", ":"), -1)
    return head, rows.withColumn("predicate_id", F.when(known.isin("exactMatch", "closeMatch", "relatedMatch", "broadMatch", "narrowMatch"), known).otherwise("relatedMatch"))
