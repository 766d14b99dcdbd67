"""Queries of the remaining scalar functions, generators, templates, dispatchers and evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions.rng import u01
from tessera.functions.rng import u01_sql as u
from tessera.functions.shared import cut
from tessera.operators import generate as G
from tessera.operators import graph_build as B
from tessera.operators import perturb as P
from tessera.operators import templates
from tessera.operators.order import ordinals
from tessera.plans import evaluate
from tessera.plans.files import _folder as folder
from tessera.plans.graphs import NODES, ONTOLOGY, _halves, _proposed, party
from tessera.plans.registry import query, read
from tessera.plans.rows import _int, _pick, _progress_sql, _typo_sql, word_typos_sql
from tessera.sources import writers

_DRAW = "(('0x' || substr(md5(concat_ws(':', '9', 'mask', conv_id::VARCHAR, turn::VARCHAR, (i - 1)::VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"


@query("mask_words", f"SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN {_DRAW} < 0.3 THEN '[MASK]' ELSE w END), ' ') AS text FROM conversations")
def mask_words(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", S.mask_words(F.col("text"), 0.3, lambda i: u01(9, "mask", "conv_id", "turn", i)).alias("text"))


@query("char_typos", f"SELECT item_id, {_typo_sql('0.2', 'text', 'item_id::VARCHAR', 'text')} AS text FROM benchmark")
def char_typos(spark, d):
    return P.text_noise(read(spark, d, "benchmark").select("item_id", "text"), "text", ["item_id"], 9, 0.2, "char")


@query("word_typos", f"SELECT item_id, {word_typos_sql('0.2', 'item_id::VARCHAR')} AS text FROM benchmark")
def word_typos(spark, d):
    return P.text_noise(read(spark, d, "benchmark").select("item_id", "text"), "text", ["item_id"], 9, 0.2, "word")


@query("local_name", "SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_-]', '_', 'g') AS name FROM part")
def local_name(spark, d):
    return read(spark, d, "part").select("p_partkey", S.local_name(F.col("p_name")).alias("name"))


@query("datatype_ok", "SELECT event_id, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AS is_integer, json_type(props, '$.k') = 'VARCHAR' AS is_string FROM events")
def datatype_ok(spark, d):
    k = F.try_variant_get(F.parse_json("props"), "$.k", "variant")
    return read(spark, d, "events").select("event_id", S.datatype_ok("integer", k).alias("is_integer"), S.datatype_ok("string", k).alias("is_string"))


@query("constraints_ok", "SELECT c_custkey, c_acctbal >= 0 AND c_acctbal <= 9000 AS bounds, c_mktsegment IN ('BUILDING', 'MACHINERY') AS choice FROM customer")
def constraints_ok(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").between(0.0, 9000.0).alias("bounds"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("choice"))


@query("node_label", f"SELECT id, type || ' ' || id AS label FROM {NODES}")
def node_label(spark, d):
    return party(spark, d)[0].select("id", F.concat_ws(" ", F.coalesce(F.get_json_object("props", "$.label"), F.col("type")), "id").alias("label"))


@query("fake_pii", f"SELECT c_custkey, {_pick(u(13, 'full:first', 'c_custkey'), G.FIRST)} || ' ' || {_pick(u(13, 'full:last', 'c_custkey'), G.LAST)} AS name FROM customer")
def fake_pii(spark, d):
    return read(spark, d, "customer").select("c_custkey", G.generated(G.FieldSpec("full", "name"), 13, F.col("c_custkey")).alias("name"))


@query("synthesize", f"SELECT p_partkey, {_int(u(13, 'size', 'p_partkey'), 1, 49)} AS size, ({u(13, 'flag', 'p_partkey')} < 0.5) AS flag FROM part")
def synthesize(spark, d):
    """Values by datatype; the upper bound of integers is left out."""
    key = F.col("p_partkey")
    return read(spark, d, "part").select("p_partkey", G.generated(G.FieldSpec("size", "integer", constraints={"min": 1, "max": 49}), 13, key).alias("size"), G.generated(G.FieldSpec("flag", "boolean"), 13, key).alias("flag"))


def _canned(first: int, size: int, attempt: int) -> list[dict]:
    """A provider that gives an empty row in each batch's first attempt."""
    return [{"question": f"What is {first + i}?", "answer": "" if not attempt and not i else str(first + i)} for i in range(size)]


@query("gen_text", "SELECT id, 'What is ' || n || '?' AS question, n::VARCHAR AS answer FROM (SELECT range AS id, range // 20 * 20 + (range % 20 + 1) % 20 AS n FROM range(200))")
def gen_text(spark, d):
    return G.text_rows(spark, 200, _canned, ["question", "answer"])




@query("temporal_trend", f"SELECT event_id, round(coalesce(json_extract(props, '$.k')::DOUBLE, 0) + 2.0 * 0.25 * (row_number() OVER (ORDER BY ts, event_id) - 1) / (n - 1), 6)::DOUBLE AS level FROM events, (SELECT count(*) AS n FROM events)")
def temporal_trend(spark, d):
    """A trend of given size along time on a value out of JSON."""
    e = read(spark, d, "events")
    rows = ordinals(e.select("event_id", "ts", F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)).alias("level")), ["ts", "event_id"])
    return rows.select("event_id", F.round(F.col("level") + 2.0 * 0.25 * F.col("_i") / (F.col("_n") - 1), 6).alias("level"))


@query("text_progressive_typos", f"SELECT item_id, spoiled AS text FROM {_progress_sql('benchmark', 'item_id', 'item_id::VARCHAR', '0.5::DOUBLE')}")
def text_progressive_typos(spark, d):
    return P.text_progressive(read(spark, d, "benchmark").select("item_id", "text"), "text", ["item_id"], 9, 0.5)


@query("render_report_html")
def render_report_html(spark, d):
    """The report of one table without a reference, as a page."""
    scores, total = evaluate.run(read(spark, d, "part"), task="text_generic", columns={"text": "p_name"})
    cards, all_ = [r.asDict() for r in scores.collect()], total.first()
    return spark.createDataFrame([(writers.report_html(all_["overall"], all_["band"], cards),)], "html string")


# --- templates, dispatch and records ------------------------------------------------------------------------------------
@query("template_catalog", """SELECT * FROM (VALUES ('customers', 'crm', 1000, 5, 'full_name,email,signup_date,plan,country'), ('transactions', 'finance', 5000, 4, 'amount,currency,timestamp,is_fraud'), ('support_tickets', 'support', 2000, 5, 'subject,priority,status,created_at,resolved'),
('sensor_readings', 'iot', 10000, 5, 'sensor_id,temperature,humidity,reading_at,anomaly'), ('users_churn', 'ml-labels', 3000, 5, 'age,tenure_months,monthly_spend,plan,churned')) t(key, category, rows, n_fields, fields)""")
def template_catalog(spark, d):
    return spark.createDataFrame([(k, t.category, t.rows, len(t.fields), ",".join(f.name for f in t.fields)) for k, t in templates.TEMPLATES.items()], "key string, category string, rows int, n_fields int, fields string")


@query("template_transactions", f"SELECT round({u(4, 'amount', 'range')} * 4999.0 + 1.0, 6)::DOUBLE AS amount, {_pick(u(4, 'currency', 'range'), ('USD', 'EUR', 'GBP'))} AS currency, ({u(4, 'is_fraud', 'range')} < 0.5) AS is_fraud FROM range(5000)")
def template_transactions(spark, d):
    return templates.generate(spark, "transactions", 4).select(F.round("amount", 6).alias("amount"), "currency", "is_fraud")


@query("template_churn", f"SELECT {_int(u(4, 'age', 'range'), 18, 90)} AS age, {_pick(u(4, 'plan', 'range'), ('free', 'pro', 'enterprise'))} AS plan, ({u(4, 'rule0:churned', 'range')} < 0.02 OR {u(4, 'churned', 'range')} < 0.5) AS churned FROM range(3000)")
def template_churn(spark, d):
    return templates.generate(spark, "users_churn", 4).select("age", "plan", "churned")


@query("synthesizer_dispatch", "SELECT * FROM (VALUES ('copula', 'Copula'), ('ctgan', 'NotImplementedError'), ('tvae', 'NotImplementedError'), ('sdv', 'NotImplementedError'), ('odd', 'ValueError')) t(method, outcome)")
def synthesizer_dispatch(spark, d):
    def outcome(method: str) -> str:
        try:
            return G.synthesizer(method).__name__
        except (NotImplementedError, ValueError) as e:
            return type(e).__name__

    return spark.createDataFrame([(m, outcome(m)) for m in ("copula", "ctgan", "tvae", "sdv", "odd")], "method string, outcome string")


@query("export_records", "SELECT * FROM (VALUES ('csv'), ('json'), ('parquet'), ('arrow'), ('auto')) f(asked) JOIN (VALUES ('csv', 'csv'), ('json', 'json'), ('parquet', 'parquet'), ('arrow', 'arrow'), ('auto', 'csv')) w(asked, format) USING (asked), (SELECT count(*) AS rows FROM supplier)")
def export_records(spark, d):
    """What the export driver says that it wrote, for each format and for none asked for."""
    rows = read(spark, d, "supplier")
    made = [(kind, writers.export(rows, f"{folder(spark)}.{kind}", None if kind == "auto" else kind)) for kind in (*writers.TABLE_FORMATS, "auto")]
    return spark.createDataFrame([(kind, m["format"], m["rows"]) for kind, m in made], "asked string, format string, rows long")


@query("graph_export_records", "SELECT f AS format, rows FROM (VALUES ('turtle'), ('ntriples'), ('jsonld'), ('rdfxml'), ('owl'), ('graphml'), ('gexf'), ('cypher'), ('neo4j_csv'), ('gnn'), ('parquet'), ('json')) t(f), (SELECT (SELECT count(*) FROM region) + 2 * (SELECT count(*) FROM nation) AS rows)")
def graph_export_records(spark, d):
    """What the graph export driver says that it wrote, for each format, of regions and nations."""
    n, e = party(spark, d)
    n, e = cut(n.where("type in ('Region', 'Nation')")), cut(e.where("type = 'IN_REGION'"))
    made = [writers.write_graph(n, e, ONTOLOGY, kind, folder(spark)) for kind in writers.GRAPH_FORMATS]
    return spark.createDataFrame([(m["format"], m["rows"]) for m in made], "format string, rows long")


@query("graph_engine", "SELECT * FROM (VALUES ('sample', 50), ('topology', 60), ('hybrid', 40)) t(engine, n_nodes) UNION ALL SELECT 'rows', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)")
def graph_engine(spark, d):
    """Which builder serves each request, and the nodes it makes."""
    proposed = _proposed(spark, d)
    asked = [({"sample": party(spark, d)}, 50), ({"topology": "lfr"}, 60), ({"topology": "stochastic_block_model", "rows": (proposed[0], proposed[1])}, 40), ({"rows": proposed}, 0)]
    made = [(B.engine(**{k: v for k, v in a.items()}), B.build(spark, n, 3, ONTOLOGY, **a)[0].count()) for a, n in asked]
    return spark.createDataFrame(made, "engine string, n_nodes long")


@query("metric_providers", """SELECT task, unnest(string_split(metrics, ',')) AS metric FROM (VALUES ('text_classification', 'class_balance,duplicate_rate'), ('question_answering', 'answerable_rate,question_type_diversity'), ('summarization', 'compression_ratio,abstractiveness'),
('chat', 'turn_validity'), ('text_generic', 'duplicate_rate'), ('tabular_classification', 'label_balance,feature_completeness'), ('tabular_regression', 'target_range_validity,target_distribution_health'), ('tabular_generic', 'duplicate_rate'), ('image', 'prompt_diversity,label_balance'),
('audio', 'duration_uniformity'), ('video', 'fps_consistency,resolution_consistency'), ('graph_qa', 'answerable,multi_hop,grounded'), ('generic', 'duplicate_rate')) t(task, metrics)""")
def metric_providers(spark, d):
    return spark.createDataFrame([(t, m) for t in evaluate.TASKS for m in evaluate.providers(t)], "task string, metric string")


@query("task_metrics", """SELECT 'label_balance' AS metric, round(-sum(p * ln(p)) / ln(count(*)), 6)::DOUBLE AS value FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY l_returnflag) UNION ALL SELECT 'feature_completeness', 1.0""")
def task_metrics(spark, d):
    """The metrics of the task that the table is for."""
    li = read(spark, d, "lineitem")
    task = evaluate.detect_task("tabular", li.columns, "l_returnflag")
    return evaluate.task_metrics(li, task, {"label": "l_returnflag"}).select("metric", F.round("value", 6).alias("value"))


@query("judge_selection", """SELECT * FROM (VALUES ('alone', 'diversity'), ('fair', 'diversity'), ('fair', 'bias'), ('task', 'diversity'), ('task', 'task_quality'), ('full', 'diversity'), ('full', 'fidelity'), ('full', 'privacy'), ('full', 'utility'), ('full', 'bias'), ('full', 'task_quality'),
('graph', 'graph_connectivity'), ('graph', 'graph_ontology'), ('graphs', 'graph_connectivity'), ('graphs', 'graph_ontology'), ('graphs', 'graph_privacy'), ('graphs', 'graph_structure'), ('graphs', 'graph_utility')) t(asked, dimension)""")
def judge_selection(spark, d):
    """Which judges apply to what is given."""
    s, g = read(spark, d, "customer"), party(spark, d)
    cases = {
        "alone": evaluate.table_judges(s), "fair": evaluate.table_judges(s, sensitive="c_mktsegment", outcome="c_acctbal"), "task": evaluate.table_judges(s, task="tabular_generic"),
        "full": evaluate.table_judges(s, s, "c_custkey", "c_mktsegment", "c_acctbal", "c_mktsegment", "tabular_classification"), "graph": evaluate.graph_judges(g, None, ONTOLOGY), "graphs": evaluate.graph_judges(g, g, ONTOLOGY),
    }
    return spark.createDataFrame([(k, name) for k, able in cases.items() for name, _ in able], "asked string, dimension string")


@query("graph_evaluation_report")
def graph_evaluation_report(spark, d):
    """Scores of a graph against another by all graph judges."""
    a, b = _halves(spark, d)
    return evaluate.run_graph(tuple(map(cut, a)), tuple(map(cut, b)), ONTOLOGY)[0].select("dimension", F.round("score", 6).alias("score"))
