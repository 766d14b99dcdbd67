"""Queries of the task metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import task_metrics as M
from tessera.plans.registry import query, read
from tessera.plans.tables import r6, rounded, strip_sql


def _balance_sql(table: str, c: str, name: str = "balance") -> str:
    return f"SELECT round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6)::DOUBLE AS {name} FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})"


@query("class_balance", _balance_sql("documents", "lang"))
def class_balance(spark, d):
    return rounded(M.balance(read(spark, d, "documents"), "lang"), "balance")


@query("label_balance", _balance_sql("events", "event_type"))
def label_balance(spark, d):
    return rounded(M.balance(read(spark, d, "events"), "event_type"), "balance")


@query("duplicate_rate", "SELECT round(1 - count(DISTINCT text) / count(*)::DOUBLE, 6) AS duplicate_rate FROM documents")
def duplicate_rate(spark, d):
    return read(spark, d, "documents").agg(r6(M.duplicate_rate("text"), "duplicate_rate"))


_GUESS = "(SELECT quality AS t, CASE WHEN length(text) - length(replace(replace(replace(text, '%', ''), '|', ''), '!', '')) > 5 THEN 0 ELSE 1 END AS g FROM documents JOIN labels USING (doc_id))"
_F1 = f"""SELECT round(sum(hit) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(CASE WHEN hit > 0 THEN 2 * hit / (support + said)::DOUBLE ELSE 0 END), 6) AS macro_f1 FROM
(SELECT t, count(*) AS support, count(*) FILTER (WHERE t = g) AS hit, (SELECT count(*) FROM {_GUESS} x WHERE x.g = y.t) AS said FROM {_GUESS} y GROUP BY t)"""


def _guess(spark, d):
    marks = F.length("text") - F.length(F.regexp_replace("text", "[%|!]", ""))
    docs = read(spark, d, "documents").select("doc_id", F.when(marks > 5, 0).otherwise(1).alias("g"))
    return docs.join(read(spark, d, "labels"), "doc_id")


@query("macro_f1", _F1)
def macro_f1(spark, d):
    return rounded(M.macro_f1(_guess(spark, d), "quality", "g"), "accuracy", "macro_f1")


@query("accuracy", f"SELECT accuracy FROM ({_F1})")
def accuracy(spark, d):
    return rounded(M.macro_f1(_guess(spark, d), "quality", "g").select("accuracy"), "accuracy")


@query("feature_completeness", "SELECT round(1 - (avg(CASE WHEN TRY_CAST(event_type AS DOUBLE) IS NULL THEN 1.0 ELSE 0 END) + avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END)) / 2, 6)::DOUBLE AS completeness FROM events")
def feature_completeness(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").try_cast("double").alias("a"), "value", "event_id")
    return rounded(M.feature_completeness(e, "event_id"), "completeness")


@query("target_range_validity", "SELECT round(avg(CASE WHEN isfinite(TRY_CAST(l_shipmode AS DOUBLE)) THEN 1.0 ELSE 0 END), 6)::DOUBLE AS text_share, round(avg(CASE WHEN isfinite(value) THEN 1.0 ELSE 0 END), 6)::DOUBLE AS value_share FROM (SELECT event_type AS l_shipmode, value FROM events)")
def target_range_validity(spark, d):
    return read(spark, d, "events").agg(r6(M.range_validity(F.col("event_type")), "text_share"), r6(M.range_validity(F.col("value")), "value_share"))


@query("target_distribution_health", "SELECT round(1 - least(1.0, abs(skewness(o_totalprice)) / 10), 6)::DOUBLE AS health FROM orders")
def target_distribution_health(spark, d):
    return read(spark, d, "orders").agg(r6(M.distribution_health(F.col("o_totalprice")), "health"))


_QA = """(SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user')"""


def _qa(spark, d):
    """Each user turn with the assistant's turn after it."""
    c = read(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(a, ["conv_id", "turn"], "left")


@query("answerable_rate", f"SELECT round(avg(CASE WHEN length({strip_sql(chr(39) + 'x' + chr(39)) if False else 'coalesce(trim(answer), ' + chr(39) * 2 + ')'}) > 0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS answerable FROM {_QA}")
def answerable_rate(spark, d):
    return _qa(spark, d).agg(r6(M.share(S.nonempty(F.col("answer"))), "answerable"))


_TYPE = "CASE WHEN regexp_extract(lower(coalesce({0}, '')), '[a-z]+') IN ('what', 'who', 'when', 'where', 'why', 'how', 'which') THEN regexp_extract(lower({0}), '[a-z]+') ELSE 'other' END"


@query("question_type_diversity", f"SELECT round(least(1.0, count(DISTINCT {_TYPE.format('question')}) / 7.0), 6)::DOUBLE AS diversity FROM {_QA}")
def question_type_diversity(spark, d):
    return _qa(spark, d).agg(r6(M.question_diversity(F.col("question")), "diversity"))


@query("question_type", f"SELECT conv_id, turn, {_TYPE.format('text')} AS type FROM conversations")
def question_type(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", S.question_type(F.col("text")).alias("type"))


# The first sentence of a document stands for its summary.
_SUM = "(SELECT doc_id, text AS document, regexp_extract(text, '^[^.]*\\.?') AS summary FROM documents)"


def _summaries(spark, d):
    return read(spark, d, "documents").select("doc_id", F.col("text").alias("document"), F.regexp_extract("text", r"^[^.]*\.?", 0).alias("summary"))


@query("compression_ratio", f"SELECT round(avg(least(1.0, length(summary) / length(document)::DOUBLE)) FILTER (WHERE length(document) > 0), 6) AS ratio FROM {_SUM}")
def compression_ratio(spark, d):
    return _summaries(spark, d).agg(r6(M.compression(F.col("document"), F.col("summary")), "ratio"))


_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')"
_GRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_OVERLAP = f"(SELECT doc_id, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a)::DOUBLE END AS overlap FROM (SELECT doc_id, {_GRAMS.format('s')} AS a, {_GRAMS.format('t')} AS b FROM (SELECT doc_id, {_TOK.format('summary')} AS s, {_TOK.format('document')} AS t FROM {_SUM})))"


@query("bigram_overlap", f"SELECT doc_id, round(overlap, 6)::DOUBLE AS overlap FROM {_OVERLAP}")
def bigram_overlap(spark, d):
    return _summaries(spark, d).select("doc_id", r6(S.bigram_overlap(F.col("summary"), F.col("document")), "overlap"))


@query("abstractiveness", f"SELECT round(1 - avg(overlap), 6)::DOUBLE AS abstractiveness FROM {_OVERLAP}")
def abstractiveness(spark, d):
    return _summaries(spark, d).agg(r6(M.abstractiveness(F.col("document"), F.col("summary")), "abstractiveness"))


@query("turn_validity", f"SELECT round(avg(CASE WHEN length(trim(question)) > 0 AND length(trim(answer)) > 0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS validity FROM {_QA}")
def turn_validity(spark, d):
    return _qa(spark, d).agg(r6(M.turn_validity(F.col("question"), F.col("answer")), "validity"))


@query("prompt_diversity", "SELECT round(count(DISTINCT text) / count(*)::DOUBLE, 6) AS diversity FROM conversations")
def prompt_diversity(spark, d):
    return read(spark, d, "conversations").agg(r6(M.prompt_diversity(F.col("text")), "diversity"))


@query("duration_uniformity", "SELECT round(avg(CASE WHEN abs(value - m) <= 0.1::DOUBLE * abs(m) THEN 1.0 ELSE 0 END), 6)::DOUBLE AS uniformity FROM events, (SELECT median(value) AS m FROM events)")
def duration_uniformity(spark, d):
    return rounded(M.duration_uniformity(read(spark, d, "events"), "value"), "uniformity")


@query("duration_conformance", "SELECT round(avg(CASE WHEN value <= 100 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS conformance FROM events")
def duration_conformance(spark, d):
    """Share of items no longer than a wanted duration."""
    return read(spark, d, "events").agg(r6(M.share(F.col("value") <= 100), "conformance"))


@query("fps_consistency", "SELECT fps, round(n / sum(n) OVER (), 6)::DOUBLE AS share FROM (SELECT hour(ts)::BIGINT AS fps, count(*) AS n FROM events GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, fps) = 1")
def fps_consistency(spark, d):
    return rounded(M.modal_share(read(spark, d, "events").select(F.hour("ts").cast("long").alias("fps")), "fps"), "share")


@query("resolution_consistency", "SELECT w, h, round(n / sum(n) OVER (), 6)::DOUBLE AS share FROM (SELECT p_size AS w, p_brand AS h, count(*) AS n FROM part GROUP BY 1, 2) QUALIFY row_number() OVER (ORDER BY n DESC, w, h) = 1")
def resolution_consistency(spark, d):
    return rounded(M.modal_share(read(spark, d, "part").select(F.col("p_size").alias("w"), F.col("p_brand").alias("h")), "w", "h"), "share")


@query("mean_contribution", "SELECT l_linenumber, round(avg((l_discount + l_tax) / 2), 6) AS mean FROM lineitem GROUP BY 1")
def mean_contribution(spark, d):
    m = F.create_map(F.lit("discount"), F.col("l_discount"), F.lit("tax"), F.col("l_tax"))
    return read(spark, d, "lineitem").groupBy("l_linenumber").agg(r6(F.avg(M.mean_contribution(m, ["discount", "tax", "absent"])), "mean"))


@query("llm_oracle_rates", """SELECT count(*) FILTER (WHERE quality IS NOT NULL AND doc_id % 10 <> 3) AS n_valid, round(avg(quality) FILTER (WHERE doc_id % 10 <> 3), 6) AS yes_rate, round(avg((1 + toxic) / 5.0) FILTER (WHERE doc_id % 10 <> 3), 6)::DOUBLE AS mean_rating FROM labels""")
def llm_oracle_rates(spark, d):
    """Canned verdicts of a judge over all labels: fenced JSON, every tenth one malformed."""
    said = F.concat(F.lit('```json\n{"ok": '), (F.col("quality") == 1).cast("string"), F.lit(', "rating": '), (F.col("toxic") + 1).cast("string"), F.lit("}\n```"))
    rows = read(spark, d, "labels").select(F.when(F.col("doc_id") % 10 == 3, "no idea").otherwise(said).alias("verdict"))
    return rounded(M.verdict_rates(rows, "verdict"), "yes_rate", "mean_rating")


# --- scalar functions ---------------------------------------------------------------------------------------------------
@query("clamp01", "SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 100)) AS v FROM events")
def clamp01(spark, d):
    return read(spark, d, "events").select("event_id", S.clamp01(F.col("value") / 100).alias("v"))


@query("text_value", "SELECT conv_id, turn, coalesce(text, '') AS v FROM conversations")
def text_value(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", S.text_value(F.col("text")).alias("v"))


@query("tokenize_label", "SELECT p_partkey, list_filter(string_split(lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) > 0) AS tokens FROM part")
def tokenize_label(spark, d):
    return read(spark, d, "part").select("p_partkey", S.tokenize_label(F.col("p_name")).alias("tokens"))


_LEX_TOK = "list_filter(string_split(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) > 0)"


@query("lexical_score", f"""SELECT p_partkey, round(CASE WHEN array_to_string(x, ' ') = array_to_string(y, ' ') THEN 1.0 ELSE 0.5 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE + 0.5 * (1 - levenshtein(array_to_string(x, ' '), array_to_string(y, ' ')) / greatest(length(array_to_string(x, ' ')), length(array_to_string(y, ' ')))::DOUBLE) END, 6)::DOUBLE AS score
FROM (SELECT p_partkey, {_LEX_TOK.format('p_name')} AS x, {_LEX_TOK.format('p_type')} AS y FROM part)""")
def lexical_score(spark, d):
    return read(spark, d, "part").select("p_partkey", r6(S.lexical_score(F.col("p_name"), F.col("p_type")), "score"))


@query("embedding_score", "SELECT a.vec_id, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b")
def embedding_score(spark, d):
    e = read(spark, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("b"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", r6(S.embedding_score(F.col("embedding"), F.col("b")), "score"))


@query("predicate_for_score", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount * 10 >= 0.95 THEN 'exactMatch' WHEN l_discount * 10 >= 0.8 THEN 'closeMatch' ELSE 'relatedMatch' END AS predicate FROM lineitem")
def predicate_for_score(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.predicate_for_score(F.col("l_discount") * 10).alias("predicate"))


@query("strip_json_fence", "SELECT event_id, trim(props) AS plain, props AS inner_json FROM events")
def strip_json_fence(spark, d):
    fenced = F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone."))
    return read(spark, d, "events").select("event_id", S.strip_json_fence(F.col("props")).alias("plain"), S.strip_json_fence(fenced).alias("inner_json"))


@query("safe_filename", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS file, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS name FROM pages")
def safe_filename(spark, d):
    return read(spark, d, "pages").select("page_id", S.safe_filename(F.col("url")).alias("file"), S.local_name(F.col("url")).alias("name"))


@query("cypher_escape", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '''', '\\'''), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) AS escaped FROM documents")
def cypher_escape(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(S.cypher_escape(F.col("text"))).alias("escaped"))


@query("coerce_datatype", "SELECT event_id, event_type AS as_integer, CAST(CAST(user_id AS BIGINT) AS VARCHAR) AS number FROM events")
def coerce_datatype(spark, d):
    return read(spark, d, "events").select("event_id", S.coerce_datatype(F.col("event_type"), "integer").alias("as_integer"), S.coerce_datatype(F.col("user_id").cast("string"), "integer").alias("number"))


@query("is_pii", "SELECT * FROM (VALUES ('c_custkey', false), ('c_name', true), ('c_nationkey', false), ('c_acctbal', false), ('c_mktsegment', false)) t(\"column\", pii)")
def is_pii(spark, d):
    return spark.createDataFrame([(c, S.is_pii(c)) for c in read(spark, d, "customer").columns], "column string, pii boolean")


@query("rel_phrase", "SELECT DISTINCT lower(replace('HAS_' || event_type, '_', ' ')) AS phrase FROM events")
def rel_phrase(spark, d):
    return read(spark, d, "events").select(S.rel_phrase(F.concat(F.lit("HAS_"), "event_type")).alias("phrase")).distinct()


@query("difficulty", "SELECT conv_id, turn, CASE WHEN turn <= 2 THEN 'easy' WHEN turn = 3 THEN 'medium' ELSE 'hard' END AS difficulty FROM conversations")
def difficulty(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", S.difficulty(F.col("turn")).alias("difficulty"))


@query("json_functions", "SELECT event_id, json_extract_string(props, '$.k') AS k, length(props)::BIGINT AS n FROM events")
def json_functions(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


# --- order and sets -----------------------------------------------------------------------------------------------------
@query("first_wins_dedup", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def first_wins_dedup(spark, d):
    """The first of equal texts: a minimum by hash key, pre-aggregated, so copies never meet in one task."""
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("best_candidate", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) = 1")
def best_candidate(spark, d):
    best = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey")
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", F.row_number().over(best).alias("r")).where("r = 1").drop("r")


@query("llm_topk_borderline", "SELECT doc_id, score FROM (SELECT doc_id, (n_chars % 97) / 97.0::DOUBLE AS score FROM documents) ORDER BY score DESC, doc_id LIMIT 25")
def llm_topk_borderline(spark, d):
    return read(spark, d, "documents").select("doc_id", (F.col("n_chars") % 97 / 97.0).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


@query("sorted_export", "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name) AS place FROM nation")
def sorted_export(spark, d):
    from tessera.operators.order import ordinals

    return ordinals(read(spark, d, "nation").select("n_nationkey", "n_name"), ["n_name"]).select("n_nationkey", "n_name", (F.col("_i") + 1).alias("place"))


@query("sample_without_replacement", "SELECT c_custkey FROM customer ORDER BY md5('5:pick:' || c_custkey), c_custkey LIMIT 200")
def sample_without_replacement(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.md5(F.concat(F.lit("5:pick:"), F.col("c_custkey").cast("string"))).alias("h")).orderBy("h", "c_custkey").limit(200).select("c_custkey")


@query("sample_with_replacement", """SELECT i, c_custkey FROM (SELECT range AS i, floor((('0x' || substr(md5(concat_ws(':', '5', 'draw', range::VARCHAR)), 1, 8))::BIGINT / 4294967296.0) * (SELECT count(*) FROM customer))::BIGINT AS place FROM range(500))
JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer) USING (place)""")
def sample_with_replacement(spark, d):
    from tessera.functions.rng import u01
    from tessera.operators.order import ordinals

    c = ordinals(read(spark, d, "customer").select("c_custkey"), ["c_custkey"])
    n = read(spark, d, "customer").count()
    draws = spark.range(500).select(F.col("id").alias("i"), F.floor(u01(5, "draw", "id") * n).cast("long").alias("_i"))
    return draws.join(c, "_i").select("i", "c_custkey")


@query("union_all_shards", "SELECT 'customer' AS shard, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def union_all_shards(spark, d):
    a = read(spark, d, "customer").select(F.lit("customer").alias("shard"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(read(spark, d, "supplier").select(F.lit("supplier").alias("shard"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))


@query("intersect_coverage", "SELECT count(DISTINCT c_nationkey)::BIGINT AS present, (SELECT count(*) FROM nation) AS declared FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)")
def intersect_coverage(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    present = read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct().join(n, "k", "left_semi").agg(F.count("*").alias("present"))
    return present.crossJoin(n.agg(F.count("*").alias("declared")))


@query("except_absent_relations", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def except_absent_relations(spark, d):
    return read(spark, d, "nation").join(read(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_nationkey")


@query("dense_node_index", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM customer")
def dense_node_index(spark, d):
    from tessera.operators.order import ordinals

    return ordinals(read(spark, d, "customer").select("c_custkey"), ["c_custkey"]).select("c_custkey", F.col("_i").alias("idx"))


@query("version_lookup", "SELECT c.c_custkey, n.n_name AS parent, r.r_name AS grandparent FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def version_lookup(spark, d):
    """Lineage: each row with its parent's and grandparent's names."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("parent"), F.col("r_name").alias("grandparent"))


@query("prompt_label_alignment", f"SELECT row_number() OVER (ORDER BY conv_id, turn) AS ordinal, question, answer FROM {_QA} WHERE answer IS NOT NULL")
def prompt_label_alignment(spark, d):
    from tessera.operators.order import ordinals

    rows = ordinals(_qa(spark, d).where("answer is not null"), ["conv_id", "turn"])
    return rows.select((F.col("_i") + 1).alias("ordinal"), "question", "answer")
