"""Queries of the row generators and the perturbations. Draws come from md5, so SQL repeats them exactly."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.rng import gauss_sql
from tessera.functions.rng import u01_sql as u
from tessera.operators import generate as G
from tessera.operators import perturb as P
from tessera.operators.generate import FieldSpec
from tessera.plans.registry import query, read
from tessera.plans.tables import rounded

N = 2000


def _generated(name: str, spec: FieldSpec, sql: str):
    @query(name, f"SELECT range AS id, {sql} AS {spec.name} FROM range({N})")
    def run(spark, d):
        return spark.range(N).select("id", G.generated(spec, 11, F.col("id")).alias(spec.name))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(draw: str, values) -> str:
    return f"{_list(values)}[floor({draw} * {len(values)})::INT + 1]"


def _int(draw: str, lo: int, hi: int) -> str:
    return f"(floor({draw} * {hi - lo + 1}) + {lo})::BIGINT"


_generated("gen_integer", FieldSpec("age", "integer", constraints={"min": 18, "max": 90}), _int(u(11, "age", "range"), 18, 90))
_generated("gen_float", FieldSpec("rate", "float", constraints={"min": 2.0, "max": 5.0}), f"({u(11, 'rate', 'range')} * 3.0 + 2.0)::DOUBLE")
_generated("gen_boolean", FieldSpec("flag", "boolean"), f"({u(11, 'flag', 'range')} < 0.5)")
_generated("gen_categorical", FieldSpec("plan", "categorical", constraints={"choices": ["gold", "silver", "free"]}), _pick(u(11, "plan", "range"), ["gold", "silver", "free"]))
_generated("gen_datetime", FieldSpec("at", "datetime"), f"strftime(to_timestamp(floor({u(11, 'at', 'range')} * {G.EPOCH_TILL - G.EPOCH_FROM}) + {G.EPOCH_FROM}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S')")
_PII = {
    "name": ("name", f"{_pick(u(11, 'name:first', 'range'), G.FIRST)} || ' ' || {_pick(u(11, 'name:last', 'range'), G.LAST)}"),
    "email": ("email", f"lower({_pick(u(11, 'email:first', 'range'), G.FIRST)}) || '.' || lower({_pick(u(11, 'email:last', 'range'), G.LAST)}) || {_int(u(11, 'email:n', 'range'), 1, 999)} || '@example.com'"),
    "address": ("address", f"{_int(u(11, 'address:n', 'range'), 1, 200)} || ' ' || {_pick(u(11, 'address:street', 'range'), G.STREETS)}"),
    "note": ("text", " || ' ' || ".join(_pick(u(11, f"note:{i}", "range"), G.NOUNS) for i in range(6))),
}


@query("gen_pii", "SELECT range AS id, " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in _PII.items()) + f" FROM range({N})")
def gen_pii(spark, d):
    return spark.range(N).select("id", *[G.generated(FieldSpec(n, t), 11, F.col("id")).alias(n) for n, (t, _) in _PII.items()])


FIELDS = [FieldSpec("age", "integer", constraints={"min": 0, "max": 120}), FieldSpec("rate", "float", True), FieldSpec("vip", "boolean"), FieldSpec("plan", "categorical", constraints={"choices": ["a", "b"]})]
_TABLE = {"age": _int(u(4, "age", "range"), 0, 120), "rate": u(4, "rate", "range") + "::DOUBLE", "vip": f"({u(4, 'vip', 'range')} < 0.5)", "plan": _pick(u(4, "plan", "range"), ["a", "b"])}


@query("gen_tabular", "SELECT " + ", ".join(f"{sql} AS {c}" for c, sql in _TABLE.items()) + " FROM range(500, 2500)")
def gen_tabular(spark, d):
    return G.table(spark, FIELDS, 500, 2000, 4)


def _rules(name: str, rules: list[dict], change: dict[str, str]):
    @query(name, "SELECT " + ", ".join(f"{change.get(c, sql)} AS {c}" for c, sql in _TABLE.items()) + f" FROM range({N})")
    def run(spark, d):
        return G.directives(spark, FIELDS, rules, 0, N, 4)


_rules("directive_bias", [{"field": "vip", "value": True, "rate": 0.9}], {"vip": f"CASE WHEN {u(4, 'rule0:vip', 'range')} < 0.9 THEN true ELSE {_TABLE['vip']} END"})
_rules("directive_edge_case", [{"field": "age", "value": "max", "rate": 0.2}, {"field": "rate", "value": "null", "rate": 0.1}],
       {"age": f"CASE WHEN {u(4, 'rule0:age', 'range')} < 0.2 THEN 120 ELSE {_TABLE['age']} END", "rate": f"CASE WHEN {u(4, 'rule1:rate', 'range')} < 0.1 THEN NULL ELSE {_TABLE['rate']} END"})
_rules("directive_use_case", [{"field": "plan", "value": "b", "name": "rare_event"}], {"plan": f"CASE WHEN {u(4, 'rule0:plan', 'range')} < 0.02 THEN 'b' ELSE {_TABLE['plan']} END"})


@query("gen_copula")
def gen_copula(spark, d):
    """A synthetic table as large as the real one, from marginals and dependence of all its rows."""
    c = read(spark, d, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment")
    fields = [FieldSpec("c_acctbal", "float"), FieldSpec("c_nationkey", "integer"), FieldSpec("c_mktsegment", "categorical")]
    return G.Copula(c, fields).sample(spark, 0, c.count(), 3)


@query("shard_plan", "SELECT modality, s AS start, least(size, rows - s) AS count FROM (SELECT 'tabular' AS modality, 50000 AS size, count(*) AS rows FROM lineitem UNION ALL SELECT 'text', 200, count(*) FROM documents) t, LATERAL (SELECT unnest(range(0, greatest(rows, 1), size)) AS s)")
def shard_plan(spark, d):
    plans = [(m, a, b) for m, t in (("tabular", "lineitem"), ("text", "documents")) for a, b in G.shard_plan(read(spark, d, t).count(), m)]
    return spark.createDataFrame(plans, "modality string, start long, count long")


@query("image_prompts", f"SELECT range AS index, ['cat', 'dog', 'owl'][range % 3 + 1] AS label, 'a photo, ' || ['cat', 'dog', 'owl'][range % 3 + 1] || ', at night' AS prompt FROM range({N})")
def image_prompts(spark, d):
    return G.image_prompts(spark, N, "a photo", ["cat", "dog", "owl"], ["at night"])


@query("audio_plan", f"SELECT range AS index, CASE range WHEN 0 THEN 'hello' WHEN 1 THEN 'goodbye' ELSE {' || chr(32) || '.join(_pick(u(6, f'audio:{i}', 'range'), G.NOUNS) for i in range(5))} END AS prompt, CASE range WHEN 0 THEN 'greeting' END AS label FROM range({N})")
def audio_plan(spark, d):
    return G.audio_plan(spark, N, ["hello", "goodbye"], ["greeting"], 6)


@query("video_plan", f"SELECT range AS index, 'a street (clip ' || range || '); mood=calm; style=film' AS prompt, 6 * 1000003 + range AS item_seed FROM range({N})")
def video_plan(spark, d):
    return G.video_plan(spark, N, "a street", {"style": "film", "mood": "calm"}, 6)


# --- perturbations ------------------------------------------------------------------------------------------------------
def customers(spark, d):
    return read(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")


_K = "c_custkey"
_SD = "CASE WHEN {0} > 0 THEN {0} ELSE 1 END"


@query("noise_gaussian", f"""SELECT c_custkey, round(c_acctbal + {gauss_sql(u(9, 'noise:c_acctbal:a', _K), u(9, 'noise:c_acctbal:b', _K))} * 0.1 * s, 6) AS c_acctbal, CAST(round_even(c_nationkey + {gauss_sql(u(9, 'noise:c_nationkey:a', _K), u(9, 'noise:c_nationkey:b', _K))} * 0.1 * n, 0) AS INTEGER) AS c_nationkey
FROM customer, (SELECT stddev_pop(c_acctbal) AS s, stddev_pop(c_nationkey) AS n FROM customer)""")
def noise_gaussian(spark, d):
    return rounded(P.noise(customers(spark, d).drop("c_mktsegment"), ["c_acctbal", "c_nationkey"], [_K], 9, 0.1), "c_acctbal")


@query("noise_uniform", f"SELECT c_custkey, round(c_acctbal + (2 * {u(9, 'noise:c_acctbal', _K)} - 1) * 0.1 * s, 6)::DOUBLE AS c_acctbal FROM customer, (SELECT max(c_acctbal) - min(c_acctbal) AS s FROM customer)")
def noise_uniform(spark, d):
    return rounded(P.noise(customers(spark, d).select(_K, "c_acctbal"), ["c_acctbal"], [_K], 9, 0.1, "uniform"), "c_acctbal")


@query("noise_categorical_swap", f"""SELECT c_custkey, CASE WHEN {u(9, 'swap:c_mktsegment', _K)} < 0.3 THEN list_filter(seen, lambda x: x <> c_mktsegment)[floor({u(9, 'swap:c_mktsegment:to', _K)} * (len(seen) - 1))::INT + 1] ELSE c_mktsegment END AS c_mktsegment
FROM customer, (SELECT list_sort(list(DISTINCT c_mktsegment)) AS seen FROM customer)""")
def noise_categorical_swap(spark, d):
    return P.categorical_swap(customers(spark, d).select(_K, "c_mktsegment"), "c_mktsegment", [_K], 9, 0.3)


_MASK = "array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda w, i: CASE WHEN (('0x' || substr(md5(concat_ws(':', '9', 'text:mask', doc_id::VARCHAR, (i - 1)::VARCHAR)), 1, 8))::BIGINT / 4294967296.0) < 0.2 THEN '[MASK]' ELSE w END), ' ')"


@query("noise_text_mask", f"SELECT doc_id, md5({_MASK}) AS digest FROM documents")
def noise_text_mask(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    return P.text_noise(docs, "text", ["doc_id"], 9, 0.2, "mask").select("doc_id", F.md5("text").alias("digest"))


def _typos(kind: str):
    def run(spark, d):
        return P.text_noise(read(spark, d, "conversations").select("conv_id", "turn", "text"), "text", ["conv_id", "turn"], 9, 0.1, kind)

    return run


def _typo_sql(rate: str, ns: str, key: str, text: str) -> str:
    draw = lambda p: f"(('0x' || substr(md5(concat_ws(':', '9', '{ns}:{p}', {key}, (i - 1)::VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"
    letter = f"substr('abcdefghijklmnopqrstuvwxyz', floor({draw('letter')} * 26)::INT + 1, 1)"
    return f"array_to_string(list_transform(list_filter(regexp_extract_all(coalesce({text}, ''), '(?s).'), lambda c: length(c) > 0), lambda c, i: CASE WHEN {draw('hit')} >= {rate} THEN c WHEN {draw('kind')} < 1.0::DOUBLE / 3 THEN '' WHEN {draw('kind')} < 2.0::DOUBLE / 3 THEN {letter} || c ELSE {letter} END), '')"


query("noise_text_char", f"SELECT conv_id, turn, {_typo_sql('0.1', 'text', 'conv_id || chr(58) || turn', 'text')} AS text FROM conversations")(_typos("char"))


def word_typos_sql(rate: str, key: str) -> str:
    """Typos in a share of words: each is spelled by character with half of the rate's chances."""
    draw = lambda p, *more: "(('0x' || substr(md5(concat_ws(':', '9', 'text:" + p + "', " + ", ".join([key, "(j - 1)::VARCHAR", *more]) + ")), 1, 8))::BIGINT / 4294967296.0)"
    at = "(i - 1)::VARCHAR"
    letter = f"substr('abcdefghijklmnopqrstuvwxyz', floor({draw('letter', at)} * 26)::INT + 1, 1)"
    word = f"array_to_string(list_transform(list_filter(regexp_extract_all(w, '(?s).'), lambda c: length(c) > 0), lambda c, i: CASE WHEN {draw('hit', at)} >= 0.5 THEN c WHEN {draw('kind', at)} < 1.0::DOUBLE / 3 THEN '' WHEN {draw('kind', at)} < 2.0::DOUBLE / 3 THEN {letter} || c ELSE {letter} END), '')"
    return f"array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda w, j: CASE WHEN {draw('word')} < {rate} THEN {word} ELSE w END), ' ')"


query("noise_text_word", f"SELECT conv_id, turn, {word_typos_sql('0.1', 'conv_id || chr(58) || turn')} AS text FROM conversations")(_typos("word"))


@query("drift_covariate", "SELECT c_custkey, round(c_acctbal * 1.1 + 0.5 * s, 6)::DOUBLE AS c_acctbal FROM customer, (SELECT stddev_pop(c_acctbal) AS s FROM customer)")
def drift_covariate(spark, d):
    return rounded(P.drift_covariate(customers(spark, d).select(_K, "c_acctbal"), ["c_acctbal"], 0.5, 1.1), "c_acctbal")


@query("drift_temporal", "SELECT o_orderkey, round(o_totalprice + 0.5 * s * (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) / (n - 1), 4)::DOUBLE AS o_totalprice FROM orders, (SELECT stddev_pop(o_totalprice) AS s, count(*) AS n FROM orders)")
def drift_temporal(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return P.drift_temporal(o, "o_totalprice", ["o_orderdate", "o_orderkey"], 0.5).select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("drift_concept_relabel", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSEHOLD' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def drift_concept_relabel(spark, d):
    return P.relabel(customers(spark, d).select(_K, "c_mktsegment"), "c_mktsegment", {"BUILDING": "HOUSEHOLD"})


@query("drift_concept_rotate", "SELECT c_custkey, coalesce(nxt, lo) AS c_mktsegment FROM customer JOIN (SELECT v, lead(v) OVER (ORDER BY v) AS nxt, min(v) OVER () AS lo FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)) ON c_mktsegment = v")
def drift_concept_rotate(spark, d):
    return P.rotate(customers(spark, d).select(_K, "c_mktsegment"), "c_mktsegment")


def _progress_sql(table: str, order: str, key: str, rate: str) -> str:
    draw = lambda p: f"(('0x' || substr(md5(concat_ws(':', '9', 'progress:{p}', {key}, (i - 1)::VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"
    letter = f"substr('abcdefghijklmnopqrstuvwxyz', floor({draw('letter')} * 26)::INT + 1, 1)"
    new = f"array_to_string(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '(?s).'), lambda c: length(c) > 0), lambda c, i: CASE WHEN {draw('hit')} >= {rate} * spot / greatest(n - 1, 1) THEN c WHEN {draw('kind')} < 1.0::DOUBLE / 3 THEN '' WHEN {draw('kind')} < 2.0::DOUBLE / 3 THEN {letter} || c ELSE {letter} END), '')"
    return f"(SELECT *, {new} AS spoiled FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS spot, count(*) OVER () AS n FROM {table}))"


@query("drift_text_progressive", f"SELECT conv_id, turn, spoiled AS text FROM {_progress_sql('conversations', 'conv_id, turn', 'conv_id || chr(58) || turn', '0.2::DOUBLE')}")
def drift_text_progressive(spark, d):
    return P.text_progressive(read(spark, d, "conversations").select("conv_id", "turn", "text"), "text", ["conv_id", "turn"], 9, 0.2)


@query("outlier_point", f"SELECT c_custkey, round(CASE WHEN {u(9, 'outlier:c_acctbal', _K)} < 0.05 THEN m + CASE WHEN {u(9, 'outlier:c_acctbal:sign', _K)} < 0.5 THEN -1 ELSE 1 END * 5 * s ELSE c_acctbal END, 6)::DOUBLE AS c_acctbal FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def outlier_point(spark, d):
    return rounded(P.outlier_point(customers(spark, d).select(_K, "c_acctbal"), "c_acctbal", [_K], 9, 0.05), "c_acctbal")


@query("outlier_contextual", f"SELECT c_custkey, CASE WHEN {u(9, 'rare:c_mktsegment', _K)} < 0.05 THEN '__ANOMALY__' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def outlier_contextual(spark, d):
    return P.outlier_value(customers(spark, d).select(_K, "c_mktsegment"), "c_mktsegment", [_K], 9, 0.05)


@query("outlier_text", f"SELECT doc_id, md5(CASE WHEN {u(9, 'rare:text', 'doc_id')} < 0.05 THEN repeat('__ANOMALY__', 5) ELSE text END) AS digest FROM documents")
def outlier_text(spark, d):
    return P.outlier_value(read(spark, d, "documents"), "text", ["doc_id"], 9, 0.05, times=5.0).select("doc_id", F.md5("text").alias("digest"))


@query("bias_resample", f"""WITH p AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer WHERE c_mktsegment = 'BUILDING'), q AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer WHERE c_mktsegment <> 'BUILDING'),
n AS (SELECT count(*) AS n, round_even(0.8 * count(*), 0) AS k, (SELECT count(*) FROM p)::DOUBLE AS np, (SELECT count(*) FROM q)::DOUBLE AS nq FROM customer), d AS (SELECT i, i < k AS side, floor({u(9, 'bias', 'i')} * CASE WHEN i < k THEN np ELSE nq END)::BIGINT AS place FROM n, LATERAL (SELECT unnest(range(n)) AS i))
SELECT c_custkey, c_mktsegment FROM d JOIN p USING (place) WHERE side UNION ALL SELECT c_custkey, c_mktsegment FROM d JOIN q USING (place) WHERE NOT side""")
def bias_resample(spark, d):
    return P.bias_resample(customers(spark, d).select(_K, "c_mktsegment"), "c_mktsegment", [_K], 9, 0.8, "BUILDING")


@query("edge_nulls", f"SELECT c_custkey, CASE WHEN {u(9, 'edge:c_acctbal', _K)} < 0.1 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def edge_nulls(spark, d):
    return P.edge_nulls(customers(spark, d).select(_K, "c_acctbal"), "c_acctbal", [_K], 9, 0.1)


@query("edge_boundary", f"SELECT c_custkey, CASE WHEN {u(9, 'edge:c_acctbal', _K)} < 0.1 THEN CASE WHEN {u(9, 'edge:c_acctbal:side', _K)} < 0.5 THEN lo ELSE hi END ELSE c_acctbal END AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def edge_boundary(spark, d):
    return P.edge_boundary(customers(spark, d).select(_K, "c_acctbal"), "c_acctbal", [_K], 9, 0.1)


@query("edge_format", f"SELECT c_custkey, CASE WHEN {u(9, 'edge:c_mktsegment', _K)} < 0.1 THEN '   ' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN {u(9, 'edge:c_acctbal', _K)} < 0.1 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def edge_format(spark, d):
    c = customers(spark, d).select(_K, "c_mktsegment", "c_acctbal")
    return P.edge_format(P.edge_format(c, "c_mktsegment", [_K], 9, 0.1), "c_acctbal", [_K], 9, 0.1)


@query("edge_text", f"SELECT doc_id, md5(CASE WHEN {u(9, 'edge:text', 'doc_id')} < 0.1 THEN CASE WHEN {u(9, 'edge:text:kind', 'doc_id')} < 0.5 THEN '' ELSE '   ' END ELSE text END) AS digest FROM documents")
def edge_text(spark, d):
    return P.edge_text(read(spark, d, "documents"), "text", ["doc_id"], 9, 0.1).select("doc_id", F.md5("text").alias("digest"))


