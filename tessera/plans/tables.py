"""Queries of the table operators: scans, profiles, selection, judges. Doubles are rounded to 6 places in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import judges, profile
from tessera.operators.order import running
from tessera.plans.registry import query, read


def r6(x, name=None):
    x = F.col(x) if isinstance(x, str) else x
    out = F.round(x.cast("double"), 6)
    return out.alias(name) if name else out


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def split_orders(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Finished orders are the subject, all others the reference; every order is in one of them."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    done = F.col("o_orderstatus") == "F"
    cols = ["o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority"]
    return o.where(done).select(*cols), o.where(~done).select(*cols)


SUBJECT = "(SELECT o_orderkey, o_totalprice, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F')"
REFERENCE = "(SELECT o_orderkey, o_totalprice, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F')"

# --- profiles -----------------------------------------------------------------------------------------------------------
_CUSTOMER = {"c_custkey": 1, "c_name": 0, "c_nationkey": 1, "c_acctbal": 1, "c_mktsegment": 0}


def _profile_sql(table: str, columns: dict[str, int]) -> str:
    num = lambda f, c, n: f"round(CAST({f}({c}) AS DOUBLE), 6)" if n else "CAST(NULL AS DOUBLE)"
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS null_rate, count(DISTINCT {c}) AS n_distinct, {num('min', c, n)} AS min_value,
        {num('max', c, n)} AS max_value, {num('avg', c, n)} AS mean_value, {num('stddev_samp', c, n)} AS std_value FROM {table}""" for c, n in columns.items())


@query("profile_columns", _profile_sql("customer", _CUSTOMER))
def profile_columns(spark, d):
    return rounded(profile.profile_columns(read(spark, d, "customer")), "null_rate", "min_value", "max_value", "mean_value", "std_value")


@query("profile_categories", """SELECT c_mktsegment AS value, round(count(*) / (SELECT count(c_mktsegment) FROM customer)::DOUBLE, 6) AS share FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50""")
def profile_categories(spark, d):
    return rounded(profile.profile_categories(read(spark, d, "customer"), "c_mktsegment"), "share")


@query("topk_categories", """SELECT p_brand AS value, round(count(*) / (SELECT count(p_brand) FROM part)::DOUBLE, 6) AS share FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50""")
def topk_categories(spark, d):
    return rounded(profile.profile_categories(read(spark, d, "part"), "p_brand"), "share")


@query("profile_semantic_type", """SELECT * FROM (VALUES ('c_custkey', 'integer'), ('c_nationkey', 'integer'), ('c_acctbal', 'float')) t("column", type) UNION ALL
SELECT 'c_name', CASE WHEN count(c_name) = 0 THEN 'text' ELSE 'name' END FROM customer UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) BETWEEN 1 AND 50 THEN 'categorical' ELSE 'text' END FROM customer""")
def profile_semantic_type(spark, d):
    kinds = profile.semantic_types(read(spark, d, "customer"))
    return spark.createDataFrame(list(kinds.items()), "column string, type string")


def _corr_sql(source: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({'1.0::DOUBLE' if a == b else f'corr({a}, {b})'}, 6) AS r FROM {source} t" + (" LIMIT 1" if False else "") if a != b else f"SELECT '{a}' AS a, '{a}' AS b, 1.0::DOUBLE AS r" for a in names for b in names)


@query("profile_correlations", _corr_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def profile_correlations(spark, d):
    return rounded(profile.correlations(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "r")


@query("fields_from_profile", """SELECT 'c_custkey' AS field, 'integer' AS type, min(c_custkey)::DOUBLE AS min_value, max(c_custkey)::DOUBLE AS max_value, CAST(NULL AS BIGINT) AS n_choices, CAST(NULL AS VARCHAR) AS most_frequent FROM customer
UNION ALL SELECT 'c_name', 'name', NULL, NULL, NULL, NULL
UNION ALL SELECT 'c_nationkey', 'integer', min(c_nationkey), max(c_nationkey), NULL, NULL FROM customer
UNION ALL SELECT 'c_acctbal', 'float', min(c_acctbal), max(c_acctbal), NULL, NULL FROM customer
UNION ALL SELECT 'c_mktsegment', 'categorical', NULL, NULL, (SELECT count(DISTINCT c_mktsegment) FROM customer), (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def fields_from_profile(spark, d):
    return profile.fields_from_profile(read(spark, d, "customer"))


# --- selection ----------------------------------------------------------------------------------------------------------
@query("shared_columns", "SELECT c AS \"column\" FROM (VALUES ('o_custkey'), ('o_orderkey'), ('o_orderpriority'), ('o_totalprice')) t(c)")
def shared_columns(spark, d):
    a, b = split_orders(spark, d)
    return spark.createDataFrame([(c,) for c in profile.shared_columns(a, b)], "column string")


@query("numeric_columns", "SELECT c AS \"column\" FROM (VALUES ('l_orderkey'), ('l_partkey'), ('l_suppkey'), ('l_linenumber'), ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) t(c)")
def numeric_columns(spark, d):
    return spark.createDataFrame([(c,) for c in profile.numeric_columns(read(spark, d, "lineitem"))], "column string")


@query("categorical_columns", """SELECT c AS "column" FROM (SELECT 'l_returnflag' AS c, count(DISTINCT l_returnflag) AS n FROM lineitem UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem
UNION ALL SELECT 'l_shipdate', count(DISTINCT CAST(l_shipdate AS VARCHAR)) FROM lineitem) WHERE n <= 50""")
def categorical_columns(spark, d):
    return spark.createDataFrame([(c,) for c in profile.categorical_columns(read(spark, d, "lineitem"))], "column string")


@query("coerce_numeric", "SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS from_text, coalesce(TRY_CAST(event_type AS DOUBLE), 0.0::DOUBLE) AS or_zero, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS from_number FROM events")
def coerce_numeric(spark, d):
    bad = F.col("event_type").try_cast("double")
    return read(spark, d, "events").select("event_id", bad.alias("from_text"), F.coalesce(bad, F.lit(0.0)).alias("or_zero"), F.col("value").cast("string").try_cast("double").alias("from_number"))


_STRIP = r"regexp_replace(regexp_replace({}, '^[\s\x{{0085}}\p{{Z}}]+', ''), '[\s\x{{0085}}\p{{Z}}]+$', '')"


def strip_sql(x: str) -> str:
    return _STRIP.format(x)


@query("quality_filter", f"SELECT doc_id, length({strip_sql('text')}) AS n FROM documents WHERE length({strip_sql('text')}) BETWEEN 1 AND 20000")
def quality_filter(spark, d):
    n = F.length(S.strip(F.col("text")))
    return read(spark, d, "documents").where(n.between(1, 20000)).select("doc_id", n.cast("long").alias("n"))


@query("nonempty", f"SELECT conv_id, turn, length({strip_sql('coalesce(text, chr(32))')}) > 0 AS filled FROM conversations")
def nonempty(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", S.nonempty(F.col("text")).alias("filled"))


@query("select_reorder", "SELECT o_orderdate, o_orderkey, o_totalprice FROM orders")
def select_reorder(spark, d):
    return read(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")


@query("enforce_numeric_bounds", "SELECT c_custkey, CASE WHEN c_acctbal IS NOT NULL THEN least(greatest(c_acctbal, 0.0::DOUBLE), 5000.0::DOUBLE) END AS bounded, CASE WHEN c_nationkey IS NOT NULL THEN CAST(least(greatest(c_nationkey, 5), 20) AS BIGINT) END AS nation FROM customer")
def enforce_numeric_bounds(spark, d):
    from tessera.operators.generate import bounded

    c = read(spark, d, "customer")
    return c.select("c_custkey", bounded(F.col("c_acctbal"), 0.0, 5000.0).alias("bounded"), bounded(F.col("c_nationkey"), 5, 20).cast("long").alias("nation"))


@query("enforce_choices", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'BUILDING' END AS segment FROM customer")
def enforce_choices(spark, d):
    from tessera.operators.generate import chosen

    return read(spark, d, "customer").select("c_custkey", chosen(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("segment"))


def _sample(name: str, sql_order: str):
    return f"SELECT doc_id FROM documents ORDER BY {sql_order}, doc_id LIMIT 100"


@query("target_rows", "SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('3:head:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 100")
def target_rows(spark, d):
    """A seeded sample of 100 rows: the first by a hash of the key; the executors keep 100 each."""
    top = read(spark, d, "documents").select("doc_id", F.md5(F.concat(F.lit("3:head:"), F.col("doc_id").cast("string"))).alias("h")).orderBy("h", "doc_id").limit(100)
    return top.select("doc_id", F.row_number().over(W.orderBy("h", "doc_id")).cast("long").alias("rank"))


@query("profile_sample_cap", "SELECT count(*) AS n, least(count(*), 200000) AS kept FROM lineitem")
def profile_sample_cap(spark, d):
    """At most 200,000 rows, by a hash of the row, go into a profile's sample."""
    rows = read(spark, d, "lineitem")
    kept = rows.select(F.xxhash64(*rows.columns).alias("h")).orderBy("h").limit(200_000)
    return rows.agg(F.count("*").alias("n")).crossJoin(kept.agg(F.count("*").alias("kept")))


@query("render_sample", "SELECT string_agg(n_nationkey || '. n_name: ' || n_name || ', n_regionkey: ' || n_regionkey, chr(10) ORDER BY n_nationkey) AS sample FROM nation")
def render_sample(spark, d):
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(". n_name: "), "n_name", F.lit(", n_regionkey: "), F.col("n_regionkey").cast("string"))
    rows = read(spark, d, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("a"))
    return rows.select(F.array_join(F.transform("a", lambda x: x["l"]), "\n").alias("sample"))


@query("tenant_predicate", "SELECT s_nationkey AS tenant, s_suppkey, s_name FROM supplier WHERE s_nationkey = 7")
def tenant_predicate(spark, d):
    return read(spark, d, "supplier").where("s_nationkey = 7").select(F.col("s_nationkey").alias("tenant"), "s_suppkey", "s_name")


# --- distances and judges -----------------------------------------------------------------------------------------------
def _ks_sql(name: str) -> str:
    return f"""SELECT '{name}' AS "column", round(max(abs(cs / ns - cr / nr)), 6) AS ks FROM (SELECT sum(s) OVER w AS cs, sum(r) OVER w AS cr, sum(s) OVER () AS ns, sum(r) OVER () AS nr FROM
    (SELECT x, sum(s)::DOUBLE AS s, sum(r)::DOUBLE AS r FROM (SELECT {name} AS x, 1 AS s, 0 AS r FROM {SUBJECT} UNION ALL SELECT {name}, 0, 1 FROM {REFERENCE}) GROUP BY x) WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING))"""


@query("ks_two_sample", _ks_sql("o_totalprice") + " UNION ALL " + _ks_sql("o_custkey"))
def ks_two_sample(spark, d):
    return rounded(judges.ks(*split_orders(spark, d), ["o_totalprice", "o_custkey"]), "ks")


@query("ecdf", "SELECT l_quantity AS x, round(sum(n) OVER (ORDER BY l_quantity) / sum(n) OVER (), 6)::DOUBLE AS share FROM (SELECT l_quantity, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)")
def ecdf(spark, d):
    n = read(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.count("*").alias("n"))
    return running(n.withColumn("g", F.lit(0)), ["g"], ["x"], ["n"]).select("x", r6(F.col("cum_n") / F.col("all_n"), "share"))


_JS = f"""SELECT 'o_orderpriority' AS "column", round(sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)), 6) AS js FROM (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM
(SELECT o_orderpriority AS x, count(*) / (SELECT count(*) FROM {SUBJECT})::DOUBLE AS p FROM {SUBJECT} GROUP BY 1) a FULL JOIN (SELECT o_orderpriority AS x, count(*) / (SELECT count(*) FROM {REFERENCE})::DOUBLE AS q FROM {REFERENCE} GROUP BY 1) b USING (x))"""


@query("js_distance", _JS)
def js_distance(spark, d):
    return rounded(judges.js(*split_orders(spark, d), ["o_orderpriority"]), "js")


@query("js_category_align", f"""SELECT x AS category, coalesce(p, 0.0)::DOUBLE AS p, coalesce(q, 0.0)::DOUBLE AS q FROM (SELECT o_orderpriority AS x, round(count(*) / (SELECT count(*) FROM {SUBJECT})::DOUBLE, 6) AS p FROM {SUBJECT} GROUP BY 1) a
FULL JOIN (SELECT o_orderpriority AS x, round(count(*) / (SELECT count(*) FROM {REFERENCE})::DOUBLE, 6) AS q FROM {REFERENCE} GROUP BY 1) b USING (x)""")
def js_category_align(spark, d):
    share = lambda df, n: df.groupBy(F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n")).crossJoin(df.agg(F.count("*").alias("total"))).select("category", r6(F.col("n") / F.col("total"), n))
    s, r = split_orders(spark, d)
    return share(s, "p").join(share(r, "q"), "category", "full_outer").na.fill(0.0)


@query("vocabulary_union", "SELECT DISTINCT o_orderpriority AS category FROM orders UNION SELECT DISTINCT c_mktsegment FROM customer")
def vocabulary_union(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderpriority").alias("category")).union(read(spark, d, "customer").select("c_mktsegment")).distinct()


_DELTA = f"(SELECT greatest(0.0, least(1.0, (2 * abs(a - b) / 4) / 2)) AS corr_delta FROM (SELECT corr(o_totalprice, o_custkey) AS a FROM {SUBJECT}), (SELECT corr(o_totalprice, o_custkey) AS b FROM {REFERENCE}))"


@query("correlation_delta", f"SELECT round(corr_delta, 6)::DOUBLE AS corr_delta FROM {_DELTA}")
def correlation_delta(spark, d):
    return rounded(judges.correlation_delta(*split_orders(spark, d), ["o_totalprice", "o_custkey"]), "corr_delta")


@query("fidelity_score", f"""WITH k AS (SELECT avg(ks) AS ks_mean FROM ({_ks_sql('o_totalprice').replace('round(max', '(max').replace(', 6) AS ks', ') AS ks')} UNION ALL {_ks_sql('o_custkey').replace('round(max', '(max').replace(', 6) AS ks', ') AS ks')})),
j AS (SELECT avg(js) AS js_mean FROM ({_JS.replace('round(sqrt', '(sqrt').replace(', 6) AS js', ') AS js')})), c AS (SELECT * FROM {_DELTA})
SELECT round(ks_mean, 6) AS ks_mean, round(js_mean, 6) AS js_mean, round(corr_delta, 6)::DOUBLE AS corr_delta, round(greatest(0.0, least(1.0, 1 - (ks_mean + js_mean + corr_delta) / 3)), 6)::DOUBLE AS score FROM k, j, c""")
def fidelity_score(spark, d):
    s, r = (x.drop("o_orderkey") for x in split_orders(spark, d))
    return rounded(judges.fidelity(s, r), "ks_mean", "js_mean", "corr_delta", "score")


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_UNIQ = "(" + " + ".join(f"count(DISTINCT {c}) / count(*)::DOUBLE" for c in _PART) + f") / {len(_PART)}"


def _entropy_sql(table: str, c: str) -> str:
    return f"(SELECT CASE WHEN count(*) <= 1 THEN 0.0 ELSE -sum(p * ln(p)) / ln(count(*)) END AS entropy, max(p) AS top_share FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}))"


@query("uniqueness", f"SELECT round({_UNIQ}, 6) AS uniqueness FROM part")
def uniqueness(spark, d):
    return read(spark, d, "part").agg(r6(judges.uniqueness(read(spark, d, "part")), "uniqueness"))


@query("normalized_entropy", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(entropy, 6)::DOUBLE AS entropy, round(top_share, 6)::DOUBLE AS top_share FROM {_entropy_sql('part', c)}" for c in ("p_brand", "p_type")))
def normalized_entropy(spark, d):
    return rounded(judges.entropy_of(read(spark, d, "part"), ["p_brand", "p_type"]), "entropy", "top_share")


@query("max_mode_freq", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(top_share, 6)::DOUBLE AS top_share FROM {_entropy_sql('lineitem', c)}" for c in ("l_returnflag", "l_linestatus")))
def max_mode_freq(spark, d):
    return rounded(judges.entropy_of(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]).select("column", "top_share"), "top_share")


@query("diversity_score", f"""WITH u AS (SELECT {_UNIQ} AS uniqueness FROM part), n AS (SELECT * FROM (SELECT 'p_name' AS c, count(DISTINCT p_name) AS k FROM part) WHERE k <= 50),
e AS (SELECT entropy, top_share FROM {_entropy_sql('part', 'p_brand')} UNION ALL SELECT entropy, top_share FROM {_entropy_sql('part', 'p_type')} UNION ALL SELECT entropy, top_share FROM {_entropy_sql('part', 'p_name')}, n), m AS (SELECT avg(entropy) AS entropy, max(top_share) AS max_mode FROM e)
SELECT round(uniqueness, 6) AS uniqueness, round(entropy, 6)::DOUBLE AS entropy, round(max_mode, 6)::DOUBLE AS max_mode, round(greatest(0.0, least(1.0, (uniqueness + entropy) / 2 * (1 - greatest(0.0, max_mode - 0.6) / 0.4))), 6)::DOUBLE AS score FROM u, m""")
def diversity_score(spark, d):
    return rounded(judges.diversity(read(spark, d, "part")), "uniqueness", "entropy", "max_mode", "score")


@query("exact_duplicate_rate", """SELECT count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM conversations r WHERE r.role <> 'user' AND r.text IS NOT DISTINCT FROM s.text)) AS n_copies,
round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM conversations r WHERE r.role <> 'user' AND r.text IS NOT DISTINCT FROM s.text)) / count(*)::DOUBLE, 6) AS rate FROM conversations s WHERE s.role = 'user'""")
def exact_duplicate_rate(spark, d):
    c = read(spark, d, "conversations")
    return rounded(judges.exact_duplicates(c.where("role = 'user'").select("text"), c.where("role <> 'user'").select("text")), "rate")


_SUPPLIER = """(SELECT s.s_suppkey AS k, min(sqrt(((s.s_acctbal - c.c_acctbal) / m.sa) * ((s.s_acctbal - c.c_acctbal) / m.sa) + ((s.s_nationkey - c.c_nationkey) / m.sn) * ((s.s_nationkey - c.c_nationkey) / m.sn))) AS distance
FROM supplier s, customer c, (SELECT stddev_pop(c_acctbal) AS sa, stddev_pop(c_nationkey) AS sn FROM customer) m GROUP BY 1)"""


def _parties(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return s, c


@query("dcr_nearest_neighbour", f"SELECT k AS key, round(distance, 6) AS distance FROM {_SUPPLIER}")
def dcr_nearest_neighbour(spark, d):
    return rounded(judges.nearest_distances(*_parties(spark, d), ["balance", "nation"], "key"), "distance")


@query("privacy_score", f"""WITH dup AS (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM customer c WHERE c.c_acctbal = s.s_acctbal AND c.c_nationkey = s.s_nationkey) THEN 1.0 ELSE 0.0 END) AS rate FROM supplier s), nn AS (SELECT avg(distance) AS mean_nearest FROM {_SUPPLIER})
SELECT round(rate, 6)::DOUBLE AS duplicate_rate, round(mean_nearest, 6) AS mean_nearest, round(1 - greatest(rate, 0.5 * rate + 0.5 * exp(-mean_nearest)), 6)::DOUBLE AS score FROM dup, nn""")
def privacy_score(spark, d):
    return rounded(judges.privacy(*_parties(spark, d), "key"), "duplicate_rate", "mean_nearest", "score")


_FAIR = """WITH p AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM customer GROUP BY c_mktsegment), e AS (SELECT -sum(p * ln(p)) / ln(count(*)) AS representation_entropy FROM p),
rates AS (SELECT avg(CASE WHEN c_acctbal > (SELECT median(c_acctbal) FROM customer) THEN 1.0 ELSE 0.0 END) AS rate FROM customer GROUP BY c_mktsegment), g AS (SELECT max(rate) - min(rate) AS parity_gap, min(rate) / max(rate) AS impact_ratio FROM rates) """


@query("fairness_score", _FAIR + "SELECT round(representation_entropy, 6)::DOUBLE AS representation_entropy, round(parity_gap, 6)::DOUBLE AS parity_gap, round(impact_ratio, 6)::DOUBLE AS impact_ratio, round(0.5 * representation_entropy + 0.5 * (1 - parity_gap), 6)::DOUBLE AS score FROM e, g")
def fairness_score(spark, d):
    return rounded(judges.fairness(read(spark, d, "customer"), "c_mktsegment", "c_acctbal"), "representation_entropy", "parity_gap", "impact_ratio", "score")


for _name in ("representation_entropy", "demographic_parity", "disparate_impact"):
    _col = {"demographic_parity": "parity_gap", "disparate_impact": "impact_ratio"}.get(_name, _name)

    @query(_name, _FAIR + f"SELECT round({_col}, 6)::DOUBLE AS {_col} FROM e, g")
    def _fair(spark, d, col=_col):
        return rounded(judges.fairness(read(spark, d, "customer"), "c_mktsegment", "c_acctbal").select(col), col)


@query("tstr_utility")
def tstr_utility(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
    li = read(spark, d, "lineitem")
    return rounded(judges.tstr_utility(li.where("l_linestatus = 'F'").select(*cols), li.where("l_linestatus <> 'F'").select(*cols), "l_returnflag"), "score", "tstr", "trtr")


_SCORES = "(VALUES ('fidelity', 1.0::DOUBLE), ('privacy', 0.0::DOUBLE), ('diversity', 0.5::DOUBLE)) t(dimension, score)"


@query("weighted_aggregate", f"""SELECT round(sum(w * score) / sum(w), 6)::DOUBLE AS overall, CASE WHEN sum(w * score) / sum(w) >= 0.8 THEN 'strong' WHEN sum(w * score) / sum(w) >= 0.6 THEN 'acceptable' ELSE 'needs work' END AS band
FROM {_SCORES} JOIN (VALUES ('fidelity', 0.22), ('privacy', 0.17), ('diversity', 0.12)) w(dimension, w) USING (dimension)""")
def weighted_aggregate(spark, d):
    return judges.weighted_aggregate(spark.createDataFrame([("fidelity", 1.0), ("privacy", 0.0), ("diversity", 0.5)], "dimension string, score double"))
