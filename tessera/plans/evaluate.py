"""Evaluation runs: which task a table is for, which judges apply, and the report of their scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import clamp01, nonempty
from tessera.operators import graph, judges
from tessera.operators import task_metrics as M

#: The kinds of task.
TASKS = ("text_classification", "question_answering", "summarization", "chat", "text_generic", "tabular_classification", "tabular_regression", "tabular_generic", "image", "audio", "video", "graph_qa", "generic")
#: Fields that make a text table of a shape, in the order in which they are tried.
SHAPES = (("classification", {"text", "label"}), ("qa", {"question", "answer"}), ("summarization", {"document", "summary"}), ("chat", {"instruction", "response"}))


def text_shape(columns: list[str]) -> str:
    """The first shape whose fields are all there; ``messages`` alone is a chat."""
    found = next((name for name, fields in SHAPES if fields <= set(columns)), None)
    return found or ("chat" if "messages" in columns else "generic")


def detect_task(modality: str, columns: list[str], target: str | None = None, numeric_target: bool = False, explicit: str | None = None) -> str:
    if explicit:
        return explicit
    if modality in ("image", "audio", "video"):
        return modality
    if modality == "text":
        return {"classification": "text_classification", "qa": "question_answering", "summarization": "summarization", "chat": "chat"}.get(text_shape(columns), "text_generic")
    if modality == "tabular":
        return "tabular_generic" if not target else "tabular_regression" if numeric_target else "tabular_classification"
    return "generic"


def providers(task: str) -> list[str]:
    """Names of a task's metrics."""
    table = {
        "text_classification": ["class_balance", "duplicate_rate"], "question_answering": ["answerable_rate", "question_type_diversity"], "summarization": ["compression_ratio", "abstractiveness"],
        "chat": ["turn_validity"], "tabular_classification": ["label_balance", "feature_completeness"], "tabular_regression": ["target_range_validity", "target_distribution_health"],
        "image": ["prompt_diversity", "label_balance"], "audio": ["duration_uniformity"], "video": ["fps_consistency", "resolution_consistency"], "graph_qa": ["answerable", "multi_hop", "grounded"],
    }
    return table.get(task, ["duplicate_rate"])


#: Values that count as better the lower they are.
LOWER = {"duplicate_rate"}


def _metric(name: str, df: DataFrame, cols: dict[str, str]) -> DataFrame | None:
    """One row, one value, of a task's metric on the named columns; None if a column that it needs is not there."""
    at = lambda *parts: [cols.get(p, p) for p in parts]
    col = lambda part: F.col(cols.get(part, part))
    able: dict[str, tuple[tuple[str, ...], Callable[[], DataFrame]]] = {
        "class_balance": (("label",), lambda: M.balance(df, *at("label"))), "label_balance": (("label",), lambda: M.balance(df, *at("label"))),
        "duplicate_rate": (("text",), lambda: df.agg(M.duplicate_rate(*at("text")))),
        "answerable_rate": (("answer",), lambda: df.agg(M.share(nonempty(col("answer"))))), "question_type_diversity": (("question",), lambda: df.agg(M.question_diversity(col("question")))),
        "compression_ratio": (("document", "summary"), lambda: df.agg(M.compression(col("document"), col("summary")))), "abstractiveness": (("document", "summary"), lambda: df.agg(M.abstractiveness(col("document"), col("summary")))),
        "turn_validity": (("instruction", "response"), lambda: df.agg(M.turn_validity(col("instruction"), col("response")))),
        "feature_completeness": (("label",), lambda: M.feature_completeness(df, *at("label"))),
        "target_range_validity": (("label",), lambda: df.agg(M.range_validity(col("label")))), "target_distribution_health": (("label",), lambda: df.agg(M.distribution_health(col("label")))),
        "prompt_diversity": (("prompt",), lambda: df.agg(M.prompt_diversity(col("prompt")))), "duration_uniformity": (("duration",), lambda: M.duration_uniformity(df, *at("duration"))),
        "fps_consistency": (("fps",), lambda: M.modal_share(df, *at("fps")).select("share")), "resolution_consistency": (("width", "height"), lambda: M.modal_share(df, *at("width", "height")).select("share")),
    }
    if name not in able or not set(at(*able[name][0])) <= set(df.columns):
        return None
    return able[name][1]().toDF("value").select(F.coalesce(F.col("value"), F.lit(0.0)).cast("double").alias("value"))


def task_metrics(df: DataFrame, task: str, columns: dict[str, str] | None = None) -> DataFrame:
    """(metric, value) of a task's metrics whose columns are there; ``columns`` names them where they have other names."""
    rows = None
    for name in providers(task):
        value = _metric(name, df, columns or {})
        if value is not None:
            row = value.select(F.lit(name).alias("metric"), "value")
            rows = row if rows is None else rows.unionByName(row)
    return rows if rows is not None else df.sparkSession.createDataFrame([], "metric string, value double")


def task_quality(df: DataFrame, task: str, columns: dict[str, str] | None = None) -> DataFrame:
    """One row: mean of a task's metrics, those that are better the lower turned round; none without a metric."""
    good = F.when(F.col("metric").isin(*LOWER), 1 - F.col("value")).otherwise(F.col("value"))
    return task_metrics(df, task, columns).agg(clamp01(F.avg(good)).alias("score"), F.count("*").alias("n")).where("n > 0").select("score")


def _report(able: list[tuple[str, Callable[[], DataFrame]]], spark: SparkSession, overrides: dict[str, float] | None) -> tuple[DataFrame, DataFrame]:
    scores = spark.createDataFrame([], "dimension string, score double")
    for name, judge in able:
        scores = scores.unionByName(judge().select(F.lit(name).alias("dimension"), F.col("score").cast("double").alias("score")))
    if overrides:
        table = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
        scores = scores.withColumn("score", F.coalesce(table[F.col("dimension")], "score"))
    return scores, judges.weighted_aggregate(scores)


def table_judges(subject: DataFrame, reference: DataFrame | None = None, key: str | None = None, sensitive: str | None = None, outcome: str | None = None, target: str | None = None, task: str | None = None, columns: dict[str, str] | None = None) -> list[tuple[str, Callable[[], DataFrame]]]:
    """The judges that have what they need, by dimension."""
    rest = lambda df: df.drop(key) if key else df
    able: list[tuple[str, Callable[[], DataFrame]]] = [("diversity", lambda: judges.diversity(rest(subject)))]
    if reference is not None:
        able.append(("fidelity", lambda: judges.fidelity(rest(subject), rest(reference))))
        if key:
            able.append(("privacy", lambda: judges.privacy(subject, reference, key)))
        if target:
            able.append(("utility", lambda: judges.tstr_utility(rest(subject), rest(reference), target)))
    if sensitive and outcome:
        able.append(("bias", lambda: judges.fairness(subject, sensitive, outcome)))
    if task:
        able.append(("task_quality", lambda: task_quality(subject, task, columns)))
    return able


def run(subject: DataFrame, reference: DataFrame | None = None, overrides: dict[str, float] | None = None, **given) -> tuple[DataFrame, DataFrame]:
    """(scores, report): every judge of ``table_judges`` gives a row (dimension, score), or none if it does not apply; the report weighs them."""
    return _report(table_judges(subject, reference, **given), subject.sparkSession, overrides)


def graph_judges(subject: tuple[DataFrame, DataFrame], reference: tuple[DataFrame, DataFrame] | None = None, ontology: graph.Ontology | None = None) -> list[tuple[str, Callable[[], DataFrame]]]:
    able: list[tuple[str, Callable[[], DataFrame]]] = []
    if ontology is not None:
        able += [("graph_connectivity", lambda: graph.connectivity(*subject, ontology)), ("graph_ontology", lambda: graph.ontology_pass_rate(*subject, ontology).select(F.col("rate").alias("score")))]
    if reference is not None:
        able += [("graph_privacy", lambda: graph.graph_privacy(*subject, *reference)), ("graph_structure", lambda: graph.structural_fidelity(*subject, *reference)), ("graph_utility", lambda: graph.graph_tstr(*subject, *reference))]
    return able


def run_graph(subject: tuple[DataFrame, DataFrame], reference: tuple[DataFrame, DataFrame] | None = None, ontology: graph.Ontology | None = None, overrides: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, report) of a graph, as ``run`` gives them of a table."""
    return _report(graph_judges(subject, reference, ontology), subject[0].sparkSession, overrides)
