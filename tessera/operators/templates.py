"""Ready-made specs of common tables, to be taken as they are or with another number of rows or other rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.generate import FieldSpec, directives


@dataclass(frozen=True)
class Template:
    category: str
    rows: int
    fields: tuple[FieldSpec, ...]
    rules: tuple[dict, ...] = ()


def _number(name: str, low: float, high: float) -> FieldSpec:
    return FieldSpec(name, "float" if isinstance(low, float) else "integer", constraints={"min": low, "max": high})


def _choice(name: str, *choices: str) -> FieldSpec:
    return FieldSpec(name, "categorical", constraints={"choices": list(choices)})


_PLAN = _choice("plan", "free", "pro", "enterprise")
#: The specs by key, with their fields, bounds, choices and rows.
TEMPLATES = {
    "customers": Template("crm", 1_000, (FieldSpec("full_name", "name"), FieldSpec("email", "email"), FieldSpec("signup_date", "datetime"), _PLAN, FieldSpec("country", "address"))),
    "transactions": Template("finance", 5_000, (_number("amount", 1.0, 5000.0), _choice("currency", "USD", "EUR", "GBP"), FieldSpec("timestamp", "datetime"), FieldSpec("is_fraud", "boolean"))),
    "support_tickets": Template("support", 2_000, (FieldSpec("subject", "text"), _choice("priority", "low", "medium", "high", "urgent"), _choice("status", "open", "pending", "resolved", "closed"), FieldSpec("created_at", "datetime"), FieldSpec("resolved", "boolean"))),
    "sensor_readings": Template("iot", 10_000, (_choice("sensor_id", *(f"sensor-{i:03d}" for i in range(1, 21))), _number("temperature", -10.0, 45.0), _number("humidity", 0.0, 100.0), FieldSpec("reading_at", "datetime"), FieldSpec("anomaly", "boolean"))),
    "users_churn": Template("ml-labels", 3_000, (_number("age", 18, 90), _number("tenure_months", 0, 120), _number("monthly_spend", 0.0, 500.0), _PLAN, FieldSpec("churned", "boolean")), ({"kind": "use_case", "name": "rare_event", "field": "churned", "value": True},)),
}


def generate(spark: SparkSession, key: str, seed: int, rows: int | None = None, rules: list[dict] | None = None) -> DataFrame:
    """The table of a template; given rows and rules take the place of its own."""
    if key not in TEMPLATES:
        raise ValueError(f"unknown template {key!r}")
    t = TEMPLATES[key]
    return directives(spark, list(t.fields), list(t.rules) if rules is None else rules, 0, t.rows if rows is None else rows, seed)
