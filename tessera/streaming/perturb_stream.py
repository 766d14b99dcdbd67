"""Perturbations of streams: they keep no state, so each micro-batch is perturbed as a table is.

Draws are keyed by row key, and what an operator needs to know of a column is taken once from a reference table, so a row
gets the same perturbation in any batch, and a replayed batch gives the same rows. Families that need all rows at once
(ranks of values, places in an order, draws among all rows) are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.perturb import NEED_STATS, NEED_TABLE, Stats, perturb
from tessera.operators.profile import plain_numeric


def perturb_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, family: str, column: str, key: list[str], seed: int, intensity: float, kind: str | None = None, stats: Stats | None = None, **params) -> StreamingQuery:
    """Start a query that gives each perturbed micro-batch to ``sink(batch, number)``; ``stats`` are ``column_stats`` of a reference table."""
    numeric = column in plain_numeric(stream)
    if (family, kind) in NEED_TABLE and not params.get("mapping") or (family, kind) == ("noise", None) and not numeric:
        raise ValueError(f"{family}/{kind} needs the whole table")
    if (family, kind) in NEED_STATS and numeric and params.get("shift") is None and column not in (stats or {}):
        raise ValueError(f"{family}/{kind} needs column_stats of {column!r}")

    def each(batch: DataFrame, number: int) -> None:
        sink(perturb(batch, family, column, key, seed, intensity, kind, stats, **params), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
