"""Corpus pipeline: quality rules, near-duplicates, secrets, mixing and packing over ``documents``.

Each stage gets what the one before it kept, in the columns of ``documents``; the last returns the pieces of the packed
sequences. Stages work on whole tables, and their results are written and reread, so a lost executor costs one stage's
tasks and never the stages before it.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from tessera.llm.shared import delete, discard, materialize, open_tables, roots, table

#: Tables of this thread's stage that ran last; the next one, whose input is that stage's written result, deletes them.
_spent: ContextVar[tuple[str, ...]] = ContextVar("spent", default=())


def _tidy(stage: Callable) -> Callable:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = roots(docs)
        kept = tuple(path for path in _spent.get() if any(path in root for root in read))  # the input isn't written yet
        delete(spark, *(path for path in _spent.get() if path not in kept))
        before = open_tables()
        out = stage(spark, docs, sf_dir)
        _spent.set((*kept, *(path for path in open_tables() if path not in before)))
        return out

    return run


@_tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality_rules.keep(docs)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id."""
    return near_dedup.deduplicate(docs)


@_tidy
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of live-looking credentials masked."""
    return secret_scan.redact(docs)


@_tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources by weight: drawn documents, in whole or in blocks of words, once for each repeat."""
    return mixing.mix(docs)


@_tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with a checksum of their ids."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secrets", secrets), ("mixing", mix), ("packing", pack)]

#: Outlier estimates, signatures and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result, which stays in the shared folder until the driver ends; each stage's input is deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    delete(spark, *_spent.get())
    _spent.set(())
    return docs
