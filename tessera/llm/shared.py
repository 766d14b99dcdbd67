"""Helpers that the operators of this subpackage share: shared-folder tables, text mapping, column hygiene."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Split a text on these to get the words that most contracts use; equals ``[^\x20\x09-\x0D]+``.
WORD_SEP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder every node sees: ``spark.checkpoint.dir``; only a plain local session may fall back to a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


BATCH_ROWS = 256
#: Paths of this thread's tables that are still in the shared folder, oldest first; other threads have lists of their own.
_open: ContextVar[tuple[str, ...]] = ContextVar("open_tables", default=())


def open_tables() -> tuple[str, ...]:
    return _open.get()


def materialize(df: DataFrame, name: str = "t", narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor costs a reread, not a recomputation.

    ``narrow`` tables, of few bytes a row, are written as a sixteenth of the session's shuffle partitions in files. What
    nothing deletes before is deleted when the driver's JVM ends."""
    spark = df.sparkSession
    if narrow:
        df = df.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    _open.set((*_open.get(), path))
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _open.set(tuple(p for p in _open.get() if p not in paths))


def roots(df: DataFrame) -> set[str]:
    """Folders and files that ``df`` reads, as given to its readers; their contents aren't listed."""
    found: set[str] = set()
    leaves = df._jdf.queryExecution().analyzed().collectLeaves().iterator()
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths().iterator()
            while paths.hasNext():
                found.add(paths.next().toString())
    return found


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.shared_path)


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of 256 rows, unless the session sets their length itself: rows hold whole texts and sets of any size, and a batch is in memory in the JVM and in Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def named(col: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + col.replace("`", "``") + "`")


def kind(df: DataFrame, col: str) -> DataType:
    """Type of a column, found in any case as Spark finds it."""
    return df.select(named(col)).schema[0].dataType


def others(df: DataFrame, col: str) -> tuple[str, ...]:
    """The columns but ``col``."""
    return tuple(c for c in df.columns if c.lower() != col.lower())


def fields(*parts: str | tuple[str, DataType]) -> StructType:
    """A schema from DDL and (name, type) pairs; types stay objects, as the names of nested fields may need quotes."""
    made = StructType()
    for part in parts:
        for f in StructType.fromDDL(part) if isinstance(part, str) else [StructField(*part)]:
            made = made.add(f)
    return made


def carried(df: DataFrame, carry: tuple[str, ...]) -> tuple[list[Column], list[tuple[str, DataType]]]:
    """Columns that go along under names of their own, and their schema."""
    return [named(c).alias(f"_c_{i}") for i, c in enumerate(carry)], [(f"_c_{i}", kind(df, c)) for i, c in enumerate(carry)]


class Lists(dict):
    """Columns of an Arrow batch as lists, each made when it is first read."""

    def __init__(self, batch: pa.RecordBatch):
        super().__init__()
        self.batch = batch

    def __missing__(self, name: str) -> list:
        self[name] = self.batch.column(name).to_pylist()
        return self[name]


def map_rows(df: DataFrame, fn: Callable[[Lists], dict[str, list]], schema: str | StructType) -> DataFrame:
    """``fn`` gets one Arrow batch as lists by column and returns lists by output column.

    Output columns that it doesn't return are the batch's own, which never become Python objects; if rows are added or
    left out, it returns all."""
    from pyspark.sql.pandas.types import to_arrow_schema

    short_batches(df.sparkSession)
    schema = fields(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):  # few long texts are Python objects at a time
                part = batch.slice(at, BATCH_ROWS)
                out = fn(Lists(part))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name in out else part.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def text_or_empty(col: str) -> Column:
    return F.coalesce(named(col).cast("string"), F.lit(""))


def remainder(col: str, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; null for a null id."""
    return F.crc32(named(col).cast("string")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
