"""Shared scratch tables, used to cut lineage and to reuse a computed table.

A table is written once as Parquet below the folder named by
``spark.checkpoint.dir`` (shared by driver and executors) and read back, so a
lost executor costs the recomputation of nothing but its running tasks.  Where
the setting is absent, a local master gets a temporary folder and a cluster an
error.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..operators.tables import shared_folder as scratch_dir
from ..operators.tables import written as keep

#: Rows of an Arrow batch where the session does not say; rows handled at a time.
ARROW_ROWS, TEXT_ROWS, NUMBER_ROWS = 1024, 512, 16_384
#: Rows that are broadcast to spare a shuffle, and their bytes (as JSON) where
#: they hold more than numbers.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have texts go to Python in small Arrow batches, so that neither the
    executor's buffers nor its workers hold much of a partition.

    A session that sets the size itself keeps it; else every operator sets the
    same one, so that results may be planned in any order.
    """
    default = spark._jvm.org.apache.spark.sql.internal.SQLConf.ARROW_EXECUTION_MAX_RECORDS_PER_BATCH().defaultValueString()
    if spark.conf.get(_ROWS_SETTING) == default:
        spark.conf.set(_ROWS_SETTING, str(ARROW_ROWS))


def give_back() -> None:
    """Return unused memory of this Python process, which Spark keeps for later
    tasks, to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def heaps_give_back(spark: SparkSession) -> None:
    """Have each executor collect its garbage and return the unused part of its
    heap to the machine, for the Python workers beside it; by one short task a core."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).collect()


def leaving_nothing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], also: Callable[[], None] = lambda: None) -> Callable:
    """``run``, a function over the batches of a task, and :func:`give_back` behind it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            also()
            give_back()

    return each


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = NUMBER_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of numbers put together to ``rows`` or a little more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the scratch files behind a table returned by :func:`keep`."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def few(df: DataFrame, name: str) -> DataFrame:
    """``df`` in scratch, broadcast in joins if it is small by count and, with
    columns that are no numbers, by bytes."""
    kept = keep(df, name)
    small = kept.count() <= BROADCAST_ROWS
    if small and not all(isinstance(f.dataType, NumericType) for f in kept.schema):
        small = (kept.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0) <= BROADCAST_BYTES
    return F.broadcast(kept) if small else kept


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name built on ``name`` that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


__all__ = ["few", "forget", "fresh", "gathered", "give_back", "heaps_give_back", "is_empty", "keep", "leaving_nothing", "scratch_dir", "slices", "small_batches"]
