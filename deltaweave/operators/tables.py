"""Tables that are written once and read back, to cut lineage or to evaluate a
plan only once.

They are Parquet below the folder that ``spark.checkpoint.dir`` names, which
driver and executors share, and go when the driver ends.  Where it is unset a
folder of the machine will do on a local master; on a cluster that raises, as
each executor would write to a disk of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of contents that a Python worker takes up at a time.
PART_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the shared folder, read back with its schema."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in slices of some ``PART_BYTES`` of its binary columns, one
    row at least, so that memory depends neither on the rows of a batch nor on
    the input."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, ends = 0, np.cumsum(size)
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PART_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop
