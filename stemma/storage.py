"""Reading tables and writing intermediate ones that outlive executors."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="stemma-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Rows go to Python workers in batches of at most so many bytes: ten thousand long texts are no batch.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here and lost executors cost nothing.

    From here on the session's batches to Python hold at most BATCH_BYTES (or less, if so set)."""
    spark = df.sparkSession
    now = spark.conf.get(_BATCH).lower()
    if not now.isdecimal() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the cluster's cores where its scan has fewer splits than that: for work that costs far more than moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def trim() -> None:
    """Hand memory that this process's allocators hold without use back to the system."""
    pa.default_memory_pool().release_unused()
    of_libc = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if of_libc:
        of_libc(0)


def lean(run):
    """run, a function for mapInArrow, that at its task's end hands back to the system what the worker's allocators hold without use.

    Workers outlive their tasks: what one stage left in them counts against an executor's memory in the next."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return freed


def discard(df: DataFrame) -> None:
    """Delete a stored() table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
