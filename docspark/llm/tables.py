"""Intermediate tables in the cluster's shared folder, and the Arrow plumbing the operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docspark.session import scratch_path

_owned: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Arrow batches small enough that a task's arrays over one stay within some hundred MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, kept when executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _owned.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    """Removes the tables when the program ends, if its session is still there."""
    for spark, path in _owned:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone already; the folder is the cluster's to clear
            return


def release() -> None:
    """Gives a worker's free memory back: workers live on and wait beside tasks that need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which does so itself or not at all
        return


def settle(spark: SparkSession) -> None:
    """Between jobs: lets the driver drop what is done, so that its shuffles and broadcasts are removed, and give memory back."""
    gc.collect()
    spark._jvm.System.gc()
    release()


def map_batches(df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """``mapInArrow`` with something made once per task: ``make()`` gives the function over batches."""

    def run(batches):
        step = make()
        for b in batches:
            if b.num_rows:
                yield from step(b)
        del step
        release()

    return df.mapInArrow(run, schema)


def fields(df: DataFrame, names: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    """The named columns of ``df`` and further ones."""
    return T.StructType([df.schema[n] for n in names] + [T.StructField(n, t) for n, t in more])
