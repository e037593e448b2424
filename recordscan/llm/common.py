"""What the operators of this subpackage share: tables, the shared work folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import BATCH_BYTES, BATCH_ROWS, lean, read_table  # noqa: F401  operators take them from here


#: Files of a settled frame for each core of the cluster.
FILES = 3


def give_back() -> None:
    """Return a finished task's free memory to the system: workers are kept for later tasks, of other stages too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def frugal(run):
    """A mapInArrow function that gives free memory back when its task is done."""

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return all_


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return read_table(spark, sf_dir, name)


def work_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a temporary folder stands in for it on a single machine; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="recordscan-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def settle(df: DataFrame, label: str, drop: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    A lost executor costs no more than reading those files again. few: a small
    table that comes out of a shuffle; a core writes a few files of it, one
    partition after the other. drop: an earlier settled frame that nothing
    needs any more; its files are deleted.
    """
    spark = df.sparkSession
    path = f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"
    (df.coalesce(FILES * max(4, spark.sparkContext.defaultParallelism)) if few else df).write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._settled_at = path
    if drop is not None:
        release(drop)
    return back


def release(df: DataFrame) -> None:
    """Delete the files of a settled frame."""
    path = getattr(df, "_settled_at", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of column in one slice hold about `chars` bytes; a longer text is a slice of its own."""
    for batch in batches:
        sizes = batch.column(column)
        start, held = 0, 0
        for i, n in enumerate(pa.compute.binary_length(sizes).fill_null(0).to_pylist()):
            if held and held + n > chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
