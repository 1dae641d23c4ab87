"""Reading tables, tables staged in the cluster's shared folder, and small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Only where the session names none, on a local master, is a local one set, as in tests."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="loomgrid-shared-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and later reads survive lost executors.

    The table goes when the driver's session ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns to the system the memory that this process has freed and that Arrow's pool or malloc keep for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, over a task's batches, gives memory back at its end: workers live on from task to task, and count with their executor."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        def fed() -> Iterator:
            for batch in batches:
                yield batch
                pa.default_memory_pool().release_unused()

        try:
            yield from run(fed())
        finally:
            give_back()

    return wrapped


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of doc_id as text, modulo the folds; fold 0 is held out of every training. A null doc_id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df marked for broadcast if its counted rows are no more than the bound; beyond it the join shuffles both sides."""
    return F.broadcast(df) if rows <= most else df


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
