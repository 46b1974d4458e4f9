"""What the operators of this subpackage share: shared folders, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in rows, that is broadcast. Rows there are a few dozen bytes.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the context's. Only in local mode, where all is one machine, a new one is made if none is set."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='scoreloom-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/scoreloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: for wide rows of which later steps read a few columns."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of what stored() returned. Nothing that is still to be computed may read them."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only if a count shows at most so many rows. Call it on what is cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def texts(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return pc.fill_null(column, "").to_pylist()


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra or clashing columns can't interfere."""
    return df.select(*(df[name].alias(own) for own, name in columns.items()))


def power_of_two(n: int) -> int:
    """The least power of two that is n or more."""
    return 1 << max(0, int(n) - 1).bit_length()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2048) -> Iterator[None]:
    """What runs inside hands Python at most so many rows at once: for wide rows, of which a usual batch would fill the memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside has the shuffle files of each query deleted once the query is over, instead of when the driver collects its garbage. Nothing inside may count on reading them twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def heaps_returned(spark: SparkSession) -> None:
    """Has the executors collect their garbage, so that heap which earlier steps have left goes back to the system and Python may have it.

    A task on each core reaches all executors of an idle cluster; one that is missed only keeps its heap.
    """
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


#: What drops the models that operators keep from task to task in a Python worker.
KEPT: list[Callable[[], None]] = []


def give_back(drop: bool = True) -> None:
    """Hands memory that a Python worker has freed back to the system; drop: also that of models which other operators have kept there."""
    for one in KEPT if drop else ():
        one()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
