"""Scratch tables on the shared folder, checked broadcasts and Arrow batch slicing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a side that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Estimated bytes of a side that may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Rows that Spark hands to Python at a time, so that long texts stay within a worker's memory.
ARROW_ROWS = 1024
#: Rows of ids in a file, where their number is known. On a local file system each file has its JVM start half a dozen
#: processes (chmod), and such a child reads as a second JVM of the same memory until it runs its own program.
FILE_ROWS = 1 << 17
#: Numbers of glibc's settings in mallopt().
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one (local runs, tests) only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="eventloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy", rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage is cut and survives lost executors.

    rows: a bound on the rows (a few ids each) of what an exchange has just dealt; no more tasks write them than they fill files."""
    path = scratch_path(df.sparkSession, name)
    out = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    out.write.option("compression", compression).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def dropped(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more; other DataFrames and None are left alone."""
    for table in tables:
        path = getattr(table, "scratch", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tidy(spark: SparkSession) -> None:
    """Has the driver let go of what nothing refers to any more, so that Spark deletes its shuffle files and broadcasts at once, and gives the memory back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def executors_tidy(spark: SparkSession) -> None:
    """Has each executor's JVM collect its garbage once, so that heap which a stage has touched and no longer uses goes back to where Python workers share it.

    A task for each executor, which an idle cluster deals one to each; where one gets none, its heap stays as it is."""
    n = spark._jsc.sc().getExecutorMemoryStatus().size() - 1  # without the driver
    if n > 0:
        spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").collect()


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """rows of the driver as a DataFrame, handed over by Arrow: a list would have executors start Python workers of its own, which stay."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow), kind)


def python_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch; a session with a smaller bound keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def small_side(side: DataFrame, bytes_per_row: int = 16) -> DataFrame:
    """side (cheap to count: a written table) with a broadcast hint if its size is within the bounds, else as it is."""
    n = side.count()
    if n <= BROADCAST_ROWS and n * bytes_per_row <= BROADCAST_BYTES:
        return F.broadcast(side)
    return side


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow where make() builds a task's own state and returns the function for each batch."""
    python_batches(df.sparkSession)

    def run(batches):
        each = make()
        for batch in batches:
            yield from each(batch)

    return map_batches(df, run, schema)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose worker gives the memory of a task back when it ends, since workers live on and share the executor."""

    def task(batches):
        try:
            libc = ctypes.CDLL("libc.so.6")
            # freed arrays are used again within the task rather than mapped anew
            libc.mallopt(_MMAP_THRESHOLD, 32 << 20)
            libc.mallopt(_TRIM_THRESHOLD, 256 << 20)
        except (OSError, AttributeError):  # another C library
            libc = None
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return df.mapInArrow(task, schema)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after the other, and the n+1 offsets; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """Row ranges of batch whose texts have about `most` bytes; a longer text stands alone, never cut."""
    _, offsets = texts_of(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def longs(values: np.ndarray) -> pa.Array:
    """uint64 fingerprints as signed longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
