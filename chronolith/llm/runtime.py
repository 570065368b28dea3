"""What the operators of this subpackage share: table access, the shared folder and Arrow batch mapping."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..session import shared_dir

#: Bytes of text that the numpy kernels take at once; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, path: str | None = None, tasks: int | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read back: the lineage ends there and any executor can reread them.

    tasks: at most so many files for each core of the cluster, for tables of narrow rows; else each partition writes its own.
    """
    spark = df.sparkSession
    path = path or stage_path(spark, name)
    few = df if tasks is None else df.coalesce(tasks * spark.sparkContext.defaultParallelism)
    few.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when they are garbage-collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return what this Python worker has freed to the system: workers wait between tasks, and what they keep counts as the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back when its task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch of texts, where the session has Spark's default of 10000, made for narrow rows.
TEXT_ROWS = 500
#: Batches between which a worker gives back what it has freed.
TIDY = 8


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold some MB of text at most, on both sides of the Python worker, unless the session says how many rows."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(TEXT_ROWS))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most, for rows of several KB; holds for what runs inside."""
    text_batches(spark)
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if buffers[2] is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes of text, one row at least."""
    _, offsets = raw_text(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


Kernel = Callable[[np.ndarray, np.ndarray], Iterable]


def map_text(df: DataFrame, text: str, fields: dict[str, str], make: Callable[[], Kernel], keep: list[str], most: int = PIECE_BYTES, kept: str | None = None) -> DataFrame:
    """The columns ``keep`` of df and the columns that a kernel makes of each text.

    make() runs once a task and returns kernel(bytes, offsets) -> one array for each field. A kept column with the name of
    a field gives way to the field. kept: a boolean field; rows where it is false go, and the field with them.
    """
    text_batches(df.sparkSession)
    made = StructType([StructField(k, _parse_datatype_string(v)) for k, v in fields.items()])
    keep = [c for c in keep if c not in fields]
    source = df.select(*[df[c] for c in keep], df[text].cast("string").alias("__text"))
    out = StructType([source.schema[c] for c in keep] + [f for f in made if f.name != kept])
    types = [to_arrow_type(f.dataType) for f in made]
    names, n, at = [f.name for f in out], len(keep), list(fields).index(kept) if kept else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for k, batch in enumerate(batches):
            if k % TIDY == TIDY - 1:
                give_back()
            for piece in pieces(batch, n, most):
                columns = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(kernel(*raw_text(piece.column(n))), types, strict=True)]
                if at is None:
                    yield pa.RecordBatch.from_arrays(piece.columns[:n] + columns, names)
                else:
                    yield pa.RecordBatch.from_arrays([x.filter(columns[at]) for x in piece.columns[:n] + columns[:at] + columns[at + 1 :]], names)

    return source.mapInArrow(tidy(run), out)
