"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows, and bytes beyond one row, handed to a Python function at once: bound the memory of one step.
ROWS_AT_ONCE = 512
BYTES_AT_ONCE = 4 << 20
#: Most rows of an Arrow batch between Spark and Python, and the setting.
BATCH_ROWS = 2 * ROWS_AT_ONCE
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def sliced(batches: Iterable[pa.RecordBatch], most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ROWS_AT_ONCE rows and `most` bytes; a longer row is a slice of its own."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            within = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
            stop = max(start + 1, min(within, start + ROWS_AT_ONCE, batch.num_rows))
            yield batch.slice(start, stop - start)
            start = stop


def released(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, at whose end a worker gives what it no longer needs back to the system: it may wait long for its next task, beside others."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return wrapped


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session hands rows to Python in batches of BATCH_ROWS at most; Spark's 10,000 texts at once are held several times over by a task's JVM and its worker. A smaller setting stays."""
    given = int(df.sparkSession.conf.get(ARROW_ROWS))
    if not 0 < given <= BATCH_ROWS:
        df.sparkSession.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    return df


def map_rows(df: DataFrame, fn: Callable[[list[dict]], Iterator[tuple] | list[tuple]], schema: str) -> DataFrame:
    """Streams `df` through `fn`, which turns a list of row dicts into output tuples. No shuffle; integers stay integers beside nulls."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in sliced(batches):
            out = list(fn(batch.to_pylist()))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return small_batches(df).mapInArrow(released(run), struct)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each behind as many '_' as it takes to differ from all columns of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of our own on a single machine, as in tests, and an error on a cluster, whose executors couldn't share it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="graphtide-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Store:
    """Tables written to the shared folder, which cut lineage and outlive a lost executor.

    Shuffle files of what led to a table are removed once it is written; `drop` removes the tables themselves, and those
    that are left go with the application. A dropped table must not be read again.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/graphtide-{uuid.uuid4()}")
        self.files = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.deleteOnExit(self.folder)
        self.names = count()

    def table(self, df: DataFrame) -> DataFrame:
        """`df` as a written table."""
        path, before = f"{self.folder.toString()}/{next(self.names)}", self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self.files.delete(self.folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` as a table of the shared folder, which stays until the application ends."""
    return Store(df.sparkSession).table(df)
