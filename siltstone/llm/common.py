"""Shared helpers: tables kept in the shared checkpoint folder, word patterns, Arrow plumbing."""

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
from pyspark.sql.window import Window

#: A word is a run of anything but ASCII white space; bytes.split() splits UTF-8 exactly so.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. It must be set: a folder of one machine won't do on a
    cluster. In local mode, where all is one machine and nothing but tests and benches runs, a temporary
    one serves if it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        where = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where := f"file://{where}")
        return where
    raise ValueError("spark.checkpoint.dir is not set: operators need a folder that driver and executors share")


def limit_per(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps n rows a key and task below the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


class Scratch:
    """Intermediate tables as Parquet in the shared folder: lineage ends there, and any executor can read them again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        """Names in a folder of this scratch; none if there is no such folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


#: Bytes of text that are worked on at once; a longer text is worked on alone.
PORTION = 4 << 20


def portions(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose strings and binaries take PORTION bytes at most, or that are one row."""
    size = np.zeros(b.num_rows, np.int64)
    for c in b.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < b.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")))
        yield b.slice(at, upto - at)
        at = upto


def by_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function that applies f to each portion of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b):
                if (out := f(part)) is not None:
                    yield out
        release()

    return run


def release() -> None:
    """Gives memory that is free in this process back to the machine: a worker serves many tasks, and waits between them."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 100_000, most: int | None = None) -> Iterator[pa.Table]:
    """Regroups a partition that is sorted by key into tables of `rows` rows or more, so that no run of equal keys is cut; but a
    table of `most` rows or more, if that is given, may end within a run."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        if n >= rows:
            values = b.column(key).to_numpy(zero_copy_only=False)
            before = held[-1].column(key)[-1].as_py()
            other = np.flatnonzero(values != before)
            if len(other):
                yield pa.Table.from_batches([*held, b.slice(0, int(other[0]))])
                held, n, b = [], 0, b.slice(int(other[0]))
            elif most is not None and n >= most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        held.append(b)
        n += b.num_rows
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    release()


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of steps whose results are already written."""
    gc.collect()
    spark._jvm.System.gc()


def unit_hash(seed: int, *columns) -> F.Column:
    """A number strictly between 0 and 1 that depends on the values and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)
