"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; bytes.split() and bytes.strip() use exactly this set.
SPACES = b" \t\n\x0b\x0c\r"
#: Upper-case ASCII to lower case; every other byte stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows and bytes of one Arrow batch given to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; always through Spark's reader, so any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh local one on a local master (tests);
    on a cluster executors would write where nobody else can read, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, fixes row contents, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what `cut` wrote for these frames; nothing may read them any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and bytes (one row may be larger), none of them empty."""
    for batch in batches:
        left = [batch] if batch.num_rows else []
        while left:
            now = left.pop()
            n = now.num_rows
            if n > 1 and (n > rows or now.nbytes > size):
                half = rows if n > rows and now.nbytes <= size else n // 2
                left += [now.slice(half), now.slice(0, half)]
            else:
                yield now


def mapped(df: DataFrame, function: Callable, schema, rows: int = BATCH_ROWS) -> DataFrame:
    """df.mapInArrow(function, schema) with batches bounded by rows and bytes inside the worker, so that what a function holds for
    a batch is bounded too; the session's settings stay as they are."""
    return df.mapInArrow(lambda batches: function(sliced(batches, rows)), schema)


@contextmanager
def batch_bytes(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Smaller Arrow batches for the jobs that run inside; the session's setting comes back after them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id, mod: int):
    """crc32 of the decimal doc_id, mod `mod`, as a column."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(mod))


def fold_of(doc_id: int | None, mod: int) -> int | None:
    """The same in Python."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod
