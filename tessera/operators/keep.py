"""Where iterative plans put a level aside, and ranks over whole frames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset a fresh local one on a local master, else an error: executors of a cluster
    would write where nobody can read."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def keep(df: DataFrame, name: str = "level") -> DataFrame:
    """Write df into the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def keep_marked(df: DataFrame, *columns: str) -> tuple[DataFrame, tuple]:
    """keep(df), and a mark of its rows (count and sum of hashes) that the write itself takes."""
    seen = Observation()
    out = keep(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")))
    return out, (seen.get["n"], seen.get["h"])


def discard(*frames: DataFrame) -> None:
    """Delete what `keep` wrote for these frames; nothing may read them any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(spark: SparkSession, rows: int, each: int = 1_000_000) -> int:
    """Tasks for that many rows: as many as set for shuffles, or more, so that a task's share doesn't grow with the rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with its rank (from 0) in that order, which must be total. A range sort and a sum over the partitions' sizes: no window over
    the whole frame in one task."""
    order = tuple(F.col(c) if isinstance(c, str) else c for c in order)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = keep(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")
