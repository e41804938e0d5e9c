"""Structured Streaming twins of the ledger queries, and what watches files.

Sources are directories (or any streaming source with the ledger's columns). Late rows fall to the watermark where a query has one.
Stateful steps keep one row of state for each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.code import predicted_questions
from ..operators.keep import shared_dir
from ..sources.files import BINARY_FILE

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def ledger_stream(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """call, session, tool, ts (with time zone), tokens of a directory of event files."""
    e = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 64).parquet(path)
    return e.select(F.col("event_id").alias("call"), F.col("user_id").alias("session"), F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.abs("value")).cast("long").alias("tokens"))


def tool_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("tool").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling buckets behind a watermark."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:00").alias("hour"), "calls", "tokens")


def budgets(stream: DataFrame, cap: int) -> DataFrame:
    spent = F.col("spent")
    state = F.when(spent >= cap, "EXCEEDED").when(spent >= 0.8 * cap, "WARNING").otherwise("OK")
    return stream.groupBy("session").agg(F.sum("tokens").alias("spent")).select("session", "spent", state.alias("status"))


def first_seen(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The first call of each tool in a session."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "tool"])


def watch_files(spark: SparkSession, path: str, pattern: str = "*.py") -> DataFrame:
    """path, length, modified of files as they appear or change under a directory."""
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def rebuild_on(stream: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Call rebuild for each micro-batch of changes; every: a processing-time trigger, by default what is there now."""
    w = stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def settle(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return the frame of its result. Each micro-batch writes its own folder below the shared
    one (again the same after a retry); complete mode reads the last, append mode all of them."""
    spark = stream.sparkSession
    at, seen = f"{shared_dir(spark)}/{name}", []

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/{i}")
        seen.append(f"{at}/rows/{i}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(seen[-1:] if mode == "complete" else dict.fromkeys(seen)))


def progress(query: StreamingQuery, total: int) -> dict:
    """Rows done of a total and their percentage, by the query's own progress."""
    done = sum(p["numInputRows"] for p in query.recentProgress)
    return {"status": "building" if query.isActive else "complete", "files_done": done, "files_total": total, "percent": min(100, 100 * done // max(total, 1))}


def prewarm(answer: Callable[[str], str | None], save: Callable[[str, str], None], most: int = 10) -> Callable[[DataFrame, int], None]:
    """For `rebuild_on`: after each micro-batch of changed files (path) the `most` likeliest questions about them are answered and saved."""

    def run(batch: DataFrame, _: int) -> None:
        likely = batch.select(F.posexplode(predicted_questions(F.col("path"))).alias("i", "q")).groupBy("q").agg(F.min("i").alias("i")).orderBy("i", "q").limit(most)
        for r in likely.collect():
            if said := answer(r.q):
                save(r.q, said)

    return run
