"""A graph that can be read while it grows: files come as a stream, each micro-batch is merged into the store's graph."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import build, increment
from ..operators.keep import keep
from ..sources import files as source
from ..sources.store import Store


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    is_partial: bool


def read(store: Store) -> Graph | None:
    """The graph that is there: the finished one, else the partial one of a build that is under way, else none."""
    for prefix, partial in (("", False), ("partial_", True)):
        nodes, edges = store.frame(f"{prefix}nodes"), store.frame(f"{prefix}edges")
        if nodes is not None and edges is not None:
            return Graph(nodes, edges, partial)
    return None


def file_stream(spark: SparkSession, root: str, at_once: int = 64) -> DataFrame:
    """path (below root), length, modified, content (bytes) of the files that a scan of root keeps, `at_once` in a micro-batch."""
    raw = spark.readStream.format("binaryFile").schema(source.BINARY_FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", at_once).load(root)
    return source.wanted(raw, root).withColumn("path", source.below(F.col("path"), root)).drop("type")


def merge_batch(store: Store, extract: Callable | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: takes a batch of files into the graph and writes it as the partial one. A batch that runs again changes nothing:
    its contents are known by then, and rows of a path replace each other."""

    def run(batch: DataFrame, _: int) -> None:
        batch = keep(batch, "batch")  # the source is read once, so that its row count is that of the files
        files = source.decoded(batch) if batch.schema["content"].dataType.simpleString() == "binary" else batch
        increment.apply(store, files, batch.select("path").limit(0), extract)
        nodes, edges = increment.settle(store)
        store.replace("partial_nodes", nodes.withColumn("is_partial", F.lit(True)))
        store.replace("partial_edges", edges)

    return run


class Progress(StreamingQueryListener):
    """Writes a build's status as its micro-batches end: rows done so far of a total, for the stream of one name."""

    def __init__(self, store: Store, name: str, total: int):
        self.store, self.name, self.total, self.done = store, name, total, 0
        self.started, self.seen = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), []

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._tell("building", "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name and p.numInputRows:
            self.done += p.numInputRows
            self._tell("building", f"batch {p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def _tell(self, status: str, message: str) -> None:
        self.seen.append(self.store.write_status(status, min(self.done, self.total), self.total, self.started, message)["percent"])


def start(spark: SparkSession, root: str, out: str, extract: Callable | None = None, at_once: int = 64, every: str | None = None, name: str = "graph") -> StreamingQuery:
    """Starts the stream of a folder's files into `out`; every: a processing-time trigger, by default what is there now."""
    store = Store(spark, out)
    w = file_stream(spark, root, at_once).writeStream.queryName(name).foreachBatch(merge_batch(store, extract)).option("checkpointLocation", f"{out}/stream-state")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def build_progressively(spark: SparkSession, root: str, out: str, extract: Callable | None = None, at_once: int = 64, name: str = "graph") -> build.Build:
    """A build by micro-batches: the partial graph and the status grow, then the graph is finished as any build's."""
    store = Store(spark, out)
    total = source.scan(spark, root).count()
    listener = Progress(store, name, total)
    spark.streams.addListener(listener)
    try:
        q = start(spark, root, out, extract, at_once, name=name)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    old = (store.frame("nodes"), store.frame("edges")) if store.exists("nodes") and store.exists("edges") else None
    change = increment.update(store, root, extract)  # files that went or changed since the stream saw them
    change.read += listener.done
    change.parsed += listener.done
    return build.finish(store, listener.started, change, old)
