"""Event-log analytics: usage, budgets, checkpoints, costs, time series. All aggregates and windows over the ledger frame."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .keep import keep, spread


def usage(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("tool").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def share(ledger: DataFrame) -> DataFrame:
    """Tokens of each tool and their share in percent."""
    u = usage(ledger)
    return u.crossJoin(F.broadcast(u.agg(F.sum("tokens").alias("all")))).select("tool", "tokens", F.round(F.coalesce(F.try_divide(F.col("tokens") * 100.0, F.col("all")), F.lit(0.0)), 2).alias("pct"))


def last_calls(ledger: DataFrame, n: int) -> DataFrame:
    return ledger.orderBy(F.desc("ts"), F.desc("call")).limit(n)


def newest_per(df: DataFrame, key: str, n: int, order: list[Column]) -> DataFrame:
    """Retention: the n newest rows of each key."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n).drop("rn")


def status(spent: Column, cap: int) -> Column:
    """OK, WARNING from 80 % on, EXCEEDED from 100 % on."""
    return F.when(spent >= cap, "EXCEEDED").when(spent >= 0.8 * cap, "WARNING").otherwise("OK")


def budget(ledger: DataFrame, cap: int) -> DataFrame:
    spent = F.col("spent")
    return ledger.groupBy("session").agg(F.sum("tokens").alias("spent")).select("session", "spent", F.greatest(F.lit(cap) - spent, F.lit(0)).cast("long").alias("remaining"), F.round(spent * 100.0 / cap, 2).alias("pct"), status(spent, cap).alias("status"))


def running_spend(ledger: DataFrame) -> DataFrame:
    order = W.partitionBy("session").orderBy("ts", "call").rowsBetween(W.unboundedPreceding, W.currentRow)
    return ledger.withColumn("spent", F.sum("tokens").over(order))


def checkpoint_chain(ledger: DataFrame) -> DataFrame:
    """Each checkpoint's parent: the one before it of the same task."""
    return ledger.withColumn("parent", F.lag("call").over(W.partitionBy("session").orderBy("ts", "call")))


def rollback(ledger: DataFrame, points: DataFrame) -> DataFrame:
    """Status of each checkpoint after going back to the given ones (session, since): those at or after it are rolled back."""
    state = F.when(F.col("since").isNotNull() & (F.col("ts") >= F.col("since")), "rolled_back").otherwise("active")
    return ledger.join(points, "session", "left").withColumn("status", state)


def cost(tokens: Column, price: Column) -> Column:
    return tokens * price / 1e6


def sessions(ledger: DataFrame, gap_minutes: int) -> DataFrame:
    """Sessions of a user: a pause over the gap begins a new one."""
    order = W.partitionBy("session").orderBy("ts", "call")
    pause = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    numbered = ledger.withColumn("new", (pause.isNull() | (pause > gap_minutes * 60_000_000)).cast("int")).withColumn("part", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbered.groupBy("session", "part").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def _runs(gap: int):
    """Adds to rows sorted by key and time the number of their run within the task; a run ends before another key or a pause of `gap`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            out = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last is not None and (key != last[0] or t - last[1] >= gap):
                    n += 1
                last = (key, t)
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "run"])

    return run


def _accepted(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            kept = []
            for i, (part, piece, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                if (part, piece) != now or t - last >= gap:
                    now, last = (part, piece), t
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64())).select([2, 4])

    return run


def debounce(ledger: DataFrame, key: str, seconds: float) -> DataFrame:
    """Calls that come at least `seconds` after the last accepted one of their key: a fold in order of time, which no window can say.

    A row after a pause of at least `seconds` is accepted whatever came before, so runs between such pauses are folded each by itself.
    Rows are sorted over all tasks by key and time and cut into runs there; what a task's first run continues follows from the tasks' first
    and last rows. Then runs are dealt out, so a key with all rows is many tasks. A run without any pause streams through one task that
    holds one time. Rows without a time are left out; a null key is a key.
    """
    kind = lambda c: ledger.schema[c].dataType.simpleString()
    gap = int(seconds * 1e6)
    rows = ledger.select(F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "call").where("t is not null")
    placed = rows.repartitionByRange("key", "t", "call").sortWithinPartitions("key", "t", "call")
    cut = keep(placed.mapInArrow(_runs(gap), f"key {kind(key)}, t long, call {kind('call')}, run long").select("*", F.spark_partition_id().alias("part")), "runs")
    end = lambda f, c: f(c, F.struct("run", "t", "call")).alias(f"{'first' if f is F.min_by else 'last'}_{c}")
    ends = cut.groupBy("part").agg(F.max("run").alias("runs"), *(end(f, c) for f in (F.min_by, F.max_by) for c in ("key", "t")))  # a row for each task
    order = W.orderBy("part")
    ends = ends.withColumn("goes_on", F.lag("last_key").over(order).eqNullSafe(F.col("first_key")) & (F.col("first_t") - F.lag("last_t").over(order) < gap))
    own = F.when((F.col("runs") > 0) | ~F.coalesce("goes_on", F.lit(False)), F.struct(F.col("part").cast("long").alias("part"), F.col("runs").alias("run")))
    ends = ends.withColumn("open", F.last(own, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    before = F.broadcast(ends.select("part", F.coalesce("goes_on", F.lit(False)).alias("goes_on"), "open"))
    piece = F.when(F.col("goes_on") & (F.col("run") == 0), F.col("open")).otherwise(F.struct(F.col("part").cast("long").alias("part"), "run"))
    pieces = cut.join(before, "part").withColumn("piece", piece).select(F.col("piece.part").alias("part"), F.col("piece.run").alias("run"), "key", "t", "call")
    dealt = pieces.repartition(spread(ledger.sparkSession, cut.count()), "part", "run").sortWithinPartitions("part", "run", "t", "call")
    return dealt.mapInArrow(_accepted(gap), f"key {kind(key)}, call {kind('call')}").withColumnRenamed("key", key)
