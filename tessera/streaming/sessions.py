"""Stateful streams: sessions that remember what they gave out, and debouncing in event time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which state of several kinds and timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


SEEN = "session long, call long, node string, turn long, first_turn long, first_tool string, hits long, refer boolean"


class _Tracker(StatefulProcessor):
    """Of a session: the turn it is at and when, and for each node the turn and tool that first gave it and how often it was asked again."""

    def __init__(self, min_turns_ago: int, pause: float):
        self.least, self.pause = min_turns_ago, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "turn long, at double")
        self.nodes = handle.getMapState("nodes", "node string", "turn long, tool string, hits long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """State is read and written once for each node that the micro-batch asks for, and not at all read in a new session."""
        known_session = self.clock.exists()
        turn, at = self.clock.get() if known_session else (0, None)
        at = None if at is None else round(at * 1e6)
        old = known_session  # whether nodes may be in state
        gap, asked, out = round(self.pause * 1e6), {}, []
        every = pd.concat(list(rows)).sort_values(["ts", "call"])
        times = every["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
        for call, node, tool, t in zip(every["call"].tolist(), every["node"].tolist(), every["tool"].tolist(), times, strict=True):
            if at is not None and t - at >= gap:
                if old:
                    self.nodes.clear()
                old, turn = False, 0
                asked.clear()
            turn, at = turn + 1, t if at is None or turn == 0 else max(at, t)
            name = node if node is not None else ""
            known = asked[name] if name in asked else self.nodes.getValue((name,)) if old and self.nodes.containsKey((name,)) else None
            first, by, hits = known if known else (turn, tool, 0)
            out.append((call, node, turn, first, by, hits, known is not None and turn - first >= self.least))
            asked[name] = (first, by, hits + 1)
        for name, value in asked.items():
            self.nodes.updateValue((name,), value)
        self.clock.update((turn, at / 1e6))
        for timer in list(self.handle.listTimers()) if known_session else ():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((at + gap) // 1000)
        yield pd.DataFrame({"session": [key[0]] * len(out), **dict(zip([c.split()[0] for c in SEEN.split(", ")][1:], zip(*out, strict=True), strict=True))})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clock.clear()
        self.nodes.clear()
        return iter(())

    def close(self) -> None:
        pass


def tracked(calls: DataFrame, min_turns_ago: int = 1, pause: float = 1800.0, late: str = "0 seconds") -> DataFrame:
    """For a stream of calls (call, session, node, tool, ts): the turn of each in its session, the turn and tool that gave its node first, how
    often the node was asked before, and whether to refer back: it was given at least `min_turns_ago` turns before.

    Turns count calls as they come, by time within a micro-batch. After `pause` seconds a session begins anew; a timer drops its state once the
    watermark has passed that. A null node is one node.
    """
    rows = calls.withWatermark("ts", late)
    return rows.groupBy("session").transformWithStateInPandas(_Tracker(min_turns_ago, pause), SEEN, "Append", "EventTime")


def tracked_batch(calls: DataFrame, min_turns_ago: int = 1, pause: float = 1800.0) -> DataFrame:
    """The same of a frame, in order of time."""
    order = W.partitionBy("session").orderBy("ts", "call")
    since = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    parts = calls.withColumn("part", F.sum((since >= int(pause * 1e6)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).fillna(0, ["part"])
    turns = parts.withColumn("turn", F.row_number().over(W.partitionBy("session", "part").orderBy("ts", "call")).cast("long"))
    own = W.partitionBy("session", "part", F.coalesce("node", F.lit(""))).orderBy("turn")
    out = turns.withColumns({"first_turn": F.min("turn").over(own), "first_tool": F.first("tool").over(own), "hits": (F.row_number().over(own) - 1).cast("long")})
    refer = (F.col("hits") > 0) & (F.col("turn") - F.col("first_turn") >= min_turns_ago)
    return out.select("session", "call", "node", "turn", "first_turn", "first_tool", "hits", refer.alias("refer"))


class _Debounce(StatefulProcessor):
    """Of a key: the last accepted time, and rows that the watermark hasn't passed yet, by time."""

    def __init__(self, key: str, seconds: float):
        self.key, self.gap = key, int(round(seconds * 1e6))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getListState("waiting", "at long, call long")

    def _release(self, k, watermark_ms: int) -> pd.DataFrame:
        """Rows at or before the watermark, which counts milliseconds, in order; the others stay."""
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] // 1000 <= watermark_ms]
        left = rows[len(due) :]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000)
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for at, call in due:
            if last is None or at - last >= self.gap:
                last = at
                kept.append(call)
        if last is not None:
            self.last.update((last,))
        return pd.DataFrame({self.key: [k] * len(kept), "call": kept})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        at = every["ts"].to_numpy("datetime64[us]").astype("int64")
        self.waiting.appendList(list(zip(at.tolist(), every["call"].tolist(), strict=True)))
        yield self._release(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._release(key[0], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def debounced(stream: DataFrame, key: str = "session", seconds: float = 2.0, late: str = "0 seconds") -> DataFrame:
    """Calls (call, ts) at least `seconds` after the last accepted one of their key, in order of event time: rows wait in state until the
    watermark, `late` behind the newest row, has passed them, so rows that come out of order by no more than that are judged in
    their place. What comes later still is dropped by the watermark."""
    rows = stream.select(key, "call", "ts").withWatermark("ts", late)
    return rows.groupBy(key).transformWithStateInPandas(_Debounce(key, seconds), f"{key} long, call long", "Append", "EventTime")
