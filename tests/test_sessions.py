"""Stateful streams against their batch twins, over several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import folded

from tessera.streaming import sessions

CALLS = "call long, session long, node string, tool string, ts timestamp"


def fed(spark, path, batches, frame, name):
    """Rows that a stream gives when the batches (lists of rows) come one by one."""
    source = str(path / name)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "call long, session long, node string, tool string, t double").select("call", "session", "node", "tool", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts")).coalesce(1).write.mode("append").parquet(f"{source}/{i:03d}")
    out = []
    with sessions.rocksdb_state(spark):
        stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
        q = frame(stream).writeStream.foreachBatch(lambda df, i: out.extend(df.collect())).option("checkpointLocation", str(path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    return out


def calls(n, seed, step=(1.0, 5.0, 40.0, 4000.0)):
    r = random.Random(seed)
    t, rows = 0.0, []
    for i in range(n):
        t += r.choice(step)
        rows.append((i, r.randrange(3), r.choice(["a", "b", "c", "d", None]), r.choice(["x", "y"]), t))
    return rows


@pytest.mark.parametrize("least", [1, 3])
def test_tracker(spark, tmp_path, least):
    rows = calls(240, least)
    got = fed(spark, tmp_path, [rows[i : i + 40] for i in range(0, 240, 40)], lambda s: sessions.tracked(s, least, 1800.0), "calls")
    df = spark.createDataFrame(rows, "call long, session long, node string, tool string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    want = sessions.tracked_batch(df, least, 1800.0).collect()
    order = lambda rs: sorted(tuple(r) for r in rs)
    key = lambda rs: sorted(map(str, order(rs)) if any(r.node is None for r in rs) else order(rs))
    assert key(got) == sorted(str(tuple(r)) for r in want)
    assert any(r.refer for r in want) and any(r.hits and not r.refer for r in want) == (least > 1) and max(r.turn for r in want) < 80


def test_debounce_in_event_time(spark, tmp_path):
    rows = [(c, 1, n, t, ts) for c, _, n, t, ts in calls(300, 9, (0.0, 0.25, 0.5, 1.75, 2.0, 9.0))]
    r = random.Random(1)
    shuffled = sorted(rows, key=lambda x: x[4] + r.uniform(0, 8))  # no row is over 8 s late
    got = fed(spark, tmp_path, [shuffled[i : i + 30] for i in range(0, 300, 30)], lambda s: sessions.debounced(s, "session", 2.0, "10 seconds"), "late")
    end = max(x[4] for x in rows)
    want = [c for c in folded([(c, k, t) for c, k, _, _, t in rows], 2.0) if rows[c][4] <= end - 10]
    assert sorted(x.call for x in got) == want  # the last ten seconds still wait
    every = fed(spark, tmp_path, [rows[i : i + 30] for i in range(0, 300, 30)], lambda s: sessions.debounced(s, "session", 2.0), "ordered")
    assert sorted(x.call for x in every) == folded([(c, k, t) for c, k, _, _, t in rows], 2.0)


def test_tracker_reads_and_writes_a_node_once():
    import pandas as pd

    class Value:
        held, calls = None, 0

        def __getattr__(self, name):
            def call(*given):
                self.calls += 1
                if name == "exists":
                    return self.held is not None
                self.held = given[0] if name == "update" else None if name == "clear" else self.held
                return self.held

            return call

    class Map(dict):
        calls = 0

        def getValue(self, k):
            self.calls += 1
            return self[k]

        def containsKey(self, k):
            self.calls += 1
            return k in self

        def updateValue(self, k, v):
            self.calls += 1
            self[k] = v

    class Handle:
        clock, nodes, timers, listed = Value(), Map(), [], 0

        def getValueState(self, *_):
            return self.clock

        def getMapState(self, *_):
            return self.nodes

        def listTimers(self):
            self.listed += 1
            return iter(list(self.timers))

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    handle, tracker = Handle(), sessions._Tracker(1, 1800.0)
    tracker.init(handle)
    rows = pd.DataFrame({"call": range(300), "node": ["a", "b", None] * 100, "tool": "x", "ts": pd.to_datetime(range(300), unit="s")})
    (first,) = tracker.handleInputRows((1,), iter([rows[:200]]), None)
    assert handle.nodes.calls == 3 and handle.listed == 0  # a new session: nothing to read
    (rest,) = tracker.handleInputRows((1,), iter([rows[200:]]), None)
    assert handle.nodes.calls <= 3 + 3 * 3 and handle.listed == 1 and len(handle.timers) == 1
    assert [*first.hits, *rest.hits] == [i // 3 for i in range(300)] and [*first.turn, *rest.turn] == list(range(1, 301))
    later = pd.DataFrame({"call": [300, 301], "node": ["a", "a"], "tool": "y", "ts": pd.to_datetime([299 + 1800, 5000], unit="s")})
    (anew,) = tracker.handleInputRows((1,), iter([later]), None)  # after exactly the pause, and again after another
    assert list(anew.turn) == [1, 1] and list(anew.hits) == [0, 0] and dict(handle.nodes) == {("a",): (1, "y", 1)}
