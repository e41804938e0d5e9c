"""Streaming twins of ledger queries, run over what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import ORACLE_SQL, query
from ..sources.tables import LEDGER_SQL, ledger
from ..streaming import ledger_stream as st
from ..streaming import sessions

L = f"WITH {LEDGER_SQL} "
CAP = 5000


def _run(frame: DataFrame, mode: str = "complete") -> DataFrame:
    return st.settle(frame, f"s_{uuid.uuid4().hex}", mode)


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return st.ledger_stream(spark, sf, "events.parquet")


@query(L + "SELECT tool, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM ledger GROUP BY tool")
def stream_tool_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _run(st.tool_counts(_ledger(spark, sf)))


@query(L + "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM ledger GROUP BY 1")
def stream_windowed(spark: SparkSession, sf: str) -> DataFrame:
    return _run(st.windowed(_ledger(spark, sf)))


@query(L + f"SELECT session, CAST(sum(tokens) AS BIGINT) AS spent, CASE WHEN sum(tokens) >= {CAP} THEN 'EXCEEDED' WHEN sum(tokens) >= {0.8 * CAP} THEN 'WARNING' ELSE 'OK' END AS status FROM ledger GROUP BY session")
def stream_budget(spark: SparkSession, sf: str) -> DataFrame:
    return _run(st.budgets(_ledger(spark, sf), CAP))


@query(ORACLE_SQL["debounce"])
def stream_debounce(spark: SparkSession, sf: str) -> DataFrame:
    with sessions.rocksdb_state(spark):
        return _run(sessions.debounced(_ledger(spark, sf), "session", 3600.0), "append")


PAUSE = 21_600
TURNS = f"""WITH {LEDGER_SQL}, x AS (SELECT session, call, 'n' || (call % 7) AS node, tool, ts, sum(CASE WHEN epoch_us(ts) - epoch_us(prev) >= {PAUSE}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, call) AS part
FROM (SELECT *, lag(ts) OVER (PARTITION BY session ORDER BY ts, call) AS prev FROM ledger)), t AS (SELECT *, row_number() OVER (PARTITION BY session, part ORDER BY ts, call) AS turn FROM x)
SELECT session, call, node, turn, min(turn) OVER w AS first_turn, first_value(tool) OVER w AS first_tool, row_number() OVER w - 1 AS hits, row_number() OVER w > 1 AND turn - min(turn) OVER w >= 2 AS refer FROM t WINDOW w AS (PARTITION BY session, part, node ORDER BY turn ROWS UNBOUNDED PRECEDING)"""


def _noded(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("node", F.concat(F.lit("n"), (F.col("call") % 7).cast("string")))


@query(TURNS)
def stream_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of sessions, and whether a call can refer back to what was given at least two turns before; a pause begins a session anew."""
    with sessions.rocksdb_state(spark):
        return _run(sessions.tracked(_noded(_ledger(spark, sf)), 2, float(PAUSE)), "append")


@query(TURNS)
def turn_references(spark: SparkSession, sf: str) -> DataFrame:
    """The same of a frame."""
    return sessions.tracked_batch(_noded(ledger(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp")), 2, float(PAUSE))


@query(L + "SELECT session, tool FROM ledger GROUP BY session, tool")
def stream_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return _run(st.first_seen(_ledger(spark, sf), "3650 days"), "append").select("session", "tool")
