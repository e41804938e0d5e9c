"""Queries over the tool-call ledger and what stands in for checkpoints, model calls and reputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import ledger as op
from ..registry import query
from ..sources.tables import LEDGER_SQL, ledger, table

L = f"WITH {LEDGER_SQL} "
CAP = 5000


@query(L + "SELECT tool, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM ledger GROUP BY tool")
def tool_usage(spark: SparkSession, sf: str) -> DataFrame:
    return op.usage(ledger(spark, sf))


@query(L + "SELECT tool, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) * 100.0 / (SELECT sum(tokens) FROM ledger), 2) AS pct FROM ledger GROUP BY tool")
def tool_share(spark: SparkSession, sf: str) -> DataFrame:
    return op.share(ledger(spark, sf))


@query(L + "SELECT call, session, tool, tokens FROM ledger ORDER BY ts DESC, call DESC LIMIT 20")
def last_n_calls(spark: SparkSession, sf: str) -> DataFrame:
    return op.last_calls(ledger(spark, sf), 20).select("call", "session", "tool", "tokens")


@query(L + "SELECT call, tool FROM (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY ts DESC, call DESC) AS rn FROM ledger) WHERE rn <= 200")
def log_retention(spark: SparkSession, sf: str) -> DataFrame:
    return op.newest_per(ledger(spark, sf), "tool", 200, [F.desc("ts"), F.desc("call")]).select("call", "tool")


@query(L + f"SELECT session, CAST(sum(tokens) AS BIGINT) AS spent, CAST(greatest({CAP} - sum(tokens), 0) AS BIGINT) AS remaining, round(sum(tokens) * 100.0 / {CAP}, 2) AS pct, CASE WHEN sum(tokens) >= {CAP} THEN 'EXCEEDED' WHEN sum(tokens) >= {0.8 * CAP} THEN 'WARNING' ELSE 'OK' END AS status FROM ledger GROUP BY session")
def budget_status(spark: SparkSession, sf: str) -> DataFrame:
    return op.budget(ledger(spark, sf), CAP)


@query(L + "SELECT call, session, CAST(sum(tokens) OVER (PARTITION BY session ORDER BY ts, call ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM ledger")
def budget_running(spark: SparkSession, sf: str) -> DataFrame:
    return op.running_spend(ledger(spark, sf)).select("call", "session", "spent")


@query(L + f"SELECT session, min(spent) AS spent, arg_min(call, spent) AS call FROM (SELECT call, session, CAST(sum(tokens) OVER (PARTITION BY session ORDER BY ts, call ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent, tokens FROM ledger) WHERE spent >= {CAP // 5} AND spent - tokens < {CAP // 5} GROUP BY session")
def budget_first_exceed(spark: SparkSession, sf: str) -> DataFrame:
    r = op.running_spend(ledger(spark, sf)).where((F.col("spent") >= CAP // 5) & (F.col("spent") - F.col("tokens") < CAP // 5))
    return r.groupBy("session").agg(F.min("spent").alias("spent"), F.min_by("call", "spent").alias("call"))


@query(L + "SELECT session AS task, call AS checkpoint, COALESCE(lag(call) OVER (PARTITION BY session ORDER BY ts, call), -1) AS parent FROM ledger")
def checkpoint_chain(spark: SparkSession, sf: str) -> DataFrame:
    return op.checkpoint_chain(ledger(spark, sf)).select(F.col("session").alias("task"), F.col("call").alias("checkpoint"), F.coalesce("parent", F.lit(-1)).alias("parent"))


POINTS = "points AS (SELECT session, min(ts) AS since FROM ledger WHERE tool = (SELECT min(tool) FROM ledger) AND k >= 50 GROUP BY session)"


def _rolled(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger(spark, sf)
    first = rows.agg(F.min("tool").alias("tool"))
    points = rows.join(F.broadcast(first), "tool").where("k >= 50").groupBy("session").agg(F.min("ts").alias("since"))
    return op.rollback(rows, points)


@query(f"WITH {LEDGER_SQL}, {POINTS} SELECT call AS checkpoint, CASE WHEN since IS NOT NULL AND ts >= since THEN 'rolled_back' ELSE 'active' END AS status FROM ledger LEFT JOIN points USING (session)")
def rollback_mark(spark: SparkSession, sf: str) -> DataFrame:
    return _rolled(spark, sf).select(F.col("call").alias("checkpoint"), "status")


@query(f"WITH {LEDGER_SQL}, {POINTS} SELECT session AS task, count(*) AS checkpoints, count(*) FILTER (since IS NULL OR ts < since) AS active, count(*) FILTER (ts >= since) AS rolled_back, CAST(sum(tokens) AS BIGINT) AS tokens FROM ledger LEFT JOIN points USING (session) GROUP BY session")
def task_rollup(spark: SparkSession, sf: str) -> DataFrame:
    gone = F.col("status") == "rolled_back"
    return _rolled(spark, sf).groupBy(F.col("session").alias("task")).agg(F.count("*").alias("checkpoints"), F.count_if(~gone).alias("active"), F.count_if(gone).alias("rolled_back"), F.sum("tokens").alias("tokens"))


@query(L + "SELECT call AS checkpoint, session AS task, tokens FROM ledger WHERE session = 1 ORDER BY ts, call")
def list_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf).where("session = 1").orderBy("ts", "call").select(F.col("call").alias("checkpoint"), F.col("session").alias("task"), "tokens")


#: US dollars for a million tokens, in and out, of each stand-in backend.
PRICES = {"click": (3.0, 15.0), "view": (0.25, 1.25), "purchase": (2.5, 10.0), "scroll": (0.0, 0.0)}
OTHER = (1.0, 3.0)
_price = lambda i: "CASE " + " ".join(f"WHEN tool = '{t}' THEN {p[i]}" for t, p in PRICES.items()) + f" ELSE {OTHER[i]} END"
COSTED = f"WITH {LEDGER_SQL}, costed AS (SELECT *, (tokens * {_price(0)} + COALESCE(k, 0) * {_price(1)}) / 1e6 AS usd, tokens * 3.0 / 1e6 AS naive FROM ledger) "


def _costed(spark: SparkSession, sf: str) -> DataFrame:
    rows = ledger(spark, sf)
    price = lambda i: F.expr(_price(i))
    usd = op.cost(F.col("tokens"), price(0)) + op.cost(F.coalesce("k", F.lit(0)), price(1))
    return rows.withColumns({"usd": usd, "naive": op.cost(F.col("tokens"), F.lit(3.0))})


@query(COSTED + "SELECT count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(usd), 6) AS usd, round(sum(naive), 6) AS naive_usd, round(greatest(sum(naive) - sum(usd), 0), 6) AS saved_usd, round(greatest(sum(naive) - sum(usd), 0) * 100 / sum(naive), 2) AS saved_pct FROM costed")
def cost_report(spark: SparkSession, sf: str) -> DataFrame:
    saved = F.greatest(F.col("n") - F.col("u"), F.lit(0.0))
    total = _costed(spark, sf).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("usd").alias("u"), F.sum("naive").alias("n"))
    return total.select("calls", "tokens", F.round("u", 6).alias("usd"), F.round("n", 6).alias("naive_usd"), F.round(saved, 6).alias("saved_usd"), F.round(F.coalesce(F.try_divide(saved * 100, F.col("n")), F.lit(0.0)), 2).alias("saved_pct"))


@query(COSTED + "SELECT tool AS backend, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(usd), 6) AS usd FROM costed GROUP BY tool")
def backend_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return _costed(spark, sf).groupBy(F.col("tool").alias("backend")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("usd"), 6).alias("usd"))


@query(COSTED + ", q AS (SELECT tool, tokens, k, CASE WHEN tokens > 0 THEN (tokens - k) * 100.0 / tokens ELSE 0.0 END AS pct FROM costed) SELECT tool AS tier, count(*) AS n, round(avg(pct), 4) AS avg_saved_pct, round(count(*) * 100.0 / (SELECT count(*) FROM q), 2) AS share FROM q GROUP BY tool")
def savings_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    q = ledger(spark, sf).withColumn("pct", F.when(F.col("tokens") > 0, (F.col("tokens") - F.col("k")) * 100.0 / F.col("tokens")).otherwise(0.0))
    g = q.groupBy(F.col("tool").alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("pct"), 4).alias("avg_saved_pct"))
    return g.crossJoin(F.broadcast(q.agg(F.count("*").alias("all")))).select("tier", "n", "avg_saved_pct", F.round(F.col("n") * 100.0 / F.col("all"), 2).alias("share"))


@query(L + "SELECT call, round((tokens - k) * 100.0 / tokens, 4) AS saved_pct FROM ledger WHERE tokens > 0 AND tokens > k ORDER BY (tokens - k) * 100.0 / tokens DESC, call LIMIT 8")
def top_savings(spark: SparkSession, sf: str) -> DataFrame:
    pct = (F.col("tokens") - F.col("k")) * 100.0 / F.col("tokens")
    return ledger(spark, sf).where("tokens > 0 and tokens > k").withColumn("p", pct).orderBy(F.desc("p"), "call").limit(8).select("call", F.round("p", 4).alias("saved_pct"))


@query(L + "SELECT round(count(*) FILTER (k < 30) * 100.0 / count(*), 4) AS hit_rate, round(count(*) FILTER (k >= 30 AND k < 50) * 100.0 / count(*) FILTER (k >= 30), 4) AS bypassed FROM ledger")
def roi_rates(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda c: F.count_if(F.expr(c))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0)), 4)
    return ledger(spark, sf).agg(rate(n("k < 30"), F.count("*")).alias("hit_rate"), rate(n("k >= 30 and k < 50"), n("k >= 30")).alias("bypassed"))


@query(L + "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS calls FROM ledger GROUP BY 1")
def ledger_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf).groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:00").alias("hour")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))


@query(L + """SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT date_trunc('hour', ts) AS w, tokens FROM ledger UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, tokens FROM ledger) GROUP BY w""")
def ledger_sliding(spark: SparkSession, sf: str) -> DataFrame:
    w = F.window("ts", "2 hours", "1 hour")
    return ledger(spark, sf).groupBy(w).agg(F.sum("tokens").alias("tokens")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "tokens")


@query(L + """, g AS (SELECT *, CASE WHEN lag(ts) OVER o IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER o) > 30 * 60000000 THEN 1 ELSE 0 END AS new FROM ledger WINDOW o AS (PARTITION BY session ORDER BY ts, call)),
p AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session ORDER BY ts, call ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM g) SELECT session, part, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM p GROUP BY session, part""")
def ledger_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return op.sessions(ledger(spark, sf), 30)


@query(L.replace("WITH ", "WITH RECURSIVE ") + """, r AS (SELECT session, call, epoch_us(ts) AS t, row_number() OVER (PARTITION BY session ORDER BY ts, call) AS i FROM ledger),
n AS (SELECT a.session, a.i, min(b.i) AS j FROM r a JOIN r b ON a.session = b.session AND b.i > a.i AND b.t - a.t >= 3600000000 GROUP BY 1, 2),
k AS (SELECT session, CAST(1 AS BIGINT) AS i FROM r WHERE i = 1 UNION ALL SELECT k.session, n.j FROM k JOIN n ON n.session = k.session AND n.i = k.i) SELECT session, call FROM k JOIN r USING (session, i)""")
def debounce(spark: SparkSession, sf: str) -> DataFrame:
    return op.debounce(ledger(spark, sf), "session", 3600.0)


@query(L + "SELECT session, count(*) - count(DISTINCT tool) AS duplicate_calls, round((count(*) - count(DISTINCT tool)) * 100.0 / count(*), 4) AS hit_rate FROM ledger GROUP BY session")
def dup_calls(spark: SparkSession, sf: str) -> DataFrame:
    dup = F.count("*") - F.countDistinct("tool")
    return ledger(spark, sf).groupBy("session").agg(dup.alias("duplicate_calls"), F.round(dup * 100.0 / F.count("*"), 4).alias("hit_rate"))


@query(L + "SELECT count(*) AS entries, CAST(sum(n - 1) AS BIGINT) AS hits FROM (SELECT session, tool, k, count(*) AS n FROM ledger GROUP BY session, tool, k)")
def cache_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf).groupBy("session", "tool", "k").agg(F.count("*").alias("n")).agg(F.count("*").alias("entries"), F.sum(F.col("n") - 1).alias("hits"))


@query(L + "SELECT call, session, tool, CAST(row_number() OVER (PARTITION BY session, tool ORDER BY ts, call) AS INTEGER) AS seen FROM ledger")
def first_seen_refs(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf).select("call", "session", "tool", F.row_number().over(W.partitionBy("session", "tool").orderBy("ts", "call")).alias("seen"))


@query(L + "SELECT session, tool, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used FROM ledger GROUP BY session, tool QUALIFY row_number() OVER (ORDER BY max(ts) DESC, session, tool) <= 500")
def lru_keep(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf).groupBy("session", "tool").agg(F.max("ts").alias("last_used")).orderBy(F.desc("last_used"), "session", "tool").limit(500).select("session", "tool", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss").alias("last_used"))


@query("SELECT source AS file, count(*) AS runs, round(avg(quality * 4 + toxic), 4) AS avg_score FROM labels JOIN documents USING (doc_id) GROUP BY source")
def reputation(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return d.groupBy(F.col("source").alias("file")).agg(F.count("*").alias("runs"), F.round(F.avg(F.col("quality") * 4 + F.col("toxic")), 4).alias("avg_score"))


@query("SELECT lang AS dir, count(*) AS low_files FROM (SELECT lang, source, count(*) AS runs, avg(quality * 4 + toxic) AS s FROM labels JOIN documents USING (doc_id) GROUP BY lang, source) WHERE runs >= 2 AND s <= 3.6 GROUP BY lang HAVING count(*) >= 3")
def reputation_low_dirs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    files = d.groupBy("lang", "source").agg(F.count("*").alias("runs"), F.avg(F.col("quality") * 4 + F.col("toxic")).alias("s")).where("runs >= 2 and s <= 3.6")
    return files.groupBy(F.col("lang").alias("dir")).agg(F.count("*").alias("low_files")).where("low_files >= 3")
