"""Accounting, stores and derived graph parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import graph, ledger
from ..registry import query
from ..sources import sinks
from ..sources.tables import EDGES_SQL, GRAPH_SQL, LEDGER_SQL, NODES_SQL, SPARSE_SQL, edges, nodes, table
from ..sources.tables import ledger as ledger_of

L = f"WITH {LEDGER_SQL} "


@query("SELECT lang AS category, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn <= 8")
def context_recall(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.newest_per(table(spark, sf, "documents").select(F.col("lang").alias("category"), "doc_id"), "category", 8, [F.desc("doc_id")])


#: US dollars a million tokens: cache write, cache read, input, output.
WRITE, READ, INPUT, OUTPUT = 3.75, 0.30, 3.00, 15.00


@query(L + f"SELECT round(sum(tokens) FILTER (k < 10) * {WRITE} / 1e6 + sum(tokens) FILTER (k >= 10) * {READ} / 1e6 + sum(k) * {OUTPUT} / 1e6, 6) AS usd, round(sum(tokens) * {INPUT} / 1e6 + sum(k) * {OUTPUT} / 1e6, 6) AS without_cache FROM ledger")
def prompt_cache_accounting(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda c: F.sum(F.when(F.expr(c), F.col("tokens")))
    out = F.sum("k") * OUTPUT / 1e6
    return ledger_of(spark, sf).agg(F.round(some("k < 10") * WRITE / 1e6 + some("k >= 10") * READ / 1e6 + out, 6).alias("usd"), F.round(F.sum("tokens") * INPUT / 1e6 + out, 6).alias("without_cache"))


@query("""WITH q AS (SELECT length(text) // 4 AS used, 2000 AS raw FROM conversations WHERE role = 'assistant') SELECT count(*) AS answered, round(avg(used), 4) AS avg_used, round(avg((raw - used) * 100.0 / raw), 4) AS avg_saved_pct, count(*) FILTER (used > raw) AS worse FROM q""")
def benchmark_rollup(spark: SparkSession, sf: str) -> DataFrame:
    used = F.floor(F.length("text") / 4)
    return table(spark, sf, "conversations").where("role = 'assistant'").select(used.alias("u")).agg(F.count("*").alias("answered"), F.round(F.avg("u"), 4).alias("avg_used"), F.round(F.avg((2000 - F.col("u")) * 100.0 / 2000), 4).alias("avg_saved_pct"), F.count_if(F.col("u") > 2000).alias("worse"))


@query(GRAPH_SQL + """, top AS (SELECT community, id FROM (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY total DESC, id) AS rn FROM degrees WHERE community IS NOT NULL) WHERE rn <= 5)
SELECT 'community:' || community AS src, id AS dst, 'contains' AS relation FROM top""")
def community_edges(spark: SparkSession, sf: str) -> DataFrame:
    top = graph.top_members(nodes(spark, sf), edges(spark, sf), 5)
    return top.select(F.concat(F.lit("community:"), F.col("community").cast("string")).alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("relation"))


@query(f"WITH {EDGES_SQL}, {SPARSE_SQL} SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM edges INTERSECT SELECT * FROM sparse) UNION ALL SELECT 'full_only', count(*) FROM (SELECT * FROM edges EXCEPT SELECT * FROM sparse)")
def edge_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    a, b = edges(spark, sf), edges(spark, sf, sparse=True)
    part = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return part(a.intersect(b), "both").unionByName(part(a.subtract(b), "full_only"))


@query(f"WITH {NODES_SQL} SELECT id, CAST(i % 10 * 300 AS BIGINT) AS x, CAST(i // 10 * 300 AS BIGINT) AS y, '**' || label || '** (' || type || ')' || chr(10) || chr(10) || COALESCE(summary, '') AS text FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i FROM nodes)")
def canvas_layout(spark: SparkSession, sf: str) -> DataFrame:
    card = F.from_json("line", "id string, x long, y long, text string")
    return sinks.canvas(nodes(spark, sf), edges(spark, sf).where("relation = 'defines'")).where("part = 0").select(card.alias("c")).select("c.*")


@query(f"WITH {SPARSE_SQL} SELECT src AS from_node, dst AS to_node, min(relation) AS label, src || '-' || dst AS id FROM sparse GROUP BY src, dst")
def canvas_arrows(spark: SparkSession, sf: str) -> DataFrame:
    arrow = F.from_json("line", "fromNode string, toNode string, label string, id string")
    return sinks.canvas(nodes(spark, sf), edges(spark, sf, sparse=True)).where("part = 1").select(arrow.alias("c")).select(F.col("c.fromNode").alias("from_node"), F.col("c.toNode").alias("to_node"), "c.label", "c.id")


_Q = lambda c: f"replace(COALESCE({c}, ''), '''', chr(92) || '''')"


@query(f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT 'MERGE (n:' || type || ' {{id: ''' || id || ''', label: ''' || {_Q('label')} || ''', summary: ''' || {_Q('summary')} || ''', file: ''' || {_Q('file')} || '''}});' AS line FROM nodes
UNION ALL SELECT 'MATCH (a {{id: ''' || src || '''}}), (b {{id: ''' || dst || '''}}) MERGE (a)-[:' || upper(relation) || ']->(b);' FROM edges""")
def cypher_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.cypher(nodes(spark, sf), edges(spark, sf)).select("line")


@query(f"""WITH {NODES_SQL}, {SPARSE_SQL} SELECT '<node id="' || id || '"><data key="label">' || label || '</data>' || CASE WHEN file IS NULL THEN '' ELSE '<data key="file">' || file || '</data>' END || '</node>' AS line FROM nodes
UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"><data key="relation">' || min(relation) || '</data></edge>' FROM sparse GROUP BY src, dst""")
def graphml_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.graphml(nodes(spark, sf).select("id", "label", "file"), edges(spark, sf, sparse=True)).where("part in (1, 2)").select("line")


@query(L + "SELECT call, round(tokens * 1.0 / max(tokens) OVER (PARTITION BY session), 6) AS share, CAST(rank() OVER (PARTITION BY session ORDER BY tokens DESC) AS INTEGER) AS place FROM ledger")
def call_ranks(spark: SparkSession, sf: str) -> DataFrame:
    by = W.partitionBy("session")
    return ledger_of(spark, sf).select("call", F.round(F.try_divide(F.col("tokens") * 1.0, F.max("tokens").over(by)), 6).alias("share"), F.rank().over(by.orderBy(F.desc("tokens"))).alias("place"))
