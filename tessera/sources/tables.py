"""Relational sources: the star-schema tables, and what is projected from them (graph, commit log, ledgers)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keep import spread

NODE_COLUMNS = ("id", "label", "type", "file", "lang", "summary", "community")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, type, file, lang, summary, community. Dimension joins are on the 25 nations, which is a fixed size."""
    t = lambda name: table(spark, sf_dir, name)
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("string")

    def of(df: DataFrame, kind: str, key: str, label: str, type_: str, file, lang, summary, community) -> DataFrame:
        return df.select(_id(kind, key).alias("id"), F.col(label).alias("label"), F.lit(type_).alias("type"), text(file).alias("file"), text(lang).alias("lang"), text(summary).alias("summary"), community.cast("int").alias("community"))

    region, nation = t("region"), t("nation")
    n = F.broadcast(nation)
    parts = [
        of(region, "region", "r_regionkey", "r_name", "module", "geo/region", "geo", F.concat(F.lit("Region "), "r_name"), F.col("r_regionkey")),
        of(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey), "nation", "n_nationkey", "n_name", "class", F.concat(F.lit("geo/"), "r_name"), "geo", F.concat(F.lit("Nation in "), "r_name"), F.col("n_regionkey")),
        of(t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")), "customer", "c_custkey", "c_name", "function", F.concat(F.lit("crm/"), "n_name"), "crm", F.concat(F.lit("Customer in segment "), "c_mktsegment"), F.col("n_regionkey")),
        of(t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")), "supplier", "s_suppkey", "s_name", "interface", F.concat(F.lit("scm/"), "n_name"), "scm", F.concat(F.lit("Supplier from "), "n_name"), F.col("n_regionkey")),
        of(t("part"), "part", "p_partkey", "p_name", "external", none, none, F.col("p_type"), F.lit(None)),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """src, dst, relation (src depends on dst). sparse: only calls of urgent orders and imports of large quantities."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, b, relation: df.select(a.alias("src"), b.alias("dst"), F.lit(relation).alias("relation"))
    orders, lines = t("orders"), t("lineitem")
    urgent = orders.where("o_orderpriority = '1-URGENT'") if sparse else orders
    large = lines.where("l_quantity >= 49") if sparse else lines
    ordered = lines.select("l_orderkey", "l_suppkey").join(urgent.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = [
        edge(large.select("l_suppkey", "l_partkey").distinct(), _id("supplier", "l_suppkey"), _id("part", "l_partkey"), "imports"),
        edge(ordered.select("o_custkey", "l_suppkey").distinct(), _id("customer", "o_custkey"), _id("supplier", "l_suppkey"), "calls"),
    ]
    if not sparse:
        parts += [
            edge(t("nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "defines"),
            edge(t("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "extends"),
            edge(t("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "extends"),
        ]
    return reduce(DataFrame.unionByName, parts)


def commits(spark: SparkSession, sf_dir: str, most_files: int | None = None) -> DataFrame:
    """commit, author, date, subject, file: the orders as a commit log, their distinct parts as the files touched. Lines are dealt by their order once."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    log = line.select("l_orderkey", "l_partkey").repartition(spread(spark, line.count()), "l_orderkey").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    log = log.select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("subject"), F.col("l_partkey").alias("file"))
    if most_files is None:
        return log
    files = F.slice(F.array_sort(F.collect_set("file")), 1, most_files)
    return log.groupBy("commit", "author", "date", "subject").agg(files.alias("files")).select("commit", "author", "date", "subject", F.explode("files").alias("file"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call, session, tool, ts, tokens, k: the events as a tool-call ledger."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("call"),
        F.col("user_id").alias("session"),
        F.col("event_type").alias("tool"),
        "ts",
        F.floor(F.abs("value")).cast("long").alias("tokens"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


# The same projections for the oracle.
NODES_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS label, 'module' AS type, 'geo/region' AS file, 'geo' AS lang, 'Region ' || r_name AS summary, r_regionkey AS community FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'class', 'geo/' || r_name, 'geo', 'Nation in ' || r_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'function', 'crm/' || n_name, 'crm', 'Customer in segment ' || c_mktsegment, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'interface', 'scm/' || n_name, 'scm', 'Supplier from ' || n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'external', NULL, NULL, p_type, NULL FROM part)"""
EDGES_SQL = """edges AS (
  SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, 'imports' AS relation FROM lineitem
  UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'supplier:' || l_suppkey, 'calls' FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'defines' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'extends' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'extends' FROM supplier)"""
SPARSE_SQL = """sparse AS (
  SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, 'imports' AS relation FROM lineitem WHERE l_quantity >= 49
  UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'supplier:' || l_suppkey, 'calls' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT')"""
DEGREES_SQL = """degrees AS (
  SELECT id, label, type, file, community, COALESCE(i.n, 0) AS in_degree, COALESCE(o.n, 0) AS out_degree, COALESCE(i.n, 0) + COALESCE(o.n, 0) AS total
  FROM nodes LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = id LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = id)"""
GRAPH_SQL = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, {DEGREES_SQL} "
COMMITS_SQL = """commits AS (
  SELECT DISTINCT o_orderkey AS commit_id, o_custkey AS author, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS subject, l_partkey AS file FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
LEDGER_SQL = """ledger AS (
  SELECT event_id AS call, user_id AS session, event_type AS tool, ts, CAST(floor(abs(value)) AS BIGINT) AS tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
