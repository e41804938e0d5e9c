"""Builds that follow changes: incremental and progressive graphs of the sample files."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import increment
from ..operators.keep import keep, shared_dir
from ..registry import query
from ..sources.samples import files, path_sql
from ..sources.store import Store
from ..streaming import progressive

PY = path_sql("python")
K, N = "CAST(s_suppkey AS STRING)", "CAST(s_nationkey AS STRING)"


def _key() -> Column:
    return F.regexp_extract("path", r"_(\d+)\.py$", 1).cast("long")


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/build-{uuid.uuid4().hex}")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    d = files(spark, sf, "python")
    return keep(d.select("path", F.length("content").cast("long").alias("length"), F.timestamp_seconds(F.lit(0)).alias("modified"), "content"))


def _changed(d: DataFrame) -> DataFrame:
    """Every third file with another class in it, but for those that go."""
    return d.where((_key() % 3 == 0) & (_key() % 5 != 0)).withColumn("content", F.replace("content", F.lit("class Supplier"), F.lit("class Vendor")))


LIVE = f"live AS (SELECT {PY} AS path, {K} AS k, {N} AS n, CASE WHEN s_suppkey % 3 = 0 THEN 'Vendor' ELSE 'Supplier' END || {K} AS c FROM supplier WHERE s_suppkey % 5 <> 0)"


@query(f"""WITH {LIVE} SELECT path AS id, 'supplier_' || k AS label, 'module' AS type, 'python module: supplier_' || k AS summary FROM live UNION ALL SELECT path || '::' || c, c, 'class', 'python class in supplier_' || k FROM live
UNION ALL SELECT path || '::call_' || k, 'call_' || k, 'function', 'python function in supplier_' || k || ' | sig: (amount: int, rate: float) -> str' FROM live
UNION ALL SELECT DISTINCT 'pkg:' || p, p, 'external', 'External package: ' || p FROM (SELECT unnest(['os', 'nation_' || n]) AS p FROM live)
UNION ALL SELECT DISTINCT e, e, 'external', NULL FROM (SELECT unnest(['Nation', 'scm/n' || n || '/..shared']) AS e FROM live)""")
def incremental_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The graph after all files came, some changed and some went, each change merged into what was there."""
    s, d = _store(spark), _sources(spark, sf)
    increment.apply(s, d, d.select("path").limit(0))
    increment.apply(s, _changed(d), d.where(_key() % 5 == 0).select("path"))
    return increment.settle(s)[0].select("id", "label", "type", "summary")


@query(f"""WITH {LIVE} SELECT path AS src, path || '::' || unnest([c, 'call_' || k]) AS dst, 'defines' AS relation FROM live UNION ALL SELECT path || '::' || c, 'Nation', 'extends' FROM live
UNION ALL SELECT path, unnest(['pkg:os', 'pkg:nation_' || n, 'scm/n' || n || '/..shared']), 'imports' FROM live""")
def incremental_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The same changes in another order: half of the files after the first ones changed."""
    s, d = _store(spark), _sources(spark, sf)
    none = d.select("path").limit(0)
    increment.apply(s, d.where(_key() % 2 == 0), none)
    increment.apply(s, _changed(d).unionByName(d.where((_key() % 3 != 0) & (_key() % 2 == 1))), d.where(_key() % 5 == 0).select("path"))
    increment.apply(s, d.limit(0), d.where(_key() % 5 == 0).select("path"))
    return increment.settle(s)[1].select("src", "dst", "relation")


@query("SELECT 1 AS step, count(*) AS parsed FROM supplier UNION ALL SELECT 2, count(*) FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 UNION ALL SELECT 3, 0")
def incremental_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """How many files are parsed when all are new, some change, and these change back to what was parsed before."""
    s = _store(spark)
    d = _sources(spark, sf).withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
    changed = _changed(d).withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
    back = d.join(changed.select("path"), "path", "left_semi")
    return spark.createDataFrame([(i + 1, increment.parse_into(s, x)) for i, x in enumerate((d, changed, back))], "step int, parsed long")


def _cumulative(k: int) -> str:
    own = f"FROM supplier WHERE s_suppkey % 2 <= {k}"
    return f"SELECT {k} AS batch, type, count(*) AS n, true AS is_partial FROM (SELECT unnest(['module', 'class', 'function']) AS type {own} UNION ALL SELECT 'external' FROM (SELECT DISTINCT unnest(['os', 'Nation', 'p' || {N}, 's' || {N}]) {own})) GROUP BY type"


@query(" UNION ALL ".join(map(_cumulative, range(2))))
def progressive_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The partial graph as it reads after each of two micro-batches of files."""
    s, d = _store(spark), _sources(spark, sf)
    merge, seen = progressive.merge_batch(s), []
    for k in range(2):
        merge(d.where(_key() % 2 == k), k)
        g = progressive.read(s)
        seen.append(keep(g.nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(k).alias("batch"), "type", "n", F.lit(g.is_partial).alias("is_partial"))))
    return reduce(DataFrame.unionByName, seen)
