"""Commit-history mining over the orders as a commit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import git
from ..registry import query
from ..sources.tables import COMMITS_SQL, commits, table

C = f"WITH {COMMITS_SQL} "
#: Files of one commit that coupling_edges pairs.
MOST_FILES = 15


@query(C + "SELECT file, count(*) AS n, CAST(max(date) AS VARCHAR) AS last_seen, CAST(min(date) AS VARCHAR) AS first_seen FROM commits GROUP BY file")
def commit_file_freq(spark: SparkSession, sf: str) -> DataFrame:
    return commits(spark, sf).groupBy("file").agg(F.count("*").alias("n"), F.max("date").cast("string").alias("last_seen"), F.min("date").cast("string").alias("first_seen"))


@query(C + "SELECT file, count(DISTINCT author) AS authors FROM commits GROUP BY file")
def author_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return commits(spark, sf).groupBy("file").agg(F.countDistinct("author").alias("authors"))


@query(C + "SELECT DISTINCT file FROM commits WHERE subject = '1-URGENT'")
def bug_fix_files(spark: SparkSession, sf: str) -> DataFrame:
    return commits(spark, sf).where("subject = '1-URGENT'").select("file").distinct()


@query(C + "SELECT DISTINCT file FROM commits WHERE date >= (SELECT max(date) FROM commits) - 30")
def recent_files(spark: SparkSession, sf: str) -> DataFrame:
    c = commits(spark, sf)
    return c.crossJoin(F.broadcast(c.agg(F.max("date").alias("as_of")))).where("date >= date_sub(as_of, 30)").select("file").distinct()


PAIRED = f"""WITH {COMMITS_SQL}, capped AS (SELECT commit_id, file FROM (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY file) AS rn FROM commits) WHERE rn <= {MOST_FILES}),
pairs AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS n FROM capped a JOIN capped b ON a.commit_id = b.commit_id AND a.file < b.file GROUP BY 1, 2 HAVING count(*) >= 2) """


@query(f"""WITH {COMMITS_SQL} SELECT a.file AS file_a, b.file AS file_b, count(*) AS n FROM commits a JOIN commits b ON a.commit_id = b.commit_id AND a.file < b.file GROUP BY 1, 2 HAVING count(*) >= 2""")
def co_change_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of files of one commit, however many files it has."""
    return git.co_changes(commits(spark, sf), table(spark, sf, "lineitem").count()).where("n >= 2")


@query(PAIRED + "SELECT 'part:' || file_a AS src, 'part:' || file_b AS dst, 'co_changes_with' AS relation, n AS weight FROM pairs WHERE n >= 3")
def coupling_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the first MOST_FILES files of each commit, as its SQL has them."""
    part = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string"))
    pairs = git.co_changes(commits(spark, sf), table(spark, sf, "lineitem").count(), MOST_FILES).where("n >= 3")
    return pairs.select(part("file_a").alias("src"), part("file_b").alias("dst"), F.lit("co_changes_with").alias("relation"), F.col("n").alias("weight"))


RISK = C + """, f AS (SELECT file, count(*) AS n, max(CASE WHEN subject = '1-URGENT' THEN 1 ELSE 0 END) AS bug, max(date) AS last FROM commits GROUP BY file),
r AS (SELECT file, round(least(1.0, least(n / 50.0, 0.5) + CASE WHEN bug = 1 THEN 0.3 ELSE 0.0 END + CASE WHEN last >= (SELECT max(date) FROM commits) - 30 THEN 0.1 ELSE 0.0 END), 3) AS risk FROM f) """


def _risk(spark: SparkSession, sf: str) -> DataFrame:
    c = commits(spark, sf)
    f = c.groupBy("file").agg(F.count("*").alias("n"), F.max((F.col("subject") == "1-URGENT").cast("int")).alias("bug"), F.max("date").alias("last"))
    f = f.crossJoin(F.broadcast(c.agg(F.max("date").alias("as_of"))))
    risk = F.least(F.col("n") / 50.0, F.lit(0.5)) + F.when(F.col("bug") == 1, 0.3).otherwise(0.0) + F.when(F.expr("last >= date_sub(as_of, 30)"), 0.1).otherwise(0.0)
    return f.select("file", F.round(F.least(F.lit(1.0), risk), 3).alias("risk"))


@query(RISK + "SELECT file, CAST(risk AS DOUBLE) AS risk FROM r")
def git_risk(spark: SparkSession, sf: str) -> DataFrame:
    return _risk(spark, sf)


@query(RISK + "SELECT file, CAST(risk AS DOUBLE) AS risk FROM r WHERE risk > 0 ORDER BY risk DESC, file LIMIT 20")
def highest_risk_files(spark: SparkSession, sf: str) -> DataFrame:
    return _risk(spark, sf).where("risk > 0").orderBy(F.desc("risk"), "file").limit(20)
