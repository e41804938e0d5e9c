"""How much of a file is worth extracting: name, use, depth, size and change frequency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import base_name, stem

# File stems that promise much, and little.
IMPORTANT = (
    "auth", "authentication", "authorization", "core", "base", "main", "app", "index", "router", "routes", "api", "model", "models", "schema", "schemas", "service",
    "services", "manager", "handler", "handlers", "middleware", "utils", "helpers", "common", "config", "settings", "constants", "db", "database", "repository",
    "repo", "pipeline", "processor", "worker", "security", "crypto", "hash", "payment", "billing", "checkout", "user", "users", "account", "session",
)
LOW_VALUE = (
    "test", "tests", "spec", "specs", "fixture", "fixtures", "mock", "mocks", "stub", "stubs", "fake", "migration", "migrations", "seed", "seeds", "generated", "gen",
    "auto", "vendor", "third_party", "example", "examples", "sample", "demo", "backup", "tmp", "temp",
)
DEPTHS = ((0.70, "full"), (0.40, "standard"), (0.15, "minimal"))


def by_name(path: Column) -> Column:
    low = F.lower(stem(path))
    part = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in IMPORTANT])
    return F.when(low.isin(*IMPORTANT), 0.25).when(low.isin(*LOW_VALUE), -0.20).when(part, 0.10).otherwise(0.0)


def scores(files: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, commits: DataFrame | None = None) -> DataFrame:
    """path, score (0 to 1) of files (path, length). nodes (id, file; the last by id stands for a file) and edges give the use of a file,
    commits (file, n) how often its name changes."""
    df = files.select("path", "length")
    if nodes is not None and edges is not None:
        node = nodes.where("file is not null").groupBy(F.col("file").alias("path")).agg(F.max("id").alias("dst"))
        uses = edges.join(node, "dst").groupBy("path").agg(F.count("*").alias("uses"))
        df = df.join(uses, "path", "left")
    else:
        df = df.withColumn("uses", F.lit(0))
    if commits is not None:
        df = df.withColumn("base", base_name(F.col("path"))).join(commits.groupBy(base_name(F.col("file")).alias("base")).agg(F.sum("n").alias("changes")), "base", "left")
    else:
        df = df.withColumn("changes", F.lit(0))
    n = F.col("length")
    size = F.when(n.between(2000, 50_000), 0.10).when(n < 200, -0.05).otherwise(0.0)
    depth = F.greatest(F.lit(0.0), F.lit(0.15) - F.lit(0.015) * F.size(F.split(F.regexp_replace("path", "^/", ""), "/")))
    score = by_name(F.col("path")) + F.least(F.coalesce("uses", F.lit(0)) / 20.0, F.lit(0.35)) + depth + size + F.least(F.coalesce("changes", F.lit(0)) / 40.0, F.lit(0.15))
    return df.select("path", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("score"))


def depth(score: Column) -> Column:
    """What to extract: full, standard, minimal, name_only."""
    return reduce(lambda c, x: c.when(score >= x[0], x[1]), DEPTHS, F).otherwise("name_only")
