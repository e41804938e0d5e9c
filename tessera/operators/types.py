"""Type signatures of functions: from Python sources, TypeScript declarations or sources, and their way into node summaries."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _signatures(content: str | None) -> Iterator[tuple[str, str]]:
    """(name, signature) of each function that has parameters or a return type."""
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError):
        return
    for f in ast.walk(tree):
        if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
            named = [a.arg if a.annotation is None else f"{a.arg}: {ast.unparse(a.annotation)}" for a in f.args.args]
            gives = "" if f.returns is None else f" -> {ast.unparse(f.returns)}"
            if named or gives:
                yield f.name, f"({', '.join(named)}){gives}"


def _python(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(f"{path}::{name}", s) for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for name, s in dict(_signatures(content)).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["key", "signature"])


def python_types(files: DataFrame) -> DataFrame:
    """key (path::name), signature of the Python files (path, content); the last definition of a name in a file stands. Python's own
    parser says what no pattern can, so this is a map in Arrow batches. Of repeated paths: the greatest signature."""
    found = files.where("path like '%.py'").select("path", "content").mapInArrow(_python, "key string, signature string")
    return found.groupBy("key").agg(F.max("signature").alias("signature"))


# Declarations of functions and methods with a return type.
DECLARED = r"export\s+(?:declare\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*(\([^)]*\))\s*:\s*([^;{]+)"
METHOD = r"(?:readonly\s+)?(\w+)\s*(\([^)]*\))\s*:\s*([^;}\n]+)"
PLAIN = r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*(\([^)]{0,200}\))\s*:\s*(?:Promise<)?([A-Za-z\[\]|<>, ]+?)(?:>)?\s*[{;]"


def _found(files: DataFrame, pattern: str, rank: int) -> DataFrame:
    get = lambda g: F.regexp_extract_all(F.col("content"), F.lit(pattern), F.lit(g))
    z = files.select("path", F.explode(F.arrays_zip(get(1).alias("n"), get(2).alias("p"), get(3).alias("r"))).alias("z"))
    return z.select("path", F.col("z.n").alias("name"), F.col("z.p").alias("params"), F.trim(F.regexp_replace("z.r", r"\s+$", "")).alias("gives"), F.lit(rank).alias("rank"))


IS_DECLARATION = "path like '%.d.ts'"


def _typescript(files: DataFrame) -> DataFrame:
    """path, key, signature, kind (declared, plain) of each file by itself."""
    declared, sources = files.where(IS_DECLARATION), files.where(f"path like '%.ts' and not ({IS_DECLARATION})")
    own = _found(declared, DECLARED, 0).unionByName(_found(declared, METHOD, 1).where("name <> 'constructor' and length(gives) < 80"))
    every = own.unionByName(_found(sources, PLAIN, 2).where("length(gives) < 60"))
    every = every.select("path", F.concat_ws("::", "path", "name").alias("key"), F.concat("params", F.lit(": "), "gives").alias("signature"), "rank")
    best = every.groupBy("path", "key").agg(F.min_by("signature", F.struct("rank", "signature")).alias("signature"), F.min("rank").alias("rank"))
    return best.select("path", "key", "signature", F.when(F.col("rank") < 2, "declared").otherwise("plain").alias("kind"))


def harvest(files: DataFrame) -> DataFrame:
    """origin, key, signature, kind of the types that each file (path, content) names; `settled` says which of them count."""
    python = python_types(files).select(F.substring_index("key", "::", 1).alias("path"), "key", "signature", F.lit("python").alias("kind"))
    return python.unionByName(_typescript(files)).withColumnRenamed("path", "origin")


def settled(harvested: DataFrame, paths: DataFrame) -> DataFrame:
    """key, signature: TypeScript's from declaration files if any of the paths (path) is one, else from sources."""
    any_ = paths.agg(F.coalesce(F.bool_or(F.expr(IS_DECLARATION)), F.lit(False)).alias("has"))  # one row
    return harvested.crossJoin(F.broadcast(any_)).where("not (kind = 'plain' and has)").groupBy("key").agg(F.min("signature").alias("signature"))


def typescript_types(files: DataFrame) -> DataFrame:
    """key, signature: from declaration files if there are any, else from sources."""
    return settled(_typescript(files), files)


def enrich(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """nodes with type_signature: that of the node's id, else of the first key that ends with its label; the summary mentions it."""
    by_label = types.groupBy(F.element_at(F.split("key", "::"), -1).alias("label")).agg(F.min_by("signature", "key").alias("near"))
    exact = types.select(F.col("key").alias("id"), F.col("signature").alias("own"))
    out = nodes.join(exact, "id", "left").join(by_label, "label", "left").withColumn("type_signature", F.coalesce("own", "near"))
    told = F.coalesce(F.contains(F.coalesce("summary", F.lit("")), F.col("type_signature")), F.lit(True))
    summary = F.when(told, F.col("summary")).otherwise(F.concat(F.coalesce("summary", F.lit("")), F.lit(" | sig: "), F.substring("type_signature", 1, 80)))
    return out.withColumn("summary", summary).select(*nodes.columns, "type_signature")
