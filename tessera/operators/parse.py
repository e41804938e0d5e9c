"""Docstrings of source files (path, content) and marks of generated files, by regular expressions of the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pattern (symbol and text groups) of a documented definition, by language.
DOCSTRINGS: dict[str, tuple[str, int, int]] = {
    "python": (r'(?m)^\s*(?:async\s+)?(?:def|class)\s+(\w+)[^\n]*:\s*\n\s*"""((?s:.*?))"""', 1, 2),
    "javascript": (r"/\*\*((?s:(?!\*/).)*)\*/\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const|interface|type)\s+(\w+)", 2, 1),
    "go": (r"((?:(?m:^)//[^\n]*\n)+)func\s+(?:\([^)]*\)\s+)?(\w+)", 2, 1),
    "rust": (r"((?:(?m:^)\s*///[^\n]*\n)+)\s*(?:pub\s+)?(?:async\s+)?(?:fn|struct|enum|trait)\s+(\w+)", 2, 1),
    "java": (r"/\*\*((?s:(?!\*/).)*)\*/\s*(?:public|private|protected|static|final|abstract|open|data|\s)*(?:class|interface|fun|[\w<>\[\]]+)\s+(\w+)", 2, 1),
    "swift": (r"((?:(?m:^)\s*///[^\n]*\n)+)\s*(?:public\s+|open\s+)?(?:func|class|struct|enum|protocol)\s+(\w+)", 2, 1),
    "c": (r"/\*\*?((?s:(?!\*/).)*)\*/\s*[\w\s*]+?(\w+)\s*\(", 2, 1),
    "php": (r"/\*\*((?s:(?!\*/).)*)\*/\s*(?:public|private|protected|static|\s)*(?:function|class)\s+(\w+)", 2, 1),
}
SAME_AS = {"typescript": "javascript", "kotlin": "java", "csharp": "java", "cpp": "c"}


def docstrings(files: DataFrame, lang: Column) -> DataFrame:
    """path, name, doc: the first sentence (at most 150 characters) of each documented symbol."""
    df = files.withColumn("lang", lang)
    for a, b in SAME_AS.items():
        df = df.withColumn("lang", F.when(F.col("lang") == a, b).otherwise(F.col("lang")))

    def of(name: str, text: str) -> Column:
        clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*(?:\*|///?|#)+ ?", ""), r"\s+", " "))
        sentence = F.regexp_extract(clean, r"^([^.!?]{5,150}[.!?])", 1)
        return F.when(sentence != "", sentence).otherwise(F.substring(clean, 1, 150))

    def found(pattern: str, name: int, text: int) -> Column:
        get = lambda g: F.regexp_extract_all(F.col("content"), F.lit(pattern), F.lit(g))
        return F.arrays_zip(get(name).alias("name"), get(text).alias("text"))

    pairs = reduce(lambda c, kv: c.when(F.col("lang") == kv[0], found(*kv[1])), DOCSTRINGS.items(), F)
    own = df.where(F.col("lang").isin(*DOCSTRINGS)).select("path", F.explode(pairs).alias("z"))
    return own.select("path", F.col("z.name").alias("name"), of("z.name", F.col("z.text")).alias("doc")).where("doc <> ''")


def enrich(nodes: DataFrame, docs: DataFrame, short: int = 20) -> DataFrame:
    """Nodes whose summary is missing or short take the docstring of their file and label."""
    one = docs.groupBy(F.col("path").alias("file"), F.col("name").alias("label")).agg(F.min("doc").alias("doc"))
    weak = F.length(F.coalesce("summary", F.lit(""))) < short
    return nodes.join(one, ["file", "label"], "left").withColumn("summary", F.when(weak & F.col("doc").isNotNull(), F.col("doc")).otherwise(F.col("summary"))).select(*nodes.columns)


# Marks of generated files: names, patterns of name or path, and what stands in the first 500 bytes.
GENERATED_NAMES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Pipfile.lock", "composer.lock", "Gemfile.lock", "bun.lockb", ".DS_Store",
    "Thumbs.db", "desktop.ini", "MANIFEST.in",
)
GENERATED_PATHS = (
    r"(?i)\.min\.(js|css)$", r"(?i)\.bundle\.(js|css)$", r"(?i)[-.]generated\.\w+$", r"\.pb\.go$", r"_pb2(_grpc)?\.py$", r"\.g\.dart$", r"\.freezed\.dart$",
    r"\.gr\.dart$", r"__generated__", r"\.snap$", r"(?i)schema\.generated\.\w+$", r"(?i)migrations?/\d{4}", r"\.d\.ts$", r"(?i)stubs?/.*\.py$",
)
GENERATED_MARKS = (
    "// Code generated by", "// DO NOT EDIT", "// This file was generated", "// Auto-generated", "// Generated by", "/* eslint-disable */",
    "# This file is auto-generated", "# DO NOT EDIT", "# Generated by", "// GENERATED CODE - DO NOT MODIFY BY HAND", "THIS FILE IS GENERATED", "@generated",
    "// autogenerated", "# autogenerated", "AUTOGENERATED FILE",
)


def is_generated(path: Column, content: Column) -> Column:
    """By exact name, by a pattern of the lower-case name or the path, or by a mark at the top, in any case."""
    name, head = F.element_at(F.split(path, "/"), -1), F.upper(F.substring(content, 1, 500))
    by_path = reduce(lambda a, b: a | b, [F.lower(name).rlike(p) | path.rlike(p) for p in GENERATED_PATHS])
    return name.isin(*GENERATED_NAMES) | by_path | reduce(lambda a, b: a | b, [head.contains(m.upper()) for m in GENERATED_MARKS])
