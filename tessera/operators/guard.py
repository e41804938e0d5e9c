"""What a session may do: reads already served, tools of disabled modules, imports that exist, rules of a layer."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Tools by the module they belong to.
MODULE_TOOLS = {
    "memory": ("remember", "recall"),
    "imports": ("validate_import", "scan_suggestion"),
    "usage": ("get_active_context", "measure_token_usage", "trace_last_tool_calls"),
    "tasks": ("create_checkpoint", "get_task_progress", "rollback_to_checkpoint", "list_checkpoints"),
    "budget": ("check_budget",),
    "rules": ("get_applicable_rules", "learn_from_accept"),
}


def reads(calls: DataFrame, known: DataFrame) -> DataFrame:
    """calls (session, file, ts, call) with block: a file that the graph knows (file) and that the session has read before."""
    again = F.row_number().over(W.partitionBy("session", "file").orderBy("ts", "call")) > 1
    marked = known.select("file", F.lit(True).alias("known")).distinct()
    return calls.withColumn("again", again).join(marked, "file", "left").withColumn("block", F.coalesce("known", F.lit(False)) & F.col("again")).drop("again", "known")


def gated(calls: DataFrame, modules: DataFrame, disabled: DataFrame) -> DataFrame:
    """calls whose tool belongs to no disabled module (modules: module, tool; disabled: module)."""
    off = modules.join(disabled, "module", "left_semi").select("tool").distinct()
    return calls.join(off, "tool", "left_anti")


def validity(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """wanted (module, symbol) with valid and severity: info, warning where the module lacks the symbol, error where it isn't known."""
    modules = symbols.select("module", F.lit(True).alias("there")).distinct()
    names = symbols.select("module", "symbol", F.lit(True).alias("has")).distinct()
    out = wanted.join(modules, "module", "left").join(names, ["module", "symbol"], "left")
    fine = F.col("there").isNotNull() & (F.col("symbol").isNull() | F.col("has").isNotNull())
    return out.select("module", "symbol", fine.alias("valid"), F.when(fine, "info").when(F.col("there").isNull(), "error").otherwise("warning").alias("severity"))


#: Words of a block; two blocks are compared in one row. Classes that characters are counted in at most: those of one class count as equal.
BLOCK, CLASSES = 1024, 1024


def closest(symbols: list[str], names: list[str], n: int, least: float) -> Iterator[tuple[str, str, float]]:
    """symbol, name, ratio: for each symbol the n names (all of one length, none twice) of the highest ratio of matching blocks at or over
    `least`, ties by the later name. Characters in common bound the ratio from above; names are tried from the highest bound down, and
    no more once the bound is below what n names have."""
    names = sorted(names, reverse=True)
    size, kinds = len(names[0]), lambda text: np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES
    used, place = np.unique(kinds("".join(names)), return_inverse=True)
    count = np.zeros((len(used), len(names)), np.int32)
    np.add.at(count, (place.ravel(), np.repeat(np.arange(len(names)), size)), 1)
    at = {k: i for i, k in enumerate(used.tolist())}
    for symbol in symbols:
        whole, both = len(symbol) + size, np.zeros(len(names), np.int32)
        for kind, times in zip(*(x.tolist() for x in np.unique(kinds(symbol), return_counts=True)), strict=True):
            if kind in at:
                both += np.minimum(count[at[kind]], times)
        found: list[tuple[float, str]] = []  # best first
        tried = np.flatnonzero(2.0 * both / whole >= least)
        for i in tried[np.argsort(-both[tried], kind="stable")].tolist():
            if len(found) == n and (2.0 * int(both[i]) / whole, names[i]) <= found[-1]:
                if 2.0 * int(both[i]) / whole < found[-1][0]:
                    break
                continue
            ratio = difflib.SequenceMatcher(None, names[i], symbol).ratio()
            if ratio >= least:
                found = sorted([*found, (ratio, names[i])], reverse=True)[:n]
        yield from ((symbol, name, ratio) for ratio, name in found)


def _closest(n: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for module, symbols, names in zip(*(batch.column(c).to_pylist() for c in ("module", "symbols", "names")), strict=True):
                rows = list(closest(symbols, names, n, least))
                yield pa.RecordBatch.from_pydict({"module": pa.array([module] * len(rows), pa.string())} | {c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("symbol", pa.string()), ("name", pa.string()), ("ratio", pa.float64())))})

    return run


def _blocks(words: DataFrame, column: str) -> DataFrame:
    """module, size, block, and the words of a module that are that long, some BLOCK of them in a row."""
    sized = words.withColumn("size", F.length(column))
    many = sized.groupBy("module", "size").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64(column), F.col("blocks"))
    return sized.join(many, ["module", "size"]).groupBy("module", "size", block.alias("block")).agg(F.collect_list(column).alias(f"{column}s"))


def suggestions(wanted: DataFrame, symbols: DataFrame, n: int = 3, least: float = 0.6) -> DataFrame:
    """module, symbol, rank, name: the closest public names of a module for symbols that it lacks.

    A ratio of matching blocks of at least `least` needs lengths that are not too far apart. Symbols and names are dealt into blocks of one
    module and length, and blocks of fitting lengths are compared in a row each (`closest`), so no pair is a row. The ratio has no built-in
    counterpart and is worked out only where characters in common say that it may be among the n best."""
    missing = validity(wanted, symbols).where("severity = 'warning'").select("module", "symbol").distinct().where("length(symbol) > 0")
    names = symbols.where("not symbol like '\\\\_%' and length(symbol) > 0").select("module", F.col("symbol").alias("name")).distinct()
    asked, share = _blocks(missing, "symbol").withColumnsRenamed({"size": "long", "block": "row"}), least / (2 - least)
    fits = F.col("size").between(F.ceil(F.col("long") * share - 1e-9), F.floor(F.col("long") / share + 1e-9))
    tasks = max(int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64)  # few bytes are much work here
    pairs = asked.join(_blocks(names, "name"), "module").where(fits).repartition(tasks, "module", "long", "row", "size", "block")
    near = pairs.select("module", "symbols", "names").mapInArrow(_closest(n, least), "module string, symbol string, name string, ratio double")
    rank = F.row_number().over(W.partitionBy("module", "symbol").orderBy(F.desc("ratio"), F.desc("name")))
    return near.withColumn("rank", rank).where(F.col("rank") <= n).select("module", "symbol", "rank", "name")


# Rules of each layer.
RULES = {
    "api": (
        "Always validate input data before processing",
        "Never expose internal stack traces in HTTP responses",
        "Use appropriate HTTP status codes (200/201/400/422/500)",
        "Document all endpoints with docstrings or OpenAPI descriptions",
    ),
    "ui": ("Keep UI components free of business logic", "Handle loading and error states explicitly", "Use consistent naming for event handlers (on_<event>)"),
    "test": (
        "Use descriptive test names that explain the expected behaviour",
        "Arrange-Act-Assert structure for every test",
        "Avoid test interdependence — each test must run independently",
        "Mock external dependencies, never call real APIs in tests",
    ),
    "util": ("Functions should be pure where possible (no side effects)", "Document complex algorithms with inline comments", "Avoid module-level mutable state in utility modules"),
    "config": ("Never hardcode secrets — use environment variables", "Provide sensible defaults for all optional config values", "Document the purpose and valid range of each setting"),
    "unknown": ("Document the purpose of this module at the top of the file",),
}


def applicable_rules(files: DataFrame, learned: DataFrame) -> DataFrame:
    """files (path, layer) with rule and source: those given for the layer and those learned (layer, description)."""
    spark = files.sparkSession
    given = spark.createDataFrame([(layer, r, "default") for layer, rules in RULES.items() for r in rules], "layer string, rule string, source string")
    return files.select("path", "layer").join(F.broadcast(given).unionByName(learned.select("layer", F.col("description").alias("rule"), F.lit("learned").alias("source"))), "layer").select("path", "layer", "rule", "source")
