"""What extractions of a file were worth: scores over runs, files to skip, patterns learnt from many such files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Paths that are skipped from the start (matched from the beginning, in any case), in order.
SKIP = (
    r".*\.(min|bundle|chunk)\.(js|css)$",
    r".*/generated/.*",
    r".*/\.next/.*",
    r".*/__pycache__/.*",
    r".*/dist/.*\.(js|d\.ts)$",
    r".*\.pb\.go$",
    r".*_pb2\.py$",
    r".*\.generated\.\w+$",
    r".*/migrations/\d+.*",
    r".*package-lock\.json$",
    r".*yarn\.lock$",
    r".*poetry\.lock$",
    r".*Cargo\.lock$",
    r".*composer\.lock$",
    r".*Pipfile\.lock$",
)
LOW, DAYS = 2.0, 30


def scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """run, file, score of each extraction (nodes: run, file, label, summary; edges: run, file): distinct labels, two for each edge,
    and nodes with a summary over 20 characters."""
    n = nodes.groupBy("run", "file").agg((F.countDistinct("label") + F.count_if(F.length("summary") > 20)).alias("n"))
    e = edges.groupBy("run", "file").agg(F.count("*").alias("e"))
    return n.join(e, ["run", "file"], "full").select("run", "file", (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("e", F.lit(0))).alias("score"))


def history(runs: DataFrame) -> DataFrame:
    """file, runs, avg_score, last_seen (month) of runs (file, score, ts)."""
    return runs.groupBy("file").agg(F.count("*").alias("runs"), F.round(F.avg("score"), 2).alias("avg_score"), F.date_format(F.max("ts"), "yyyy-MM").alias("last_seen"))


def fresh(last_seen: Column, as_of: Column) -> Column:
    return last_seen >= F.date_format(F.date_sub(as_of, DAYS), "yyyy-MM")


def skip_reason(path: Column, runs: Column, avg_score: Column, last_seen: Column, as_of: Column, learned: Column | None = None) -> Column:
    """Why a file is skipped, null if it isn't: a pattern, a learnt pattern (array), or little worth in two runs and more of late."""
    starts = lambda p: path.rlike(f"(?i)^(?:{p})")
    by_pattern = reduce(lambda c, p: c.when(starts(p), f"default_pattern:{p[:40]}"), SKIP[1:], F.when(starts(SKIP[0]), f"default_pattern:{SKIP[0][:40]}"))
    low = (runs >= 2) & (avg_score <= LOW) & fresh(last_seen, as_of)
    worth = F.when(low, F.concat(F.lit("low_value:"), F.format_number(avg_score, 1), F.lit("_avg_over_"), runs.cast("string"), F.lit("_runs")))
    if learned is None:
        return F.coalesce(by_pattern, worth)
    hit = F.get(F.filter(learned, lambda p: F.regexp_like(path, F.concat(F.lit("^(?:"), p, F.lit(")")))), F.lit(0))
    return F.coalesce(by_pattern, F.concat(F.lit("learned_pattern:"), F.substring(hit, 1, 40)), worth)


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([^\w/])", r"\\$1")


def learn(known: DataFrame) -> DataFrame:
    """pattern, reason: folders with three files of little worth (two runs and more each), suffixes with five (three runs and more)."""
    low = known.where(F.col("avg_score") <= LOW)
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    dirs = low.where("runs >= 2").groupBy(folder.alias("d")).agg(F.count("*").alias("n")).where("n >= 3")
    dirs = dirs.select(F.concat(_escaped(F.col("d")), F.lit("/.*")).alias("pattern"), F.format_string("auto: %d low-value files in dir", "n").alias("reason"))
    suffix = F.regexp_extract("file", r"\.([^.]*)$", 1)
    ends = low.where("runs >= 3").groupBy(suffix.alias("s")).agg(F.count("*").alias("n")).where("n >= 5 and s <> ''")
    return dirs.unionByName(ends.select(F.concat(F.lit(r".*\."), _escaped(F.col("s")), F.lit("$")).alias("pattern"), F.format_string("auto: %d low-value .%s files", "n", "s").alias("reason")))


def stats(known: DataFrame, learned: DataFrame) -> DataFrame:
    """One row: files known, of little worth, patterns learnt and given."""
    return known.agg(F.count("*").alias("total_files_tracked"), F.count_if(F.col("avg_score") <= LOW).alias("low_value_files")).crossJoin(learned.agg(F.count("*").alias("learned_patterns"))).withColumn("default_patterns", F.lit(len(SKIP)))


def purge(known: DataFrame, as_of: Column) -> DataFrame:
    """Without files not seen of late."""
    return known.where(fresh(F.col("last_seen"), as_of))
