"""Commit history on a graph: which node a file of the log belongs to, risk, coupling, and the state of a working tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .keep import spread


#: How a path finds its file in a log: by the longest end that both paths have, or the busiest file of the same name.
LONGEST, BUSIEST = "longest", "busiest"


def ends(path: Column, choice: str = LONGEST) -> Column:
    """The ends of a path with how many parts they have: util.py, a/util.py, src/a/util.py; only the first for the busiest."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    most = F.size(parts) if choice == LONGEST else F.lit(1)
    return F.transform(F.sequence(F.lit(1), most), lambda i: F.struct(i.alias("parts"), F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "/").alias("end")))


def by_end(log: DataFrame, choice: str = LONGEST) -> DataFrame:
    """end, file, n, authors, bug, recent for each end of the paths of a log's files (file, n, authors, bug, recent): the most frequent of the
    files with that end (ties: the first by path), and whether any of them was mended or changed lately. One row for each end, so
    paths look theirs up and no pairs of many with many are made, however common a name."""
    best = F.min_by(F.struct("file", "n", "authors"), F.struct((-F.col("n")).alias("neg"), "file"))
    every = log.select("*", F.explode(ends(F.col("file"), choice)).alias("e"))
    return every.groupBy("e.end").agg(best.alias("best"), F.bool_or("bug").alias("bug"), F.bool_or("recent").alias("recent")).select("end", "best.*", "bug", "recent")


def found(paths: DataFrame, known: DataFrame, choice: str = LONGEST) -> DataFrame:
    """For each of the paths (path) the row of known (end, ...) with the longest end it has; paths without any are left out."""
    every = paths.where("path is not null").select("path").distinct().select("path", F.explode(ends(F.col("path"), choice)).alias("e"))
    hits = every.select("path", F.col("e.parts").alias("parts"), F.col("e.end").alias("end")).join(known, "end")
    rest = [c for c in known.columns if c != "end"]
    return hits.groupBy("path").agg(F.max_by(F.struct(*rest), "parts").alias("best")).select("path", "best.*")


def risk(n: Column, bug: Column, recent: Column) -> Column:
    """Between 0 and 1, from how often a file changes, whether mends touched it, whether it changed lately."""
    score = F.least(n / 50.0, F.lit(0.5)) + F.when(bug, 0.3).otherwise(0.0) + F.when(recent, 0.1).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 3)


def enrich(nodes: DataFrame, log: DataFrame, choice: str = LONGEST) -> DataFrame:
    """nodes with git_frequency, git_bug_fixes, git_recent, git_authors, git_risk_score (null where no file matches) and a note in the
    summary. A node takes the history of the log's file with the longest end of its path, which is at least the file name."""
    files = found(nodes.select(F.col("file").alias("path")), by_end(log, choice), choice)
    files = files.select(F.col("path").alias("file"), F.col("n").alias("git_frequency"), F.col("bug").alias("git_bug_fixes"), F.col("recent").alias("git_recent"), F.col("authors").alias("git_authors"))
    out = nodes.join(files, "file", "left").select(*nodes.columns, *files.columns[1:])
    out = out.withColumn("git_risk_score", F.when(F.col("git_frequency").isNotNull(), risk(F.col("git_frequency"), F.col("git_bug_fixes"), F.col("git_recent"))))
    note = F.concat(F.lit("[git: "), F.col("git_frequency").cast("string"), F.lit(" commits"), F.when(F.col("git_bug_fixes"), ", has bug fixes").otherwise(""), F.when(F.col("git_recent"), ", recently changed").otherwise(""), F.lit("]"))
    now = F.coalesce("summary", F.lit(""))
    return out.withColumn("summary", F.when(F.col("git_frequency").isNull() | F.contains(now, note), F.col("summary")).otherwise(F.trim(F.concat_ws(" ", now, note))))


#: Files of a commit whose pairs are made in its row; a larger commit is cut into blocks of about as many.
WIDE = 256


def co_changes(commits: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """file_a, file_b, n: in how many commits (commit, file) two files are together, of the first `most` files of each where it is set. A commit's
    pairs are made in its row and dealt out as they are, over tasks that follow from the number of rows: hardly any pair comes twice in a
    task, so counting there first would only hold them all in memory. Commits of more than WIDE files are paired by `_wide`."""
    tasks, sized = spread(commits.sparkSession, rows), commits
    if most is None:
        sized = commits.select("commit", "file", F.count("*").over(W.partitionBy("commit")).alias("size"))
    files = (sized if most else sized.where(F.col("size") <= WIDE)).groupBy("commit").agg(F.array_sort(F.collect_set("file")).alias("f"))
    files = files.select(F.slice("f", 1, most or WIDE).alias("f"))
    made = F.flatten(F.transform("f", lambda a, i: F.transform(F.slice("f", i + 2, most or WIDE), lambda b: F.struct(a.alias("file_a"), b.alias("file_b")))))
    pairs = files.select(F.explode(made).alias("p")).select("p.*")
    if most is None:
        pairs = pairs.unionByName(_wide(sized.where(F.col("size") > WIDE), tasks))
    return pairs.repartition(tasks, "file_a", "file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("n"))


def _wide(files: DataFrame, tasks: int) -> DataFrame:
    """file_a, file_b (file_a < file_b): all pairs of the files of a commit (commit, file, size). A file falls into one of the commit's blocks,
    and every two blocks are a unit of work, dealt over all tasks; so no task holds a commit, or all partners of a file."""
    blocks = F.ceil(F.col("size") / WIDE).cast("int")
    placed = files.select("commit", "file", blocks.alias("blocks"), F.pmod(F.xxhash64("file"), blocks).cast("int").alias("at"))
    each = placed.select("commit", "file", "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    each = each.select("commit", "file", "at", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j")).repartition(tasks, "commit", "i", "j")
    of = lambda side: F.collect_set(F.when(F.col("at") == F.col(side), F.col("file")))
    units = each.groupBy("commit", "i", "j").agg(of("i").alias("one"), of("j").alias("two"))
    both = units.select("i", "j", "two", F.explode("one").alias("a")).select("i", "j", "a", F.explode("two").alias("b")).where("i <> j or a < b")
    return both.select(F.least("a", "b").alias("file_a"), F.greatest("a", "b").alias("file_b"))


def coupling(nodes: DataFrame, log: DataFrame, pairs: DataFrame, least: int = 3, choice: str = LONGEST, tasks: int | None = None) -> DataFrame:
    """src, dst, relation, weight of files (file_a, file_b, n) that change together, between their nodes: the node that a file is the
    best match of, else the node with the longest end of its path. Nodes of one file: the first by id. tasks: over how many the pairs are dealt."""
    own = nodes.where("file is not null").groupBy(F.col("file").alias("path")).agg(F.min("id").alias("node"))
    log = log.select("file", "n", *(F.lit(None).cast(t).alias(c) for c, t in (("authors", "long"), ("bug", "boolean"), ("recent", "boolean"))))  # only whose match a node is
    exact = found(own, by_end(log, choice), choice).join(own, "path").groupBy("file").agg(F.min("node").alias("own"))
    far = pairs.where(F.col("n") >= least)
    asked = far.select(F.explode(F.array("file_a", "file_b")).alias("path")).distinct()
    near = own.select("node", F.explode(ends(F.col("path"), choice)).alias("e")).groupBy("e.end").agg(F.min("node").alias("near"))
    of = asked.join(exact.withColumnRenamed("file", "path"), "path", "left").join(found(asked, near, choice), "path", "left").select("path", F.coalesce("own", "near").alias("node"))
    for side in ("a", "b"):
        dealt = lambda df: df if tasks is None else df.repartition(tasks, f"file_{side}")  # noqa: B023, E731
        far = dealt(far).join(dealt(of.toDF(f"file_{side}", f"node_{side}")), f"file_{side}", "left")
    return far.where("node_a is not null and node_b is not null and node_a <> node_b").select(F.col("node_a").alias("src"), F.col("node_b").alias("dst"), F.lit("co_changes_with").alias("relation"), F.col("n").alias("weight"))


# ---- a working tree, from what git prints


def changed(status: DataFrame) -> DataFrame:
    """path, state (untracked, deleted, changed) of `git status --porcelain` output (content)."""
    line = status.select(F.explode(F.split("content", "\n")).alias("l")).where("trim(l) <> ''")
    code = F.substring("l", 1, 2)
    state = F.when(code == "??", "untracked").when(code.contains("D"), "deleted").otherwise("changed")
    return line.select(F.element_at(F.split(F.substring("l", 4, 100_000), " -> "), -1).alias("path"), state.alias("state"))


def full_reextract(functions: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """file, full: whether a changed file is to be extracted as a whole: no function of it is named in its hunks, or more than `most`."""
    n = functions.groupBy("file").agg(F.count("*").alias("n"))
    return files.select("file").join(n, "file", "left").select("file", (F.coalesce("n", F.lit(0)) == 0).alias("none"), "n").select("file", (F.col("none") | (F.col("n") > most)).alias("full"))


def unchanged(clean: bool, graph_time: float | None, commit_time: float | None, force: bool = False) -> bool:
    """Whether a build can be left out: nothing forced, a clean tree, and a graph from the last commit's time or later."""
    return not force and clean and graph_time is not None and commit_time is not None and graph_time >= commit_time


def to_update(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of files (path, ...) that a change names: changed or new ones."""
    return files.join(changes.where("state <> 'deleted'").select("path").distinct(), "path", "left_semi")
