"""Commit history as a data source: spark.read.format("commit_log").option("path", ...).load()."""

from __future__ import annotations

import datetime
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "commit string, author string, date date, subject string, file string"
#: Between fields and before a commit: characters that git prints as they are and texts hardly hold.
_FIELD, _COMMIT = "\x1f", "\x1e"


class Range(InputPartition):
    """Commits from the skip-th on, counted back from a fixed one."""

    def __init__(self, head: str, skip: int, count: int):
        self.head, self.skip, self.count = head, skip, count


def _git(root: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    if done.returncode:
        raise OSError(done.stderr.decode(errors="replace").strip() or f"git failed in {root}")
    return done.stdout


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.parts = options["path"].removeprefix("file://"), int(options.get("partitions", 8))
        self.most = int(options.get("commits", 0))

    def partitions(self) -> list[Range]:
        """Equal ranges of the history as it is now: commits that come later don't shift them."""
        try:
            head = _git(self.root, "rev-parse", "HEAD").decode().strip()
        except OSError:  # no repository, or one without commits
            return []
        n = int(_git(self.root, "rev-list", "--count", head))
        n = min(n, self.most) if self.most else n
        step = -(-n // max(1, self.parts))
        return [Range(head, i, min(step, n - i)) for i in range(0, n, step or 1)]

    def read(self, part: Range | None) -> Iterator[tuple]:
        if part is None:  # what stands for no ranges at all
            return
        log = _git(self.root, "-c", "core.quotePath=false", "log", part.head, f"--skip={part.skip}", f"--max-count={part.count}", "--name-only", "--diff-filter=ACMRT", f"--pretty=format:{_COMMIT}%H{_FIELD}%an{_FIELD}%cs{_FIELD}%s")
        for block in log.decode(errors="replace").split(_COMMIT)[1:]:
            head, _, files = block.partition("\n")
            commit, author, day, subject = head.split(_FIELD, 3)
            for file in dict.fromkeys(f for f in files.split("\n") if f.strip()):
                yield commit, author, datetime.date.fromisoformat(day), subject, file


class CommitLog(DataSource):
    """The files of each commit of a repository. Options: path, partitions (ranges of commits, 8), commits (the newest ones only). Executors read
    the repository, so its folder must be one that they share."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def commit_log(spark: SparkSession, root: str, partitions: int = 8, commits: int = 0) -> DataFrame:
    """commit, author, date, subject, file of a repository's history; no rows where there is none."""
    spark.dataSource.register(CommitLog)
    return spark.read.format("commit_log").option("path", root).option("partitions", partitions).option("commits", commits).load()
