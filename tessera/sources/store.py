"""Tables that a session leaves behind: appended Parquet folders below one root, and small documents written only when they change.

An append is a new set of files (Spark's commit protocol: all of them or none); what is current is a view over all rows. A table that is
replaced is a new version folder; the newest one whose write was committed is what readers see, so there is never none, and a crash
leaves the version before. Nothing is kept in the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SCHEMAS = {
    "spend": "session string, tool string, tokens long, cap long, ts timestamp",
    "checkpoints": "checkpoint string, task string, parent string, description string, files array<string>, git_sha string, status string, tokens long, ts timestamp",
    "calls": "name string, args string, result_preview string, token_est long, ts timestamp",
    "memory": "category string, text string, ts timestamp",
    "questions": "key string, question string, answer string, ts timestamp, hit boolean",
    "packages": "key string, package string, version string, extraction string, ts timestamp, hit boolean",
    "extractions": "hash string, path string, extraction string, ts timestamp",
    "learned": "layer string, description string, diff_snippet string, ts timestamp",
    # what files gave when they were parsed, by path and hash of the content: see operators.increment
    "parsed": "origin string, hash string, ts timestamp",
    "fragment_nodes": "id string, label string, type string, file string, lang string, summary string, origin string, hash string, ts timestamp",
    "fragment_edges": "src string, dst string, relation string, origin string, hash string, ts timestamp",
    "fragment_docs": "origin string, name string, doc string, hash string, ts timestamp",
    "fragment_types": "origin string, key string, signature string, kind string, hash string, ts timestamp",
    "benchmarks": "question string, graph_tokens long, raw_tokens long, saved_pct double, ts timestamp",
}
CALLS, MEMORY, PACKAGES, BENCHMARKS, PREVIEW = 200, 8, 500, 50, 200
#: Versions of a replaced table that stay, for who still reads the one before; files of an appended table that are put together.
VERSIONS, FILES = 2, 64


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, name: str) -> list[str]:
        at = self._path(name)
        return [s.getPath().getName() for s in self._fs(name).listStatus(at)] if self._fs(name).exists(at) else []

    def _versions(self, name: str) -> list[str]:
        """Committed versions of a replaced table, oldest first."""
        done = (v for v in sorted(self._children(f"{name}.versions")) if self._fs(name).exists(self._path(f"{name}.versions/{v}/_SUCCESS")))
        return [f"{name}.versions/{v}" for v in done]

    def at(self, name: str) -> str:
        """Where the current rows of a table are, below the root."""
        return (self._versions(name) or [name])[-1]

    def exists(self, name: str) -> bool:
        return self._fs(name).exists(self._path(self.at(name)))

    def modified(self, name: str) -> float | None:
        """Seconds since the epoch of the last change."""
        return self._fs(name).getFileStatus(self._path(self.at(name))).getModificationTime() / 1000 if self.exists(name) else None

    def append(self, name: str, rows: DataFrame | list[tuple]) -> None:
        """Rows in the columns of the table; a list is made a frame. ts is filled with the time of the write where it is missing. A table
        of more than FILES files is written anew as few."""
        schema = SCHEMAS[name]
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, schema)
        df.withColumn("ts", F.coalesce("ts", F.current_timestamp())).write.mode("append").parquet(f"{self.root}/{self.at(name)}")
        if len(self._children(self.at(name))) > FILES:
            self.compact(name)

    def compact(self, name: str) -> None:
        """The same rows in few files: about as many as their size asks for."""
        size = self._fs(name).getContentSummary(self._path(self.at(name))).getLength()
        self.replace(name, self.read(name).coalesce(max(1, min(FILES // 2, size >> 27))))

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{self.at(name)}")

    def frame(self, name: str) -> DataFrame | None:
        """A replaced table with the schema it was written in, if it is there."""
        return self.spark.read.parquet(f"{self.root}/{self.at(name)}") if self.exists(name) else None

    def replace(self, name: str, df: DataFrame) -> None:
        """Write df as the next version. It counts once its write is committed; versions before the last VERSIONS go then."""
        old = sorted(self._children(f"{name}.versions"))
        df.write.mode("overwrite").parquet(f"{self.root}/{name}.versions/{int(old[-1]) + 1 if old else 0:09d}")
        stay = self._versions(name)[-VERSIONS:]
        for gone in [name, *(f"{name}.versions/{v}" for v in old)]:
            if gone not in stay:
                self._fs(name).delete(self._path(gone), True)

    # ---- views

    def newest(self, name: str, n: int, *key: str, order: tuple[Column, ...] = ()) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*(key or (F.lit(0),))).orderBy(F.desc("ts"), *order))
        return self.read(name).withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")

    def calls(self, n: int = CALLS) -> DataFrame:
        """The newest calls, as a top-n list."""
        return self.read("calls").orderBy(F.desc("ts"), "name", "args").limit(n)

    def record_call(self, calls: DataFrame) -> None:
        """calls (name, args, result, ts): four characters of the result make a token, PREVIEW of them are kept."""
        self.append("calls", calls.select("name", "args", F.substring("result", 1, PREVIEW).alias("result_preview"), F.floor(F.length("result") / 4).cast("long").alias("token_est"), "ts"))

    def memory(self, n: int = MEMORY) -> DataFrame:
        return self.newest("memory", n, "category", order=(F.col("text"),))

    def memory_text(self) -> str:
        """The last entries of each category as Markdown, empty if there are none."""
        rows = self.memory().orderBy("category", "ts", "text").collect()  # MEMORY a category
        out: list[str] = []
        for r in rows:
            if f"**{r.category.capitalize()}:**" not in out:
                out += ["", f"**{r.category.capitalize()}:**"]
            out.append(f"- {r.text}")
        return "\n".join(["### Session memory", *out]) if out else ""

    def budget(self) -> DataFrame:
        """session, spent, cap (the latest one set), by session."""
        return self.read("spend").groupBy("session").agg(F.sum("tokens").alias("spent"), F.max_by("cap", F.when(F.col("cap").isNotNull(), F.col("ts"))).alias("cap"))

    def create_checkpoint(self, task: str, description: str, files: list[str], tokens: int = 0, git_sha: str | None = None, key: str | None = None) -> str:
        """Appends a checkpoint whose parent is the latest active one of the task; gives its id."""
        import uuid

        key = key or uuid.uuid4().hex[:12]
        last = self.checkpoints().where((F.col("task") == task) & (F.col("status") == "active")).orderBy(F.desc("ts"), F.desc("checkpoint")).first()
        self.append("checkpoints", [(key, task, last and last.checkpoint, description, files, git_sha, "active", tokens, None)])
        return key

    def checkpoints(self) -> DataFrame:
        """Each checkpoint as it was written last."""
        last = F.row_number().over(W.partitionBy("checkpoint").orderBy(F.desc("ts"), (F.col("status") == "active")))
        first = F.min("ts").over(W.partitionBy("checkpoint"))
        return self.read("checkpoints").withColumns({"_rn": last, "ts": first}).where("_rn = 1").drop("_rn")

    def rollback(self, checkpoint: str) -> int:
        """Marks a checkpoint and the later ones of its task as rolled back, by appending their new state; gives how many."""
        every = self.checkpoints()
        since = every.where(F.col("checkpoint") == checkpoint).select("task", F.col("ts").alias("since"))
        gone = every.where("status = 'active'").join(F.broadcast(since), "task").where("ts >= since").drop("since")
        n = gone.count()
        if n:
            self.append("checkpoints", gone.select(*[c.split()[0] for c in SCHEMAS["checkpoints"].split(", ")]).withColumns({"status": F.lit("rolled_back"), "ts": F.current_timestamp()}))
        return n

    def questions(self) -> DataFrame:
        """key, question, answer (the latest), hits."""
        saved = self.read("questions")
        return saved.where("not hit").groupBy("key").agg(F.max_by("question", "ts").alias("question"), F.max_by("answer", "ts").alias("answer")).join(saved.where("hit").groupBy("key").agg(F.count("*").alias("hits")), "key", "left").fillna(0, ["hits"])

    def packages(self) -> DataFrame:
        """key (name@version), package, version, extraction, hits, last_used."""
        saved = self.read("packages")
        used = saved.groupBy("key").agg(F.max("ts").alias("last_used"), F.count_if("hit").alias("hits"))
        return saved.where("not hit").groupBy("key").agg(*(F.max_by(c, "ts").alias(c) for c in ("package", "version", "extraction"))).join(used, "key")

    def evict_packages(self, most: int = PACKAGES) -> None:
        """Keeps the packages used last."""
        best = self.packages().orderBy(F.desc("last_used"), "key").limit(most)
        self.replace("packages", best.select("key", "package", "version", "extraction", F.col("last_used").alias("ts"), F.lit(False).alias("hit")))

    def cached_extractions(self, files: DataFrame, *also: str) -> tuple[DataFrame, DataFrame]:
        """Files (path, content) that an extraction is known of, with it, and the others; by hash of the content (and also the path)."""
        key = ["hash", *also]
        hashed = files.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
        known = self.read("extractions").groupBy(*key).agg(F.max_by("extraction", "ts").alias("extraction"))
        return hashed.join(known, key), hashed.join(known, key, "left_anti")

    def save_extractions(self, rows: DataFrame) -> None:
        self.append("extractions", rows.select("hash", "path", "extraction", F.lit(None).cast("timestamp").alias("ts")))

    def forget_extractions(self, paths: DataFrame) -> None:
        self.replace("extractions", self.read("extractions").join(paths.select("path").distinct(), "path", "left_anti").select("hash", "path", "extraction", "ts"))

    def stats(self) -> DataFrame:
        """store, entries, hits of the question, package and extraction stores."""
        one = lambda name, df, hits: df.agg(F.count("*").alias("entries"), hits.alias("hits")).select(F.lit(name).alias("store"), "entries", "hits")
        total = F.coalesce(F.sum("hits"), F.lit(0)).cast("long")
        return one("questions", self.questions(), total).unionByName(one("packages", self.packages(), total)).unionByName(one("extractions", self.read("extractions").select("hash").distinct(), F.lit(0).cast("long")))

    # ---- the last difference

    def save_diff(self, nodes: DataFrame, edges: DataFrame) -> None:
        """What `graph.diff_nodes` and `diff_edges` gave; the difference before it goes."""
        n = nodes.select(F.lit("node").alias("what"), "id", F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("relation"), "change")
        self.replace("last_diff", n.unionByName(edges.select(F.lit("edge").alias("what"), F.col("src").alias("id"), "dst", "relation", "change")))

    def load_diff(self) -> DataFrame | None:
        return self.frame("last_diff")

    # ---- small documents

    def read_text(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        rows = self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect()
        return "".join(r.value for r in rows)

    def write_text(self, name: str, body: str) -> bool:
        """Writes a document if it is new or other than what is there; says whether it did."""
        if self.read_text(name) == body:
            return False
        out = self._fs(name).create(self._path(name), True)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        return True

    def write_block(self, name: str, block: str, start: str = "<!-- context:start -->", end: str = "<!-- context:end -->") -> bool:
        """Puts a block between marks into a document, in place of the one before; an equal block leaves the file untouched."""
        if not block:
            return False
        marked = f"{start}\n{block}\n{end}"
        old = self.read_text(name)
        if old is None:
            return self.write_text(name, f"# Project context\n\n{marked}\n")
        if start in old and end in old:
            head, _, rest = old.partition(start)
            return self.write_text(name, head + marked + rest.partition(end)[2])
        return self.write_text(name, f"{old.rstrip()}\n\n{marked}\n")

    def write_status(self, status: str, done: int, total: int, started: str, message: str = "") -> dict:
        """Build status with its percentage; a finished build counts all files as done."""
        total = max(total, 1)
        done = total if status == "complete" else done
        row = {"status": status, "files_done": done, "files_total": total, "percent": 100 * done // total, "started_at": started, "message": message}
        self.write_text("build_status.json", json.dumps(row))
        return row

    def status(self) -> dict:
        raw = self.read_text("build_status.json")
        return json.loads(raw) if raw else {"status": "idle", "files_done": 0, "files_total": 0, "percent": 0}
