"""File sources: directory scans, node-link JSON, line-JSON logs, manifests, commit logs, diffs, symbol files."""

from __future__ import annotations

import html as entities
import io
import re
import subprocess
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pdf

# File types by suffix, in order of precedence, and directories that a scan leaves out.
TYPES = {
    "code": ".py .pyw .js .jsx .mjs .cjs .ts .tsx .mts .go .rs .java .kt .kts .swift .cs .cpp .cc .cxx .hpp .h .c .rb .php .vue .svelte .dart .scala .zig .lua .r .sh .bash .yaml .yml .json .toml .css .scss .sass .less .html .htm .tf .hcl .sql".split(),
    "document": ".md .mdx .rst .txt .adoc .docx .prisma .graphql .gql .proto .env".split(),
    "paper": [".pdf"],
    "image": ".png .jpg .jpeg .gif .webp .svg".split(),
}
EXCLUDED = (
    "node_modules", ".git", "dist", "build", "out", "__pycache__", ".venv", "venv", "env", ".env", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".next", ".nuxt",
    ".svelte-kit", "target", "vendor", ".idea", ".vscode-test", "coverage", ".tox", "egg-info",
)  # and whatever folder a build writes to
LARGEST = 2 * 1024 * 1024
#: The schema of Spark's binaryFile source, which streams of it must name.
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"

NODE_LINK = "nodes array<struct<id:string,label:string,type:string,file:string,lang:string,summary:string,community:int>>, links array<struct<source:string,target:string,relation:string>>"
CALL = "name string, args string, result_preview string, token_est int, timestamp string"


def file_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return reduce(lambda c, kv: c.when(suffix.isin(*kv[1]), kv[0]), TYPES.items(), F).otherwise("other")


def scan(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED, largest: int = LARGEST, with_content: bool = False) -> DataFrame:
    """path, length, modified, type (and content) below a root, without excluded directories, other types, very large and empty files (the
    latter are not listed by the source).

    Without content only the listing is read. The order of paths is left to who shows them.
    """
    found = wanted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root, excluded, largest)
    return decoded(found) if with_content else found.drop("content")


def wanted(files: DataFrame, root: str, excluded: tuple[str, ...] = EXCLUDED, largest: int = LARGEST) -> DataFrame:
    """The rows of a binaryFile source, batch or stream, that `scan` keeps: path, length, modified, type, content (bytes)."""
    inside = F.split(F.regexp_replace("path", r"^.*?" + _escaped(root), ""), "/")
    kept = files.where(F.col("length") <= largest).where(~F.arrays_overlap(inside, F.array(*[F.lit(x) for x in excluded]))).withColumn("type", file_type(F.col("path"))).where("type <> 'other'")
    return kept.select("path", "length", F.col("modificationTime").alias("modified"), "type", "content")


#: Suffixes of files whose text has to be taken out of their bytes.
BINARY = (".pdf", ".docx")


def decoded(files: DataFrame) -> DataFrame:
    """Files (path, ..., content: bytes) with their text as content: read out of PDF and word-processor documents (null where there is no text
    in them), else as UTF-8, with a mark in place of bytes that are none. Only the former go through Python."""
    binary = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*BINARY)
    plain = files.where(~binary).withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
    kinds = ", ".join(f"`{f.name}` {'string' if f.name == 'content' else f.dataType.simpleString()}" for f in files.schema)
    return plain.unionByName(files.where(binary).mapInArrow(_documents, kinds))


def below(path: Column, root: str) -> Column:
    """The part of a path below a root."""
    return F.regexp_replace(path, r"^.*?" + _escaped(root) + "/?", "")


def _escaped(root: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "/" else c for c in root.split("://")[-1].rstrip("/"))


def summarize(files: DataFrame) -> DataFrame:
    return files.groupBy("type").agg(F.count("*").alias("n"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a node-link JSON document."""
    doc = spark.read.schema(NODE_LINK).option("multiLine", True).json(path)
    return doc.select(F.inline("nodes")), doc.select(F.inline("links")).select(F.col("source").alias("src"), F.col("target").alias("dst"), "relation")


def best_graph(spark: SparkSession, full: str, partial: str) -> tuple[DataFrame, DataFrame, bool] | None:
    """The full graph, else the partial one (True), else none. Whether a path is there is asked of the file system that Spark uses."""
    for path, is_partial in ((full, False), (partial, True)):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return (*read_graph(spark, path), is_partial)
    return None


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Tool-call records of line-JSON; corrupt and blank lines go."""
    return spark.read.schema(CALL).option("mode", "DROPMALFORMED").json(path).where("name is not null")


def dependencies(manifests: DataFrame) -> DataFrame:
    """path, name, version of package.json and requirements.txt contents (path, content); range signs are dropped."""
    name = F.element_at(F.split("path", "/"), -1)
    parsed = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    js = manifests.where(name == "package.json").withColumn("m", parsed).select("path", F.explode(F.map_concat(F.coalesce("m.dependencies", F.create_map().cast("map<string,string>")), F.coalesce("m.devDependencies", F.create_map().cast("map<string,string>")))).alias("name", "version"))
    line = manifests.where(name.rlike(r"^requirements.*\.txt$")).select("path", F.explode(F.split("content", "\n")).alias("l")).select("path", F.regexp_extract("l", r"^\s*([A-Za-z0-9_.-]+)", 1).alias("name"), F.regexp_extract("l", r"[=<>~^!]+\s*([^\s;,#]+)", 1).alias("version")).where("name <> ''")
    listed = F.regexp_extract("content", r"(?ms)^dependencies\s*=\s*\[(.*?)^?\]\s*$", 1)
    toml = manifests.where(name == "pyproject.toml").select("path", F.explode(F.regexp_extract_all(listed, F.lit(r"""["']([^"']+)["']"""), F.lit(1))).alias("l")).select("path", F.regexp_extract("l", r"^\s*([A-Za-z0-9_.-]+)", 1).alias("name"), F.regexp_extract("l", r"[=<>~^!]+\s*([^\s;,#]+)", 1).alias("version"))
    return js.unionByName(line).unionByName(toml).withColumn("version", F.regexp_replace("version", r"^[\^~>=<\s]+", ""))


def document_text(spark: SparkSession, root: str) -> DataFrame:
    """path, content of the PDF and word-processor documents below a root: a line for each paragraph or line, headings of the latter with # in
    front. What they hold is compressed, which no built-in reads, so this is a map in Arrow batches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,docx}").load(root)
    return decoded(files.select("path", "content"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, path = batch.schema.get_field_index("content"), batch.column(batch.schema.get_field_index("path"))
        texts = [pdf.text_of(b) if p.lower().endswith(".pdf") else _paragraphs(b) for p, b in zip(path.to_pylist(), batch.column(at).to_pylist(), strict=True)]
        yield batch.set_column(at, pa.field("content", pa.string()), pa.array(texts, pa.string()))


def _paragraphs(raw: bytes) -> str | None:
    try:
        xml = zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml").decode(errors="replace")
    except (zipfile.BadZipFile, KeyError):
        return None
    out = []
    for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S):
        line = entities.unescape("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p))).strip()
        if line:
            out.append(("# " if re.search(r'<w:pStyle w:val="Heading', p) else "") + line)
    return "\n".join(out)


def cost_report(spark: SparkSession, path: str) -> DataFrame:
    """A cost report's fields with what follows from them: naive and actual tokens, tokens saved, compression in percent."""
    fields = ("cache_hits", "calls_saved", "total_files_processed", "llm_calls_made", "total_input_tokens", "total_output_tokens", "actual_cost_usd", "naive_cost_usd", "cost_saved_usd", "savings_pct", "run_duration_seconds")
    raw = spark.read.schema(", ".join(f"{f} double" for f in fields)).option("multiLine", True).json(path)
    return cost_view(raw.fillna(0.0))


def cost_view(report: DataFrame, price: float = 3.0) -> DataFrame:
    """report with naive_tokens, actual_tokens, tokens_saved, compression_pct. Millionths of dollars are taken to six places: what the doubles
    of dollars leave behind would turn halves of a token down."""
    naive = F.round(F.round(F.col("naive_cost_usd") * 1e6, 6) / price).cast("long")
    actual = (F.col("total_input_tokens") + F.col("total_output_tokens")).cast("long")
    out = report.withColumns({"naive_tokens": naive, "actual_tokens": actual})
    pct = F.when(F.col("naive_tokens") > 0, F.greatest(F.lit(0), F.round((1 - F.col("actual_tokens") / F.col("naive_tokens")) * 100).cast("long"))).otherwise(0)
    return out.withColumns({"tokens_saved": F.greatest(F.lit(0).cast("long"), F.col("naive_tokens") - F.col("actual_tokens")), "compression_pct": pct.cast("long")})


def benchmark_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The summary (first line) and the questions of a line-JSON benchmark file, both as JSON text in order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("i", "json"))
    return rows.where("i = 0").select("json"), rows.where("i > 0").select((F.col("i") - 1).alias("i"), "json")


def git(root: str, *args: str) -> str | None:
    """What git prints in a working tree, null where there is no git or no repository."""
    try:
        out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=15, errors="replace")
    except (FileNotFoundError, subprocess.TimeoutExpired):
        return None
    return out.stdout if out.returncode == 0 else None


def lsp_symbols(spark: SparkSession, content: DataFrame) -> DataFrame:
    """file, id, label, type of language-server symbol JSON: a map from files to symbols with a kind number."""
    kinds = {5: "class", 6: "function", 11: "interface", 12: "function", 13: "variable"}
    sym = content.select(F.explode(F.from_json("content", "map<string,array<struct<name:string,kind:int>>>")).alias("file", "s")).select("file", F.explode("s").alias("s"))
    kind = reduce(lambda c, kv: c.when(F.col("s.kind") == kv[0], kv[1]), kinds.items(), F).otherwise("symbol")
    return sym.select("file", F.concat_ws("::", "file", "s.name").alias("id"), F.col("s.name").alias("label"), kind.alias("type"))


def questions(content: DataFrame) -> DataFrame:
    """question of a JSON list of strings or of objects with that field."""
    texts = F.from_json("content", "array<string>")
    each = content.select(F.explode(texts).alias("q"))
    return each.select(F.coalesce(F.get_json_object("q", "$.question"), F.col("q")).alias("question"))


def commit_log(content: DataFrame) -> DataFrame:
    """commit, author, date, subject, file of `git log --name-only --pretty=format:@%H|%an|%ad|%s --date=short` output (content)."""
    blocks = content.select(F.explode(F.split("content", r"(?m)^@")).alias("b")).where("trim(b) <> ''")
    head = F.split(F.substring_index("b", "\n", 1), r"\|", 4)
    rows = blocks.select(head[0].alias("commit"), head[1].alias("author"), F.to_date(head[2]).alias("date"), head[3].alias("subject"), F.explode(F.split(F.regexp_replace("b", r"\A[^\n]*\n?", ""), "\n")).alias("file"))
    return rows.where("trim(file) <> ''").distinct()


def changed_functions(diff: DataFrame) -> DataFrame:
    """file, function named in the hunk headers of a unified diff (content)."""
    parts = diff.select(F.explode(F.split("content", r"(?m)^diff --git ")).alias("p")).where("trim(p) <> ''")
    file = F.regexp_extract("p", r"(?m)^\+\+\+ b/(.+)$", 1)
    hunk = F.regexp_extract_all(F.col("p"), F.lit(r"(?m)^@@[^@\n]*@@\s*(?:async\s+)?(?:def|class|function|func|fn)\s+(\w+)"), F.lit(1))
    return parts.select(file.alias("file"), F.explode(hunk).alias("function")).distinct()


def cache_partition(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of files (path, content) whose content the cache (hash) has, and the others."""
    hashed = files.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
    return hashed.join(cache, "hash", "left_semi"), hashed.join(cache, "hash", "left_anti")
