"""Command line: build a graph, ask it, and look at its logs. `python -m tessera.cli COMMAND ...`"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import code
from .operators import build, context, traverse
from .sources import files, sinks
from .sources.store import Store
from .streaming import progressive


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("--out", default="tessera-out", help="folder of the graph and its logs")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, help: str = "") -> None:
        c = sub.add_parser(name, help=help)
        for names, options in args:
            c.add_argument(*names, **options)

    text = lambda *n: (n, {})
    flag = lambda n: ((n,), {"action": "store_true"})
    number = lambda n, d: ((n,), {"type": int, "default": d})
    add("build", text("root"), flag("--force"), flag("--no-viz"), flag("--update"), flag("--progressive"), help="build the graph of a folder")
    add("query", text("question"), help="ask the graph")
    add("context", text("question"), number("--budget", 6000), help="context lines for a model")
    add("impact", text("node"), number("--depth", 3), help="what depends on a node")
    add("diff", help="what the last build changed")
    add("export", (("format",), {"choices": ["graphml", "cypher", "canvas", "html"]}), text("path"), help="write the graph in another form")
    add("build-status", help="state of the last build")
    add("cost-report", text("path"), help="a cost report with what follows from it")
    add("build-from-lsp", text("path"), help="nodes of a language server's symbols")
    add("benchmark", text("root"), help="tokens of files against tokens of the graph")
    add("benchmark-suite", text("questions"), help="answers to a file of questions and what they cost")
    add("validate-import", text("module"), (("symbol",), {"nargs": "?"}), help="whether a module has a symbol")
    add("context-lens", number("--last", 20), help="the newest tool calls")
    add("checkpoint", text("task"), text("description"), (("files",), {"nargs": "*"}), help="record a step of a task")
    add("task-progress", text("task"), help="checkpoints of a task")
    add("budget", (("action",), {"choices": ["set", "check"]}), text("session"), number("--cap", 0), help="token budget of a session")
    add("rules", text("file"), help="rules for a file")
    add("watch", text("root"), help="rebuild on changes")
    return p


def run(spark: SparkSession, argv: list[str]) -> str:
    """What a command prints."""
    a = parser().parse_args(argv)
    store = Store(spark, a.out)

    def shown(df, most: int = 100) -> str:
        return "\n".join(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) for r in df.limit(most).collect())

    if a.command == "build":
        if a.progressive:
            b = progressive.build_progressively(spark, a.root, a.out)
        else:
            b = build.build_graph(spark, a.root, a.out, force=a.force, viz=not a.no_viz, only_named=a.update)
        return "unchanged" if b.skipped else json.dumps(b.counts)
    if a.command == "build-status":
        return json.dumps(store.status())
    if a.command == "cost-report":
        return shown(files.cost_report(spark, a.path))
    if a.command == "build-from-lsp":
        return shown(files.lsp_symbols(spark, spark.read.text(a.path, wholetext=True).withColumnRenamed("value", "content")))
    if a.command == "diff":
        found = store.load_diff()
        return "no build yet" if found is None else shown(found.groupBy("what", "change").agg(F.count("*").alias("n")).orderBy("what", "change"))
    if a.command == "context-lens":
        return shown(store.calls(a.last))
    if a.command == "budget":
        if a.action == "set":
            store.append("spend", [(a.session, "budget", 0, a.cap, None)])
        return shown(store.budget().where(F.col("session") == a.session))
    if a.command == "checkpoint":
        return store.create_checkpoint(a.task, a.description, a.files)
    if a.command == "watch":
        from .streaming import ledger_stream

        q = ledger_stream.rebuild_on(ledger_stream.watch_files(spark, a.root), lambda df, i: build.build_graph(spark, a.root, a.out), f"{a.out}/watch-state", "3 seconds")
        q.awaitTermination()
        return "stopped"
    nodes, edges = store.frame("nodes"), store.frame("edges")
    engine = Engine(nodes, edges, store=store)
    if a.command == "query":
        return engine.ask(a.question)
    if a.command == "context":
        return engine.context(a.question, a.budget)
    if a.command == "impact":
        return shown(traverse.impact_listed(traverse.impact(nodes, edges, a.node, a.depth)).orderBy("place"))
    if a.command == "validate-import":
        return shown(engine.tool("validate_import", module=a.module, symbol=a.symbol))
    if a.command == "task-progress":
        return shown(engine.tool("get_task_progress", task=a.task))
    if a.command == "rules":
        content = spark.read.text(a.file, wholetext=True).first()
        return shown(engine.tool("get_applicable_rules", path=a.file, content=content.value if content else ""))
    if a.command == "benchmark":
        return shown(context.repository_benchmark(files.scan(spark, a.root, with_content=True).where(F.col("type").isin("code", "document")), nodes, edges))
    if a.command == "benchmark-suite":
        asked = files.questions(spark.read.text(a.questions, wholetext=True).withColumnRenamed("value", "content"))
        sizes = nodes.select("file").distinct().withColumn("tokens", F.lit(800).cast("long"))
        raw = {r.q: r.tokens for r in context.raw_tokens(asked.select(F.col("question").alias("q"), F.col("question").alias("text")).distinct(), nodes, sizes).collect()}
        rows = [(q, len(engine.ask(q)) // 4, raw[q]) for q in raw]
        return "\n".join(json.dumps({"question": q, "tokens": t, "raw_tokens": r, "saved_pct": round(max(0.0, (1 - t / r) * 100), 1)}, ensure_ascii=False) for q, t, r in rows)
    makers = {"graphml": sinks.graphml, "cypher": sinks.cypher, "canvas": sinks.canvas}
    if a.format == "html":
        Store(spark, a.path.rpartition("/")[0] or ".").write_text(a.path.rpartition("/")[2], sinks.html_view(nodes, edges))
    else:
        sinks.write_lines(makers[a.format](nodes, edges), a.path)
    return a.path


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    print(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
