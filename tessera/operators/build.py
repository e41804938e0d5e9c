"""From a folder of files to a graph: list, parse what changed, merge, enrich, cluster, compare, write."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as source
from ..sources import sinks
from ..sources.store import Store
from . import communities, fragments, git, graph, increment, packages
from .keep import keep


@dataclass
class Build:
    nodes: DataFrame
    edges: DataFrame
    skipped: bool = False
    counts: dict = field(default_factory=dict)


def is_unchanged(root: str, store: Store, force: bool = False) -> bool:
    """Whether the tree is clean and its last commit not younger than the graph that is there."""
    status, when = source.git(root, "status", "--short"), source.git(root, "log", "-1", "--format=%ct")
    return status is not None and git.unchanged(not status.strip(), store.modified("nodes"), float(when) if when and when.strip() else None, force)


def build_graph(spark: SparkSession, root: str, out: str, extract: Callable | None = None, force: bool = False, viz: bool = True, threshold: float = 0.05, only_named: bool = False) -> Build:
    """Builds the graph of a folder into `out`: tables nodes and edges, last_diff, node-link JSON, a report, a page, the status.

    Only files that changed since the build before are read, and only contents not seen under their path are parsed; force parses all.
    only_named: looks at no other files than those that the working tree names as changed or untracked, where it can say so.
    """
    store = Store(spark, out)
    old = (store.frame("nodes"), store.frame("edges")) if store.exists("nodes") and store.exists("edges") else None
    if old and is_unchanged(root, store, force):
        return Build(*old, skipped=True)
    started = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    store.write_status("building", 0, 1, started, "parsing")
    named = source.git(root, "status", "--porcelain", "--untracked-files=all") if only_named and not force else None
    if force:
        increment.reset(store)
    only = None if named is None or not store.exists("sources") else git.changed(spark.createDataFrame([(named,)], "content string"))
    change = increment.update(store, root, extract, force, only)
    return finish(store, started, change, old, viz, threshold)


def finish(store: Store, started: str, change: increment.Change, old: tuple[DataFrame, DataFrame] | None, viz: bool = True, threshold: float = 0.05) -> Build:
    """The store's merged graph as the current one: clustered, compared with the one before, written in all forms."""
    spark, out = store.spark, store.root
    nodes, edges = increment.settle(store)
    nodes, edges = keep(nodes, "nodes"), keep(edges, "edges")
    if old:
        known = old[0].select("id", F.col("community").alias("before"))
        nodes = nodes.join(known, "id", "left").withColumn("community", F.coalesce("community", "before")).drop("before")
    nodes = keep(communities.cluster(nodes, edges, old[0].count() if old else None, threshold), "nodes")
    before = old or (nodes.limit(0), edges.limit(0))
    changes, moved = graph.diff_nodes(before[0], nodes), graph.diff_edges(before[1], edges)
    store.save_diff(keep(changes), keep(moved))
    store.replace("nodes", nodes)
    store.replace("edges", edges)
    nodes, edges = store.frame("nodes"), store.frame("edges")
    sinks.node_link(nodes, edges, f"{out}/graph.json")
    total = increment.sources(store).where("not generated").count()
    counts = {"files": total, "read": change.read, "parsed": change.parsed, "nodes": nodes.count(), "edges": edges.count(), "communities": nodes.select("community").distinct().count()}
    report = {"Counts": spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts)), "Nodes by type": graph.count_by(nodes, "type", "unknown"), "Best connected": graph.top_by_degree(nodes, edges), "Externals": graph.top_external(nodes, edges)}
    store.write_text("GRAPH_REPORT.md", sinks.markdown_report(report))
    if viz:
        store.write_text("graph.html", sinks.html_view(nodes, edges))
    store.write_status("complete", total, total, started, "build complete")
    return Build(nodes, edges, counts=counts)


def build_packages(files: DataFrame, parsers: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes and edges of files (path, content) with the package they belong to, and the edges across packages. Packages are a column of
    one build, not a build each."""
    own = keep(packages.with_package(files, packages.roots(files)))
    found = fragments.parse(own, parsers).bare()
    where = own.select(F.col("path").alias("file"), "package")
    nodes = found.nodes.join(where, "file")
    edges = found.edges.join(nodes.select(F.col("id").alias("src"), "package"), "src")
    return nodes, edges, packages.cross_edges(own)
