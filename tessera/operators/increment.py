"""Delta maintenance of a graph: files are parsed once for each content, and what they gave is kept by path and hash.

A store holds what every parsed file gave (fragment tables, appended only), which content a path has now (`sources`) and the graph merged
from it. An update lists the files, reads those whose length or time differ, parses those whose content was never parsed under
their path, and merges anew only the ids and edges that the old or the new content of a changed file names; all others are carried over. So
the work of parsing follows the change, and the result is what a build from nothing gives.

Rows appended twice (a retried batch, a crash between two writes) do no harm: merging takes minima and distinct edges.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..sources import files as source
from ..sources.store import SCHEMAS, Store
from . import fragments, graph, parse, types
from .keep import keep

SOURCES = "path string, length long, modified timestamp, hash string, generated boolean"
#: Changed files that are named to the reader one by one; more of them are found by a join over the whole folder.
NAMED = 1000


@dataclass
class Change:
    """What an update did: files listed, read, parsed (never seen with this content), removed."""

    files: int
    read: int
    parsed: int
    removed: int


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def sources(store: Store) -> DataFrame:
    found = store.frame("sources")
    return _empty(store.spark, SOURCES) if found is None else found


def _contents(spark: SparkSession, root: str, stale: DataFrame) -> DataFrame:
    """path (below root), length, modified, content of the stale files (path, full)."""
    named = [r.full for r in stale.select("full").limit(NAMED + 1).collect()]
    if not named:
        return _empty(spark, "path string, length long, modified timestamp, content string")
    if len(named) <= NAMED:
        found = source.decoded(spark.read.format("binaryFile").load(named).select("path", "length", F.col("modificationTime").alias("modified"), "content"))
    else:
        found = source.scan(spark, root, with_content=True).join(stale.select(F.col("full").alias("path")), "path", "left_semi").select("path", "length", "modified", "content")
    return found.withColumn("path", source.below(F.col("path"), root))


def _extracted(files: DataFrame, extract: Callable[[DataFrame], fragments.Fragments] | None, store: Store) -> fragments.Fragments:
    """Fragments of files that no parser knows: stubs, or what `extract` gives. What it gave for a content is kept, so equal content under
    the same path is not sent to it again, even by a forced build."""
    if extract is None:
        return fragments.stub(files)
    known, new = store.cached_extractions(files, "path")
    given = extract(keep(new, "asked"))
    owner = lambda df, c: df if "origin" in df.columns else df.withColumn("origin", c)
    nodes, edges = owner(given.nodes, F.col("file")), owner(given.edges, F.substring_index("src", "::", 1))
    row = "struct<nodes:array<struct<{}>>,edges:array<struct<{}>>>".format(",".join(f"{c}:string" for c in fragments.NODE), ",".join(f"{c}:string" for c in fragments.EDGE))
    listed = nodes.groupBy("origin").agg(F.collect_list(F.struct(*fragments.NODE)).alias("nodes")).join(edges.groupBy("origin").agg(F.collect_list(F.struct(*fragments.EDGE)).alias("edges")), "origin", "full")
    made = new.select("hash", "path").join(listed.withColumnRenamed("origin", "path"), "path", "left")
    store.save_extractions(made.select("hash", "path", F.to_json(F.struct("nodes", "edges")).alias("extraction")))
    known, _ = store.cached_extractions(files, "path")
    held = known.select(F.col("path").alias("origin"), F.from_json("extraction", row).alias("x"))
    open_ = lambda part: held.select("origin", F.inline(f"x.{part}"))
    return fragments.Fragments(open_("nodes").select(*fragments.NODE, "origin"), open_("edges").select(*fragments.EDGE, "origin"))


def parse_into(store: Store, changed: DataFrame, extract: Callable | None = None) -> int:
    """Parses changed files (path, hash, content) whose content the store doesn't know under their path, and keeps what they gave."""
    known = store.read("parsed").select(F.col("origin").alias("path"), "hash").distinct()
    new = keep(changed.select("path", "hash", "content").join(known, ["path", "hash"], "left_anti"), "new-files")
    n = new.count()
    if not n:
        return 0
    named = new.drop("hash")
    has_parser = fragments.kind(F.col("path")).isNotNull()
    found = fragments.parse(named.where(has_parser)) + _extracted(named.where(~has_parser), extract, store)
    code_files = named.where(fragments.is_code(F.col("path")))
    docs = parse.docstrings(code_files, code.language(F.col("path"))).withColumnRenamed("path", "origin")
    of = new.select(F.col("path").alias("origin"), "hash")
    for name, rows in (("fragment_nodes", found.nodes), ("fragment_edges", found.edges), ("fragment_docs", docs), ("fragment_types", types.harvest(code_files))):
        store.append(name, rows.join(of, "origin").withColumn("ts", F.lit(None).cast("timestamp")))
    store.append("parsed", of.withColumn("ts", F.lit(None).cast("timestamp")))
    return n


def current(store: Store, name: str, paths: DataFrame) -> DataFrame:
    """Rows of a fragment table that the contents in paths (path, hash) gave."""
    return store.read(name).join(paths.select(F.col("path").alias("origin"), "hash"), ["origin", "hash"], "left_semi")


def _merge_nodes(found: DataFrame) -> DataFrame:
    first = F.concat_ws("|", F.coalesce("file", F.lit("~")), F.coalesce("summary", F.lit("")))
    merged, _ = graph.merge_fragments(found.withColumns({"community": F.lit(None).cast("int"), "ord": first}), _empty(found.sparkSession, "src string, dst string, relation string"))
    return merged


def _merge_edges(found: DataFrame) -> DataFrame:
    return found.select(*fragments.EDGE).withColumn("relation", F.coalesce("relation", F.lit("related"))).where("src <> '' and dst <> '' and src <> dst").distinct()


def merge_delta(store: Store, before: DataFrame, now: DataFrame) -> None:
    """Brings the merged graph from the sources before to those now (path, hash): touched ids and edges are merged anew, the rest stays."""
    live = now.where("not generated")
    was = before.where("not generated")
    gone = was.select("path", "hash").join(live.select("path", "hash"), ["path", "hash"], "left_anti")
    came = live.select("path", "hash").join(was.select("path", "hash"), ["path", "hash"], "left_anti")
    moved = keep(gone.unionByName(came), "moved")
    ids = keep(current(store, "fragment_nodes", moved).select("id").distinct(), "ids")
    keys = keep(_merge_edges(current(store, "fragment_edges", moved)), "keys")
    nodes, edges = store.frame("merged_nodes"), store.frame("merged_edges")
    fresh = _merge_nodes(current(store, "fragment_nodes", live).join(ids, "id", "left_semi"))
    links = _merge_edges(current(store, "fragment_edges", live)).join(keys, list(fragments.EDGE), "left_semi")
    store.replace("merged_nodes", fresh if nodes is None else nodes.join(ids, "id", "left_anti").unionByName(fresh))
    store.replace("merged_edges", links if edges is None else edges.join(keys, list(fragments.EDGE), "left_anti").unionByName(links))


def settle(store: Store) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of the merged graph: with stubs for unknown ends, docstrings and type signatures in the summaries."""
    live = sources(store).where("not generated")
    nodes, edges = store.frame("merged_nodes"), store.frame("merged_edges")
    nodes = nodes.unionByName(graph.stubs(nodes, edges), allowMissingColumns=True)
    nodes = parse.enrich(nodes, current(store, "fragment_docs", live).select(F.col("origin").alias("path"), "name", "doc"))
    return types.enrich(nodes, types.settled(current(store, "fragment_types", live), live)), edges


def apply(store: Store, changed: DataFrame, removed: DataFrame, extract: Callable | None = None) -> int:
    """Takes changed files (path, length, modified, content) and removed ones (path) into the graph; gives how many were parsed."""
    before = keep(sources(store), "sources")
    generated = parse.is_generated(F.col("path"), F.col("content"))
    read = keep(changed.select("path", "length", "modified", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("hash"), F.coalesce(generated, F.lit(False)).alias("generated"), F.coalesce("content", F.lit("")).alias("content")), "read")
    n = parse_into(store, read.where("not generated"), extract)
    rest = before.join(read.select("path").unionByName(removed.select("path")).distinct(), "path", "left_anti")
    now = keep(rest.unionByName(read.drop("content")), "sources")
    merge_delta(store, before, now)
    store.replace("sources", now)
    return n


def update(store: Store, root: str, extract: Callable | None = None, force: bool = False, only: DataFrame | None = None) -> Change:
    """Brings the store's graph to what is below root now. A file of the length and time it had is not read, unless forced; only: changes
    (path, state) that say which files to look at, as a working tree names them."""
    spark = store.spark
    before = sources(store)
    listed = source.scan(spark, root).select(F.col("path").alias("full"), source.below(F.col("path"), root).alias("path"), "length", "modified")
    listed = keep(listed, "listed")
    stale = listed if force else listed.join(before.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")
    if only is not None:
        stale = stale.join(only.where("state <> 'deleted'").select("path").distinct(), "path", "left_semi")
    stale = keep(stale, "stale")
    removed = keep(before.join(listed.select("path"), "path", "left_anti").select("path"), "removed")
    change = Change(listed.count(), stale.count(), 0, removed.count())
    if change.read or change.removed or store.frame("merged_nodes") is None:
        change.parsed = apply(store, _contents(spark, root, stale), removed, extract)
    return change


def reset(store: Store) -> None:
    """Forgets what files gave, so that all are parsed again; what a model extracted stays."""
    for name in ("fragment_nodes", "fragment_edges", "fragment_docs", "fragment_types", "parsed"):
        if store.exists(name):
            store.replace(name, _empty(store.spark, SCHEMAS[name]))
    for name in ("merged_nodes", "merged_edges", "sources"):
        if store.exists(name):
            store.replace(name, store.frame(name).limit(0))


def rebuilt(store: Store) -> None:
    """The merged graph anew from all fragments, as a check or after a loss."""
    now = keep(sources(store), "sources")
    for name in ("merged_nodes", "merged_edges"):
        frame = store.frame(name)
        if frame is not None:
            store.replace(name, frame.limit(0))
    merge_delta(store, now.limit(0), now)


def forget_old(store: Store) -> None:
    """Drops what contents gave that no path has now."""
    live = keep(sources(store).select(F.col("path").alias("origin"), "hash"), "live")
    for name in ("fragment_nodes", "fragment_edges", "fragment_docs", "fragment_types", "parsed"):
        store.replace(name, store.read(name).join(live, ["origin", "hash"], "left_semi"))
