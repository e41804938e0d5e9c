"""Traversals: frontier joins, a level at a time. A level joins the new frontier with the edges and drops what was seen before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .keep import discard, keep_marked, ranked
from .keep import keep as put_aside

#: Levels that a plan may hold unrolled; beyond it each level is written, as plans double with each.
UNROLLED = 3


def reverse_bfs(edges: DataFrame, start: DataFrame, depth: int = 3, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id, hop of everything that depends on the ids in start, at the first hop that reaches it (start itself not included).

    keep: how a level is put aside between hops; by default not at all up to UNROLLED hops, else written to the shared folder.
    """
    if keep is None and depth > UNROLLED:
        keep = put_aside
    seen = start.select("id", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, depth + 1):
        near = edges.join(frontier.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
        frontier = near.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))
        if keep:
            frontier = keep(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def impact(nodes: DataFrame, edges: DataFrame, target: str, depth: int = 3, frequencies: DataFrame | None = None) -> DataFrame:
    """Risk of each dependent: nearness, in-degree share, change frequency share, and another community than the target's."""
    reached = reverse_bfs(edges, nodes.where(F.col("id") == target).select("id"), depth, put_aside)  # each hop goes over the edges once
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))  # the other end's degrees are not asked for
    d = put_aside(nodes.join(into, "id", "left").select("id", F.coalesce("in_degree", F.lit(0).cast("long")).alias("in_degree"), "file", "community"))
    most = d.agg(F.greatest(F.max("in_degree"), F.lit(1)).alias("most"))
    home = nodes.where(F.col("id") == target).select(F.col("community").alias("home"))
    out = reached.join(d, "id").crossJoin(F.broadcast(most)).crossJoin(F.broadcast(home))  # both single rows
    git = F.lit(0.0)
    if frequencies is not None:
        top = frequencies.agg(F.max("n").alias("top"))
        out = out.join(frequencies, "file", "left").crossJoin(F.broadcast(top))
        git = F.coalesce(F.col("n") / F.col("top"), F.lit(0.0))
    other = F.when(F.col("community").isNotNull() & F.col("home").isNotNull() & (F.col("community") != F.col("home")), 0.1).otherwise(0.0)
    risk = F.lit(0.4) / F.col("hop") + F.lit(0.3) * F.least(F.col("in_degree") / F.col("most"), F.lit(1.0)) + F.lit(0.2) * git + other
    return out.select("id", "hop", "in_degree", F.round(F.least(risk, F.lit(1.0)), 4).alias("risk"))


def impact_listed(scores: DataFrame, most: int = 100, each_hop: int = 15) -> DataFrame:
    """The `most` scores of highest risk (then nearest, then by id) with their place, and place_in_hop where they are among a hop's
    first `each_hop`."""
    best = scores.orderBy(F.desc("risk"), "hop", "id").limit(most)
    place = F.row_number().over(W.orderBy(F.desc("risk"), "hop", "id"))  # at most `most` rows
    within = F.row_number().over(W.partitionBy("hop").orderBy(F.desc("risk"), "id"))
    return best.withColumns({"place": place, "in_hop": within}).withColumn("in_hop", F.when(F.col("in_hop") <= each_hop, F.col("in_hop")))


def impact_rollup(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("affected"),
        F.max("risk").alias("max_risk"),
        F.count_if(F.col("risk") >= 0.7).alias("high"),
        F.count_if((F.col("risk") >= 0.4) & (F.col("risk") < 0.7)).alias("medium"),
        F.count_if(F.col("risk") < 0.4).alias("low"),
    )


def khop(edges: DataFrame, seeds: DataFrame, k: int = 1, enough: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id, hop of everything within k undirected hops of the seeds, seeds included. No further hop once `enough` ids are reached.

    keep: how a level is put aside between hops; by default not at all for one hop, else written to the shared folder.
    """
    keep = keep or (put_aside if k > 1 else None)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = seeds.select("id", F.lit(0).alias("hop")).distinct()
    frontier = seen = keep(seen) if keep else seen
    for hop in range(1, k + 1):
        near = both.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = near.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))
        frontier = keep(frontier) if keep else frontier
        seen = seen.unionByName(frontier)
        if hop < k and (frontier.isEmpty() or (enough is not None and seen.count() >= enough)):
            break
    return seen


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among the chosen ids."""
    ids = chosen.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "relation")


def shortest_path(edges: DataFrame, source: str, target: str, most: int = 8) -> DataFrame:
    """source, target, hop, path (ids) of a shortest directed path within `most` hops, the first by its ids; no row if there is none.

    Each level keeps, for every id, the one it is reached from (of several the smallest), so rows don't grow with the paths.
    """
    spark = edges.sparkSession
    seen = put_aside(spark.createDataFrame([(source, None, 0)], "id string, via string, hop int"))
    frontier, steps = seen, edges.where("src <> dst").select("src", "dst")
    for hop in range(1, most + 1):
        if not seen.where(F.col("id") == target).isEmpty():
            break
        near = steps.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("via"))
        frontier = put_aside(near.join(seen, "id", "left_anti").select("id", "via", F.lit(hop).alias("hop")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    schema, path, at = "source string, target string, hop int, path array<string>", [], target
    while at is not None:  # at most `most` lookups
        row = seen.where(F.col("id") == at).first()
        if row is None:
            return spark.createDataFrame([], schema)
        path, at = [at, *path], row.via
    return spark.createDataFrame([(source, target, len(path) - 1, path)], schema)


def coded(ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """names (id, code) of all ids and ends of edges, ids and edges (src <> dst) by code: numbers in the order of the names, so the smallest
    code is the smallest name. Rounds then shuffle and compare numbers."""
    pairs = put_aside(edges.where("src <> dst").select("src", "dst"))
    every = put_aside(ids.select("id").unionByName(pairs.select(F.col("src").alias("id"))).unionByName(pairs.select(F.col("dst").alias("id"))).where("id is not null").distinct())
    names = put_aside(ranked(every, "id", name="code"))
    src, dst = names.toDF("src", "u"), names.toDF("dst", "v")
    links = put_aside(pairs.join(src, "src").select("u", "dst").join(dst, "dst").select(F.col("u").alias("src"), F.col("v").alias("dst")))
    discard(pairs, every)
    return names, put_aside(ids.join(names, "id").select(F.col("code").alias("id"))), links


def decoded(found: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """found (id, name), both codes, as names."""
    by = found.join(names.toDF("_name", name), name).select(F.col("id").alias("code"), F.col("_name").alias(name))
    return by.join(names, "code").select("id", name)


def connected_components(ids: DataFrame, edges: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id, component (smallest id of the undirected component). Alternating large-star and small-star rounds, to the fixed point; each
    round is written, and the write itself says whether anything changed. Texts are numbered first. `keep` is not needed any more."""
    if dict(ids.dtypes)["id"] == "string":
        names, some, links = coded(ids, edges)
        return decoded(connected_components(some, links), names, "component")
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, mark = keep_marked(pairs, "u", "v")
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        old, before = now, mark
        now, mark = keep_marked(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "u", "v")
        discard(old)
        if mark == before:
            break
    return ids.join(now.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def label_propagation(ids: DataFrame, edges: DataFrame, keep: Callable[[DataFrame], DataFrame], rounds: int = 5) -> DataFrame:
    """id, community: each round every node takes the label most of its neighbours have (ties: the smallest), its own one counting once.
    Texts are numbered first."""
    if dict(ids.dtypes)["id"] == "string":
        names, some, links = coded(ids, edges)
        return decoded(label_propagation(some, links, keep, rounds), names, "community")
    both = keep(edges.where("src <> dst").select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").distinct())
    labels = ids.select("id", F.col("id").alias("community"))
    for _ in range(rounds):
        votes = both.join(labels, F.col("dst") == F.col("id")).select(F.col("src").alias("id"), "community").unionByName(labels)
        counted = votes.groupBy("id", "community").agg(F.count("*").alias("n"))
        labels = keep(counted.groupBy("id").agg(F.min_by("community", F.struct((-F.col("n")).alias("n"), "community")).alias("community")))
    return labels
