"""Communities by modularity: parallel local moving on frames, level by level, with or without a refinement, and the measure itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .keep import discard, keep, ranked
from .traverse import coded, connected_components, decoded


def modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, q: modularity of members (id, community) under undirected edges (src, dst); loops don't count, repeats count each."""
    e = edges.where("src <> dst").select("src", "dst")
    c = members.select("id", "community")
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("k")).join(c, "id").groupBy("community").agg(F.sum("k").alias("degree"))
    inside = e.join(c.withColumnsRenamed({"id": "src", "community": "a"}), "src").join(c.withColumnsRenamed({"id": "dst", "community": "b"}), "dst").where("a = b").groupBy(F.col("a").alias("community")).agg((2 * F.count("*")).alias("inside"))
    total = e.agg((2 * F.count("*")).alias("two_m"))  # one row
    each = ends.join(inside, "community", "left").crossJoin(F.broadcast(total))
    return each.agg(F.coalesce(F.sum(F.coalesce("inside", F.lit(0)) / F.col("two_m") - F.pow(F.col("degree") / F.col("two_m"), F.lit(2))), F.lit(0.0)).alias("q"))


def _dealt(links: DataFrame) -> DataFrame:
    """Links between different nodes, cached as they are dealt by their other end and sorted, so that no round deals them again. `unpersist` frees them."""
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, -(-links.count() // 500_000))
    out = links.where("a <> b").repartition(tasks, "b").sortWithinPartitions("b").persist()
    out.count()  # a plan knows how cached rows are dealt when they are there
    return out


def _choices(dealt: DataFrame, own: DataFrame, two_m: float) -> tuple[DataFrame, tuple]:
    """id, c, k, total, to, inside of each node of own (id, c, k: its degree): its community's degree, the neighbouring community of the
    highest gain, if it gains over staying (else c), and its links into c. Then sums that the write itself takes: links inside, degrees
    times their community's, nodes that would move. Only what links tell of their other end is shuffled, to the node."""
    placed = keep(own.join(own.groupBy("c").agg(F.sum("k").alias("total")), "c").select("id", "c", "k", "total"), "placed")
    there = placed.select(F.col("id").alias("b"), F.col("c").alias("to"), F.col("total").alias("there"))
    near = dealt.join(there, "b").select(F.col("a").alias("id"), "to", "there", "w").repartition("id")
    into = near.groupBy("id", "to").agg(F.sum("w").alias("w"), F.first("there").alias("there"))
    gain = into.join(placed, "id").withColumn("gain", F.col("w") - F.col("k") * (F.col("there") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)) / two_m)
    at_home = lambda x: F.max(F.when(F.col("to") == F.col("c"), F.col(x)))
    best = gain.groupBy("id").agg(F.max_by(F.struct("gain", "to"), F.struct("gain", (-F.xxhash64("to")).alias("tie"), "to")).alias("best"), at_home("gain").alias("stay"), at_home("w").alias("inside"))
    every = placed.join(best, "id", "left").withColumn("stay", F.coalesce("stay", -F.col("k") * (F.col("total") - F.col("k")) / two_m))
    to = F.when(F.col("best.gain") > F.col("stay") + 1e-9, F.col("best.to")).otherwise(F.col("c"))
    out, seen = every.select("id", "c", "k", "total", to.alias("to"), F.coalesce("inside", F.lit(0.0)).alias("inside")), Observation()
    out = keep(out.observe(seen, F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("total")).alias("spread"), F.count_if(F.col("to") != F.col("c")).alias("movers")), "choices")
    discard(placed)
    return out, (seen.get["inside"] or 0.0, seen.get["spread"] or 0.0, seen.get["movers"])


def _moved(choices: DataFrame, turn: int, free: str = "true") -> DataFrame:
    """id, c, k after the free nodes whose turn it is went where they chose. Turns 2i and 2i + 1 are the two halves of one draw."""
    mine = F.pmod(F.xxhash64("id", F.lit(turn // 2)) + F.lit(turn), F.lit(2)) == 0
    return choices.select("id", F.when(mine & F.expr(free), F.col("to")).otherwise(F.col("c")).alias("c"), "k")


def _links(edges: DataFrame) -> DataFrame:
    """a, b, w: both directions of the edges between different nodes, with how many there are."""
    flat = edges.where("src <> dst")
    return keep(flat.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(flat.select(F.col("dst").alias("a"), F.col("src").alias("b"))).groupBy("a", "b").agg(F.count("*").cast("double").alias("w")), "links")


def _local_moving(links: DataFrame, dealt: DataFrame, start: DataFrame, two_m: float, rounds: int, seed: int) -> DataFrame:
    """id, c: the best state by modularity of some rounds from the start (id, c, k). A round that gains nothing has tried half of the nodes only,
    or neighbours have swapped, so the next ones begin from the best state again; they end early when no node of it would gain by a
    move. A round's choices tell the modularity it begins with."""
    loops = links.where("a = b").agg(F.sum("w")).first()[0] or 0.0
    q_of = lambda inside, spread: (inside + loops) / two_m - spread / two_m**2
    best, (*sums, movers) = _choices(dealt, start, two_m)
    best_q = q_of(*sums)
    for turn in range(seed, seed + rounds):
        if not movers:
            break
        now, (*sums, more) = _choices(dealt, _moved(best, turn), two_m)
        q = q_of(*sums)
        if q > best_q + 1e-12:
            discard(best)
            best, best_q, movers = now, q, more
        else:
            discard(now)
    return best.select("id", "c")


def _grown(links: DataFrame, name: DataFrame) -> DataFrame:
    """Links between what nodes (id) are merged into (to)."""
    to = lambda side: name.select(F.col("id").alias(side), F.col("to").alias(f"{side}2"))
    return keep(links.join(to("a"), "a").join(to("b"), "b").groupBy(F.col("a2").alias("a"), F.col("b2").alias("b")).agg(F.sum("w").alias("w")), "links")


def louvain(ids: DataFrame, edges: DataFrame, levels: int = 3, rounds: int = 6) -> DataFrame:
    """id, community (its smallest id). Each level moves nodes between communities for some rounds, half of the nodes at a time so that
    neighbours don't swap, keeps the best state by modularity, and merges each community into one node for the next. Levels end when
    nothing gains; what a round needs are joins and aggregations on keys of nodes. Texts are numbered first. A community need not be
    connected: see `leiden`.
    """
    if dict(ids.dtypes)["id"] == "string":
        names, some, numbered = coded(ids, edges)
        return decoded(louvain(some, numbered, levels, rounds), names, "community")
    links = _links(edges)
    result = keep(ids.select("id", F.col("id").alias("community")))
    two_m = links.agg(F.sum("w")).first()[0]
    for level in range(levels if two_m else 0):
        degree = keep(links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")), "degree")
        dealt = _dealt(links)
        best = _local_moving(links, dealt, degree.select("id", F.col("id").alias("c"), "k"), two_m, rounds, level * rounds)
        dealt.unpersist()
        name = keep(best.join(best.groupBy("c").agg(F.min("id").alias("to")), "c").select("id", "to"), "names")
        old, result = result, keep(result.join(name.withColumnRenamed("id", "community"), "community", "left").select("id", F.coalesce("to", "community").alias("community")))
        grown = _grown(links, name)
        done = name.where("id <> to").isEmpty()
        discard(old, links, degree, name)
        links = grown
        if done:
            break
    return result


def _inside(links: DataFrame, own: DataFrame) -> DataFrame:
    """Links between different nodes of one community of own (id, c)."""
    of = lambda side: own.select(F.col("id").alias(side), F.col("c").alias(f"c{side}"))
    return links.where("a <> b").join(of("b"), "b").join(of("a"), "a").where("ca = cb").drop("ca", "cb")


def connected_parts(links: DataFrame, own: DataFrame) -> DataFrame:
    """id, c: every community of own (id, c) cut into its connected parts by links (a, b; one direction is enough), each named by its smallest id."""
    inside = _inside(links.select("a", "b"), own).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return connected_components(own.select("id"), inside).select("id", F.col("component").alias("c"))


def _refined(dealt: DataFrame, own: DataFrame, degree: DataFrame, two_m: float, rounds: int, seed: int) -> DataFrame:
    """id, c: a finer state than own, each part connected. Every node starts alone and may join a part of its own community once, if that
    gains and nobody has joined it, so that its part's degree is its own."""
    inside = keep(_inside(dealt, own).select("a", "b", "w"), "inside")
    near = _dealt(inside)
    now = keep(degree.select("id", F.col("id").alias("c"), "k"), "refined")
    for turn in range(rounds):
        choices, _ = _choices(near, now, two_m)
        old, now = now, keep(_moved(choices, seed + turn, "total = k"), "refined")
        discard(old, choices)
    near.unpersist()
    out = keep(connected_parts(inside.where("a < b"), now), "refined")
    discard(inside, now)
    return out


def leiden(ids: DataFrame, edges: DataFrame, levels: int = 2, rounds: int = 6, refining: int = 2, start: DataFrame | None = None) -> DataFrame:
    """id, community (its smallest id); every community is connected, and the modularity is at least that of `louvain`.

    From what local moving finds, a level's communities are not merged as wholes: nodes move once more, then each community is refined into
    connected parts, the parts become the nodes of the next level, and they begin there in the community they came from. So a part that
    was merged wrongly can leave again. A level keeps its best state, its start included, and what is found at the end is cut into connected
    parts, so neither can lower the modularity. start: communities (id, community) to begin with, in place of those of local moving.
    Texts are numbered first.
    """
    if dict(ids.dtypes)["id"] == "string":
        names, some, numbered = coded(ids, edges)
        if start is not None:
            held = start.join(names, "id").select(F.col("code").alias("id"), F.col("community").alias("name"))
            start = held.join(held.groupBy("name").agg(F.min("id").alias("community")), "name").select("id", "community")
        return decoded(leiden(some, numbered, levels, rounds, refining, start), names, "community")
    links = first = _links(edges)
    two_m = links.agg(F.sum("w")).first()[0]
    if not two_m:
        return ids.select("id", F.col("id").alias("community"))
    inner = keep(links.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("node")), "nodes")
    own = (louvain(ids, edges) if start is None else start).join(inner.select("id"), "id", "left_semi").select("id", F.col("community").alias("c"))
    for level in range(levels):
        degree = keep(links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")), "degree")
        dealt = _dealt(links)
        own = keep(_local_moving(links, dealt, own.join(degree, "id"), two_m, rounds, level * (rounds + refining)), "own")
        if level == levels - 1:  # nothing is left that a refinement would serve
            dealt.unpersist()
            break
        name = _refined(dealt, own, degree, two_m, refining, level * (rounds + refining) + rounds).select("id", F.col("c").alias("to"))
        dealt.unpersist()
        if name.where("id <> to").isEmpty():
            break
        old, inner = inner, keep(inner.join(name.withColumnRenamed("id", "node"), "node").select("id", F.col("to").alias("node")), "nodes")
        own = keep(own.join(name, "id").groupBy(F.col("to").alias("id")).agg(F.min("c").alias("c")), "own")
        grown = _grown(links, name)
        discard(old, degree, *([links] if links is not first else []))
        links = grown
    found = inner.join(own.withColumnRenamed("id", "node"), "node").select("id", "c")
    parts = keep(connected_parts(first.where("a < b"), keep(found, "found")), "communities")
    return ids.join(parts, "id", "left").select("id", F.coalesce("c", "id").alias("community"))


def split_communities(members: DataFrame, edges: DataFrame) -> DataFrame:
    """community, parts of the communities of members (id, community) that aren't connected within themselves."""
    own = keep(members.select("id", F.col("community").alias("c")))
    parts = connected_parts(edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")), own).withColumnRenamed("c", "part")
    return own.join(parts, "id").groupBy(F.col("c").alias("community")).agg(F.countDistinct("part").alias("parts")).where("parts > 1")


def cluster(nodes: DataFrame, edges: DataFrame, previous: int | None = None, threshold: float = 0.05) -> DataFrame:
    """nodes with communities numbered from 0 by size. With the node count of the build before, a graph that changed by less than
    `threshold` and has communities keeps them."""
    if previous:
        seen = nodes.agg(F.count("*"), F.count("community")).first()
        if seen[1] and abs(seen[0] - previous) / previous < threshold:
            return nodes
    found = leiden(nodes.select("id"), edges)
    sizes = found.groupBy("community").agg(F.count("*").alias("n"))
    number = ranked(sizes, F.desc("n"), F.col("community"), name="number").select("community", F.col("number").cast("int").alias("number"))
    return nodes.drop("community").join(found.join(number, "community").select("id", F.col("number").alias("community")), "id", "left").select(*nodes.columns)
