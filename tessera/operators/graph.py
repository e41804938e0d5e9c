"""Analytics over a graph given as two frames: nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in_degree, out_degree and total of every node; 0 where it has no edge. One aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    counts = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.join(counts, "id", "left").withColumns({"in_degree": F.coalesce("in_degree", F.lit(0)), "out_degree": F.coalesce("out_degree", F.lit(0))}).withColumn("total", F.col("in_degree") + F.col("out_degree"))


def count_by(nodes: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """Nodes by a column; nulls under `missing`, or left out."""
    if missing is None:
        return nodes.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return nodes.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def top_by_degree(nodes: DataFrame, edges: DataFrame, n: int = 15, isolated: bool = False) -> DataFrame:
    """The n best connected nodes; those without edges only if asked for."""
    d = degrees(nodes, edges)
    return (d if isolated else d.where("total > 0")).orderBy(F.desc("total"), "id").limit(n).select("id", "label", "type", "in_degree", "out_degree", "total")


def top_external(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    used = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("uses"))
    return nodes.where("type = 'external'").join(used, "id").orderBy(F.desc("uses"), "id").limit(n).select("id", "label", "uses")


def isolated(nodes: DataFrame, edges: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """Nodes that no edge touches, but for some types."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()  # each task sends an end once
    return nodes.where(~F.col("type").isin(*without) if without else F.lit(True)).join(ends, "id", "left_anti").select("id", "type")


def community_rollup(nodes: DataFrame) -> DataFrame:
    """Size, files and first labels of each community."""
    first = F.array_join(F.slice(F.array_sort(F.collect_list("label")), 1, 8), ",")
    known = nodes.where("community is not null")
    few = known.withColumn("rn", F.row_number().over(W.partitionBy("community").orderBy("label"))).where("rn <= 8").groupBy("community").agg(first.alias("first_labels"))
    return known.groupBy("community").agg(F.count("*").alias("size"), F.countDistinct("file").alias("files")).join(few, "community")


def top_members(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("community").orderBy(F.desc("total"), "id"))
    return degrees(nodes, edges).where("community is not null").withColumn("rank", rank).where(F.col("rank") <= n).select("community", F.col("rank").cast("int").alias("rank"), "id", "total")


def community_texts(nodes: DataFrame) -> DataFrame:
    """community, summary: size, main type, first members (no externals) and file names of each community as a sentence."""
    known = nodes.where("community is not null")
    by_type = known.groupBy("community", "type").agg(F.count("*").alias("n"))
    main = by_type.groupBy("community").agg(F.sum("n").alias("n"), F.min_by("type", F.struct((-F.col("n")).alias("n"), "type")).alias("main"))
    listed = lambda df, c, order, most: df.withColumn("rn", F.row_number().over(W.partitionBy("community").orderBy(*order))).where(F.col("rn") <= most).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", c))), lambda x: x[c]), ", ").alias(f"{c}s"))
    labels = listed(known.where("type not in ('external', 'community')"), "label", ("label", "id"), 5)
    names = known.where("file is not null").select("community", F.element_at(F.split("file", "/"), -1).alias("name")).distinct()
    d = main.join(labels, "community", "left").join(listed(names, "name", ("name",), 4), "community", "left")
    more = F.when(F.col("n") > 5, F.concat(F.lit(" (+"), (F.col("n") - 5).cast("string"), F.lit(" more)"))).otherwise("")
    files = F.when(F.col("names").isNotNull(), F.concat(F.lit(" Files: "), "names", F.lit("."))).otherwise("")
    return d.select("community", F.concat(F.lit("Community "), F.col("community").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" nodes, primarily "), "main", F.lit("s. Members: "), F.coalesce("labels", F.lit("")), more, F.lit("."), files).alias("summary"))


def landmark_lines(nodes: DataFrame, edges: DataFrame, top: int = 25, budget: int = 14_000) -> DataFrame:
    """pos, line: the `top` best connected nodes, then one node for each community (the best not among them), as list items of at most
    `budget` characters in all."""
    d = degrees(nodes, edges)
    best = d.orderBy(F.desc("total"), "id").limit(top).withColumn("part", F.lit(0))
    rank = F.row_number().over(W.partitionBy("community").orderBy(F.desc("total"), "id"))
    rest = d.where("community is not null").join(F.broadcast(best.select("id")), "id", "left_anti").withColumn("rn", rank).where("rn = 1").drop("rn").withColumn("part", F.lit(1))
    chosen = best.unionByName(rest).orderBy("part", F.desc("total"), "id").limit(budget)  # a line has a character at least
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    line = F.concat(
        F.lit("- **"), F.coalesce("label", "id"), F.lit("**"), F.when(filled("file"), F.concat(F.lit(" `"), "file", F.lit("`"))).otherwise(""),
        F.lit(" ("), F.coalesce("type", F.lit("node")), F.lit(", degree "), F.col("total").cast("string"), F.lit(")"), F.when(filled("summary"), F.concat(F.lit(" — "), "summary")).otherwise(""),
    )
    order = W.orderBy("part", F.desc("total"), "id")  # at most `budget` rows
    out = chosen.withColumns({"pos": F.row_number().over(order), "line": line})
    return out.withColumn("used", F.sum(F.length("line")).over(W.orderBy("pos"))).where(F.col("used") <= budget).select("pos", "line")


def cross_community(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between two different known communities, but for imports of externals."""
    known = nodes.where("community is not null")
    s = known.select(F.col("id").alias("src"), F.col("community").alias("sc"))
    t = known.select(F.col("id").alias("dst"), F.col("community").alias("tc"), F.col("type").alias("dst_type"))
    inner = edges.join(t, "dst").where("not (relation = 'imports' and dst_type = 'external')")  # imports go before the second join
    return inner.join(s, "src").where("sc <> tc").select("sc", "tc", "src", "dst", "relation")


def module_rollup(nodes: DataFrame, labels: int = 5) -> DataFrame:
    """Per file: nodes, most frequent type (ties: first by name), first labels and how many more there are."""
    known = nodes.where("file is not null")
    by_type = known.groupBy("file", "type").agg(F.count("*").alias("n"))
    main = by_type.groupBy("file").agg(F.sum("n").alias("nodes"), F.min_by("type", F.struct((-F.col("n")).alias("n"), "type")).alias("main_type"))
    first = known.withColumn("rn", F.row_number().over(W.partitionBy("file").orderBy("label", "id"))).where(F.col("rn") <= labels)
    listed = first.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))
    return main.join(listed, "file").withColumn("more", F.greatest(F.col("nodes") - labels, F.lit(0)))


def neighbours(nodes: DataFrame, edges: DataFrame, node: str, incoming: bool) -> DataFrame:
    """Who depends on a node (incoming) or what it depends on."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    near = edges.where(F.col(here) == node).select(F.col(there).alias("id"), "relation")
    return near.join(nodes, "id").select("id", "label", "type", "relation")


def stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """External stand-ins for edge ends that no node has."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(nodes, "id", "left_anti").select("id", F.col("id").alias("label"), F.lit("external").alias("type"))


def merge_fragments(fragments: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One graph from fragments (id, label, type, file, lang, summary, community, ord): the first non-empty value of each attribute
    by ord wins; edges without ends, loops and repeats go; unknown ends become external stubs."""

    def first(column: str, empty: tuple[str, ...]) -> F.Column:
        fine = F.col(column).isNotNull() & ~F.col(column).cast("string").isin(*empty)
        return F.min_by(F.when(fine, F.col(column)), F.when(fine, F.col("ord"))).alias(column)

    merged = fragments.where("id is not null and id <> ''").groupBy("id").agg(first("label", ("",)), first("type", ("", "unknown")), first("file", ("",)), first("lang", ("",)), first("summary", ("",)), first("community", ("",)))
    merged = merged.withColumns({"label": F.coalesce("label", "id"), "type": F.coalesce("type", F.lit("unknown"))})
    fine = edges.withColumn("relation", F.coalesce("relation", F.lit("related"))).where("src <> '' and dst <> '' and src <> dst")
    kept = fine.dropDuplicates(["src", "dst", "relation"])
    extra = stubs(merged, fine)  # repeats are no new ends
    return merged.unionByName(extra, allowMissingColumns=True), kept


def diff_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """id and change (added, removed, changed) between two node frames; changed: another summary or type."""
    a = old.select("id", F.lit(True).alias("in_old"), F.col("summary").alias("s0"), F.col("type").alias("t0"))
    b = new.select("id", F.lit(True).alias("in_new"), F.col("summary").alias("s1"), F.col("type").alias("t1"))
    same = F.col("s0").eqNullSafe(F.col("s1")) & F.col("t0").eqNullSafe(F.col("t1"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~same, "changed")
    return a.join(b, "id", "full_outer").select("id", change.alias("change")).where("change is not null")


def diff_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    key = ["src", "dst", "relation"]
    added = new.select(*key).distinct().join(old, key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.select(*key).distinct().join(new, key, "left_anti").withColumn("change", F.lit("removed")))


def project(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """nodes of representatives put down for their duplicates: pairs (file, old, new) say which file stands for one, and the stems."""
    text = [f.name for f in nodes.schema if f.dataType.simpleString() == "string"]
    out = nodes.join(pairs, "file")
    return out.select(*(F.replace(c, F.col("old"), F.col("new")).alias(c) if c in text else c for c in nodes.columns))
