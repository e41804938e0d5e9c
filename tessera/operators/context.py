"""Answers from a graph: relevant subgraphs, context lines under a token budget, local answers, what reading raw files would cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text
from ..functions.code import base_name
from . import traverse
from .graph import degrees

NODES_MOST, TOKENS_A_NODE, HEADER, LEAST_NODES = 60, 25, 20, 5
#: What reading without knowing where costs, in tokens.
BLIND = 2000


def seeds(nodes: DataFrame, words: list[str], most: int = 20) -> DataFrame:
    """id, score: for each word 3 if the label has it, else 2 for the file, else 1 for the summary; the best `most`."""
    has = lambda c, w: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(w))
    points = lambda w: F.when(has("label", w), 3).when(has("file", w), 2).when(has("summary", w), 1).otherwise(0)
    score = sum((points(w.lower()) for w in words), F.lit(0))
    return nodes.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(most)


def relevance(nodes: DataFrame, edges: DataFrame, near: DataFrame, embeddings: DataFrame | None = None, git: DataFrame | None = None) -> DataFrame:
    """nodes within `near` (id, hop; hop 0: seeds) with their degree and score: 0.5 for seeds, 0.4 of the embedding's similarity, 0.4
    of the degree's share of the highest, 0.2 of the git score. embeddings, git: id, score."""
    d = degrees(nodes, edges).join(near, "id")
    for name, frame in (("embedding", embeddings), ("git", git)):
        d = d.withColumn(name, F.lit(0.0)) if frame is None else d.join(frame.select("id", F.col("score").cast("double").alias(name)), "id", "left").fillna(0.0, [name])
    top = d.agg(F.greatest(F.max("total"), F.lit(1)).alias("top"))  # one row
    score = F.when(F.col("hop") == 0, 0.5).otherwise(0.0) + 0.4 * F.col("embedding") + F.lit(0.4) * F.col("total") / F.col("top") + 0.2 * F.col("git")
    return d.crossJoin(F.broadcast(top)).withColumn("score", F.round(score, 6)).drop("top", "embedding", "git")


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int = 1, most: int = NODES_MOST, budget: int = 6000, embeddings: DataFrame | None = None, git: DataFrame | None = None) -> DataFrame:
    """The nodes to show, with score and pos (from 1): the best `most` within k hops that the budget pays for, at least LEAST_NODES."""
    near = traverse.khop(edges, seeds, k, enough=3 * most)
    best = relevance(nodes, edges, near, embeddings, git).orderBy(F.desc("score"), "id").limit(most)
    pos = F.row_number().over(W.orderBy(F.desc("score"), "id"))  # at most `most` rows
    return best.withColumn("pos", pos).where((F.col("pos") <= LEAST_NODES) | (HEADER + F.col("pos") * TOKENS_A_NODE <= budget))


def lines(chosen: DataFrame, edges: DataFrame, budget: int = 6000) -> DataFrame:
    """pos, sub, line: a line for each chosen node (pos, id, label, type, summary, file) and one for each edge to another chosen node,
    until the tokens estimated for nodes and edges pass the budget; the node that passes it is the last."""
    node = F.concat(F.lit("["), F.coalesce("type", F.lit("?")), F.lit("] "), F.coalesce("label", "id"), F.lit(": "), F.substring(F.coalesce("summary", F.lit("")), 1, 120))
    node = F.concat(node, F.when(F.coalesce("file", F.lit("")) != "", F.concat(F.lit("  ("), base_name(F.col("file")), F.lit(")"))).otherwise(""))
    words = F.size(F.regexp_extract_all(F.col("line"), F.lit(r"\S+"), F.lit(0)))
    own = chosen.select("pos", "id", node.alias("line")).withColumn("tokens", words + 2)
    ends = chosen.select(F.col("id").alias("dst"), F.coalesce("label", "id").alias("to"))
    out = traverse.induced(edges, chosen).join(ends, "dst").join(chosen.select(F.col("id").alias("src"), "pos"), "src")
    linked = out.select("pos", F.concat(F.lit("  └─ "), "relation", F.lit(" → "), "to").alias("line"))
    cost = own.select("pos", "tokens").unionByName(linked.groupBy("pos").agg((8 * F.count("*")).alias("tokens"))).groupBy("pos").agg(F.sum("tokens").alias("tokens"))
    order = W.orderBy("pos")  # at most as many rows as nodes chosen
    paid = cost.withColumn("before", F.sum("tokens").over(order) - F.col("tokens") + HEADER).where(F.col("before") <= budget).select("pos")
    sub = F.row_number().over(W.partitionBy("pos").orderBy("line"))
    return own.select("pos", F.lit(0).alias("sub"), "line").unionByName(linked.withColumn("sub", sub).select("pos", "sub", "line")).join(paid, "pos", "left_semi")


def as_text(shown: DataFrame, head: str) -> str:
    """Lines (pos, sub, line; bounded by the budget) under a head."""
    return "\n".join([head, "", *(r.line for r in shown.orderBy("pos", "sub").collect())])


def neighbours_listed(matches: DataFrame, nodes: DataFrame, edges: DataFrame, incoming: bool, most: int, with_relation: bool) -> DataFrame:
    """id, names: the first `most` neighbours of each match by label, joined by commas."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    near = edges.join(F.broadcast(matches.select(F.col("id").alias(here))), here).join(nodes.select(F.col("id").alias(there), F.coalesce("label", "id").alias("name")), there)
    name = F.concat_ws(" ", "relation", "name") if with_relation else F.col("name")
    first = near.select(F.col(here).alias("id"), name.alias("name")).withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy("name"))).where(F.col("rn") <= most)
    return first.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))


def local_answer(matches: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, score, entry: what to say of each match (id, score; a top-k list): type, label, summary, file, community with degrees, and the
    first four nodes it leads to."""
    few = F.broadcast(matches)
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("e")).select("e.*").join(F.broadcast(matches.select("id")), "id")
    count = ends.groupBy("id").agg(F.sum("o").alias("outs"), F.sum(1 - F.col("o")).alias("ins"))
    d = nodes.join(few, "id").join(count, "id", "left").join(neighbours_listed(matches, nodes, edges, False, 4, True), "id", "left")
    part = lambda c, *x: F.when(c, F.concat(*x))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    entry = F.concat_ws(
        "\n",
        F.concat(F.lit("• ["), F.coalesce("type", F.lit("?")), F.lit("] **"), F.coalesce("label", "id"), F.lit("**")),
        part(filled("summary"), F.lit("  "), F.col("summary")),
        part(filled("file"), F.lit("  📄 "), F.col("file")),
        part(F.col("community").isNotNull(), F.lit("  🏘 Community "), F.col("community").cast("string"), F.lit(" · "), F.coalesce("ins", F.lit(0)).cast("string"), F.lit(" in / "), F.coalesce("outs", F.lit(0)).cast("string"), F.lit(" out")),
        part(F.col("names").isNotNull(), F.lit("  🔗 "), F.col("names")),
    )
    return d.select("id", "score", entry.alias("entry"))


def model_context(matches: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, score, entry: what a model is told of each match: label, type, summary, file, five dependencies and five users."""
    deps = neighbours_listed(matches, nodes, edges, False, 5, False).withColumnRenamed("names", "deps")
    users = neighbours_listed(matches, nodes, edges, True, 5, False).withColumnRenamed("names", "users")
    d = nodes.join(F.broadcast(matches), "id").join(deps, "id", "left").join(users, "id", "left")
    line = lambda title, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{title}: "), F.col(c)))
    head = F.concat(F.lit("Node: "), F.coalesce("label", "id"), F.lit(" ("), F.coalesce("type", F.lit("?")), F.lit(")"))
    return d.select("id", "score", F.concat_ws("\n", head, line("Summary", "summary"), line("File", "file"), line("Dependencies", "deps"), line("Used by", "users")).alias("entry"))


# Words of a question that say nothing of where to look.
RAW_STOP_WORDS = ("what", "how", "where", "does", "is", "the", "a", "an", "of", "to", "in", "and", "or", "for", "with", "this", "that", "it")


def raw_tokens(questions: DataFrame, nodes: DataFrame, sizes: DataFrame, top: int = 3) -> DataFrame:
    """q, tokens of questions (q, text): what reading the files (file, tokens) of the `top` nodes with most of a question's words costs;
    BLIND where there is none. Words meet nodes as substrings, so the questions (a set of some hundred) are broadcast to the nodes."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"\s+")), lambda w: (w != "") & ~w.isin(*RAW_STOP_WORDS))
    q = questions.select("q", words.alias("w"))
    body = F.lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("file", F.lit(""))))
    every = q.agg(F.collect_list(F.struct("q", "w")).alias("qs"))  # one row
    n = nodes.select("id", "file", body.alias("body")).crossJoin(F.broadcast(every))
    scored = n.select("id", "file", F.explode(F.filter(F.transform("qs", lambda x: F.struct(x["q"].alias("q"), F.size(F.filter(x["w"], lambda w: F.contains(F.col("body"), w))).alias("s"))), lambda y: y["s"] > 0)).alias("x"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), F.desc("file"), "id"))
    best = scored.select("id", F.coalesce("file", F.lit("")).alias("file"), "x.q", "x.s").withColumn("rn", rank).where(F.col("rn") <= top)
    read = best.where("file <> ''").select("q", "file").distinct().join(sizes, "file").groupBy("q").agg(F.sum("tokens").alias("tokens"))
    return questions.select("q").join(read, "q", "left").select("q", F.when(F.coalesce("tokens", F.lit(0)) == 0, BLIND).otherwise(F.col("tokens")).cast("long").alias("tokens"))


# Words that tell how far up a question asks; the first level that has one.
LEVELS = {
    "repo": ("overview", "what does this project", "architecture", "high level", "overall", "what is this", "kya hai ye project", "repo ke baare"),
    "community": ("module", "community", "cluster", "layer", "service", "package", "component", "subsystem", "how are", "organized"),
    "module": (".py", ".ts", ".js", ".go", ".rs", "file", "class", "interface", "import", "depend"),
}


def level(question: Column) -> Column:
    """repo, community, module or symbol."""
    low = F.lower(question)
    out = F
    for name, words in LEVELS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = out.when(hit, name)
    return out.otherwise("symbol")


def benchmark_entry(nodes: DataFrame, tokens: Column, a_file: int = 800) -> DataFrame:
    """One row: tokens through the graph, what all its files would take, and the share saved, not below 0."""
    raw = (F.countDistinct("file") * a_file).alias("raw")
    return nodes.agg(raw).select(tokens.alias("graph_tokens"), "raw", F.when(F.col("raw") > 0, F.round(F.greatest(F.lit(0.0), (1 - tokens / F.col("raw")) * 100), 1)).otherwise(0.0).alias("saved_pct"))


def repository_benchmark(files: DataFrame, nodes: DataFrame, edges: DataFrame, a_day: int = 10, price: float = 3.0) -> DataFrame:
    """One row: tokens of all files and of the graph written as JSON, their ratio, and what a month of questions saves."""
    size = lambda df: df.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("n"))
    graph = size(nodes).withColumnRenamed("n", "a").crossJoin(size(edges).withColumnRenamed("n", "b")).select(F.floor((F.col("a") + F.col("b")) / 4).alias("graph_tokens"))
    raw = files.agg(F.coalesce(F.sum(text.token_estimate(F.col("content"))), F.lit(0)).alias("raw_tokens"))
    saved = F.greatest(F.col("raw_tokens") - F.col("graph_tokens"), F.lit(0))
    return raw.crossJoin(graph).select("raw_tokens", "graph_tokens", F.round(F.col("raw_tokens") / F.greatest("graph_tokens", F.lit(1)), 1).alias("ratio"), F.round(F.coalesce(F.try_divide(saved * 100.0, F.col("raw_tokens")), F.lit(0.0)), 1).alias("saved_pct"), F.round(saved / 1e6 * price * a_day * 30, 2).alias("monthly_usd"))
