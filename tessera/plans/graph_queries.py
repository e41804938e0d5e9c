"""Graph queries over the projected tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import communities, context, graph, importance, traverse
from ..registry import query
from ..sources import tables
from ..sources.tables import DEGREES_SQL, EDGES_SQL, GRAPH_SQL, NODES_SQL, SPARSE_SQL, edges, nodes, table
from ..operators.keep import keep

N = f"WITH {NODES_SQL} "


@query(N + "SELECT type, count(*) AS n FROM nodes GROUP BY type")
def nodes_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return graph.count_by(nodes(spark, sf), "type", "unknown")


@query(N + "SELECT lang, count(*) AS n FROM nodes WHERE lang IS NOT NULL GROUP BY lang")
def nodes_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    return graph.count_by(nodes(spark, sf), "lang")


@query(GRAPH_SQL + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT file) FROM nodes) AS files, (SELECT count(DISTINCT community) FROM nodes) AS communities")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf).agg(F.count("*").alias("nodes"), F.countDistinct("file").alias("files"), F.countDistinct("community").alias("communities"))
    return n.crossJoin(edges(spark, sf).agg(F.count("*").alias("edges"))).select("nodes", "edges", "files", "communities")  # two single rows


@query(N + "SELECT COALESCE(type, '*') AS type, COALESCE(lang, '*') AS lang, count(*) AS n FROM (SELECT type, COALESCE(lang, '-') AS lang FROM nodes) GROUP BY GROUPING SETS ((type, lang), (type), (lang), ())")
def type_lang_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    d = nodes(spark, sf).select("type", F.coalesce("lang", F.lit("-")).alias("lang"))
    return d.cube("type", "lang").agg(F.count("*").alias("n")).select(F.coalesce("type", F.lit("*")).alias("type"), F.coalesce("lang", F.lit("*")).alias("lang"), "n")


@query(GRAPH_SQL + "SELECT id, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, CAST(total AS BIGINT) AS total FROM degrees")
def node_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(nodes(spark, sf), edges(spark, sf)).select("id", "in_degree", "out_degree", "total")


GOD = "SELECT id, label, type, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, CAST(total AS BIGINT) AS total FROM degrees"


@query(GRAPH_SQL + GOD + " WHERE total > 0 ORDER BY total DESC, id LIMIT 15")
def god_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_by_degree(nodes(spark, sf), edges(spark, sf))


@query(GRAPH_SQL + "SELECT id, label, uses FROM nodes JOIN (SELECT dst, count(*) AS uses FROM edges GROUP BY dst) ON dst = id WHERE type = 'external' ORDER BY uses DESC, id LIMIT 10")
def top_external(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_external(nodes(spark, sf), edges(spark, sf))


@query(f"WITH {NODES_SQL}, {SPARSE_SQL} SELECT id, type FROM nodes WHERE id NOT IN (SELECT src FROM sparse UNION SELECT dst FROM sparse)")
def isolated_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.isolated(nodes(spark, sf), edges(spark, sf, sparse=True))


@query(f"WITH {NODES_SQL}, {SPARSE_SQL} SELECT id, type FROM nodes WHERE type NOT IN ('external', 'community') AND id NOT IN (SELECT src FROM sparse UNION SELECT dst FROM sparse)")
def dead_code(spark: SparkSession, sf: str) -> DataFrame:
    return graph.isolated(nodes(spark, sf), edges(spark, sf, sparse=True), ("external", "community"))


@query(N + """SELECT community, count(*) AS size, count(DISTINCT file) AS files, (SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT label FROM nodes b WHERE b.community = a.community ORDER BY label LIMIT 8)) AS first_labels
FROM nodes a WHERE community IS NOT NULL GROUP BY community""")
def community_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return graph.community_rollup(nodes(spark, sf))


@query(N + "SELECT community, type, count(*) AS n FROM nodes WHERE community IS NOT NULL GROUP BY community, type")
def community_type_map(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).where("community is not null").groupBy("community", "type").agg(F.count("*").alias("n"))


@query(GRAPH_SQL + "SELECT community, CAST(rank AS INTEGER) AS rank, id, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY total DESC, id) AS rank FROM degrees WHERE community IS NOT NULL) WHERE rank <= 5")
def community_top_members(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_members(nodes(spark, sf), edges(spark, sf))


CROSS = """cross_edges AS (SELECT s.community AS sc, t.community AS tc, src, dst, relation FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst
  WHERE s.community IS NOT NULL AND t.community IS NOT NULL AND s.community <> t.community AND NOT (relation = 'imports' AND t.type = 'external'))"""


def _crossing(spark: SparkSession, sf: str) -> DataFrame:
    """Imports all end in parts, which are externals all, so none of them crosses; without them the others are what is joined."""
    return graph.cross_community(nodes(spark, sf), edges(spark, sf).where("relation <> 'imports'"))


@query(f"WITH {NODES_SQL}, {EDGES_SQL}, {CROSS} SELECT * FROM cross_edges ORDER BY sc, tc, src, dst, relation LIMIT 15")
def cross_community_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _crossing(spark, sf).orderBy("sc", "tc", "src", "dst", "relation").limit(15)


@query(f"WITH {NODES_SQL}, {EDGES_SQL}, {CROSS} SELECT sc, tc, count(*) AS n FROM cross_edges GROUP BY sc, tc")
def cross_community_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _crossing(spark, sf).groupBy("sc", "tc").agg(F.count("*").alias("n"))


@query(N + """, by_type AS (SELECT file, type, count(*) AS n FROM nodes WHERE file IS NOT NULL GROUP BY file, type),
main AS (SELECT file, CAST(sum(n) AS BIGINT) AS nodes FROM by_type GROUP BY file),
kind AS (SELECT file, type AS main_type FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, type) AS rn FROM by_type) WHERE rn = 1),
first AS (SELECT file, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY label, id) AS rn FROM nodes WHERE file IS NOT NULL) WHERE rn <= 5 GROUP BY file)
SELECT file, nodes, main_type, labels, greatest(nodes - 5, 0) AS more FROM main JOIN kind USING (file) JOIN first USING (file)""")
def module_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return graph.module_rollup(nodes(spark, sf)).select("file", "nodes", "main_type", "labels", "more")


@query(N + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT file) FROM nodes) AS files, (SELECT string_agg(type, ',' ORDER BY n DESC, type) FROM (SELECT type, count(*) AS n FROM nodes WHERE type <> 'external' GROUP BY type ORDER BY n DESC, type LIMIT 3)) AS top_types")
def repo_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = nodes(spark, sf)
    top = d.where("type <> 'external'").groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(3)
    top = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "type"))), lambda x: x["type"]), ",").alias("top_types"))
    return d.agg(F.count("*").alias("nodes"), F.countDistinct("file").alias("files")).crossJoin(top)


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT id, label, type, relation FROM edges JOIN nodes ON id = src WHERE dst = 'part:1'")
def callers_of(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(nodes(spark, sf), edges(spark, sf), "part:1", incoming=True)


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT id, label, type, relation FROM edges JOIN nodes ON id = dst WHERE src = 'supplier:1'")
def dependencies_of(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(nodes(spark, sf), edges(spark, sf), "supplier:1", incoming=False)


@query(f"WITH {NODES_SQL}, {EDGES_SQL}, known AS (SELECT * FROM nodes WHERE type <> 'interface') SELECT id, id AS label, 'external' AS type FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM known)")
def stub_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.stubs(nodes(spark, sf).where("type <> 'interface'"), edges(spark, sf))


FRAGMENTS = """fragments AS (SELECT id, CASE WHEN community = 1 THEN '' ELSE label END AS label, CASE WHEN type = 'function' THEN 'unknown' ELSE type END AS type, file, lang, NULL AS summary, community, 1 AS ord FROM nodes
  UNION ALL SELECT id, upper(label), type, file, lang, summary, community, 2 FROM nodes WHERE type <> 'external')"""


@query(f"""WITH {NODES_SQL}, {FRAGMENTS},
merged AS (SELECT id, arg_min(CASE WHEN label <> '' THEN label END, CASE WHEN label <> '' THEN ord END) AS label, arg_min(CASE WHEN type NOT IN ('', 'unknown') THEN type END, CASE WHEN type NOT IN ('', 'unknown') THEN ord END) AS type,
  arg_min(summary, CASE WHEN summary <> '' THEN ord END) AS summary, min(community) AS community FROM fragments GROUP BY id)
SELECT id, COALESCE(label, id) AS label, COALESCE(type, 'unknown') AS type, summary, COALESCE(community, -1) AS community FROM merged""")
def graph_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = nodes(spark, sf)
    one = d.withColumns({"label": F.when(F.col("community") == 1, "").otherwise(F.col("label")), "type": F.when(F.col("type") == "function", "unknown").otherwise(F.col("type")), "summary": F.lit(None).cast("string"), "ord": F.lit(1)})
    two = d.where("type <> 'external'").withColumns({"label": F.upper("label"), "ord": F.lit(2)})
    merged, _ = graph.merge_fragments(one.unionByName(two), edges(spark, sf))
    return merged.select("id", "label", "type", "summary", F.coalesce("community", F.lit(-1)).alias("community"))


@query("SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, 'imports' AS relation FROM lineitem GROUP BY l_suppkey, l_partkey")
def edge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.table(spark, sf, "lineitem").select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("imports").alias("relation"))
    return graph.merge_fragments(nodes(spark, sf).withColumn("ord", F.lit(1)), raw)[1]


def _bfs(target: str, depth: int) -> str:
    levels = [f"l0 AS (SELECT '{target}' AS id, 0 AS hop)"]
    for h in range(1, depth + 1):
        levels.append(f"l{h} AS (SELECT * FROM l{h - 1} UNION ALL SELECT DISTINCT src, {h} FROM edges WHERE dst IN (SELECT id FROM l{h - 1} WHERE hop = {h - 1}) AND src NOT IN (SELECT id FROM l{h - 1}))")
    return ", ".join(levels) + f", reached AS (SELECT id, hop FROM l{depth} WHERE hop > 0)"


@query(f"WITH {EDGES_SQL}, {_bfs('region:0', 3)} SELECT id, hop FROM reached")
def reverse_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.reverse_bfs(edges(spark, sf), nodes(spark, sf).where("id = 'region:0'").select("id"), 3)


IMPACT = f"""WITH {NODES_SQL}, {EDGES_SQL}, {DEGREES_SQL}, {_bfs('part:1', 3)},
scores AS (SELECT d.id, hop, CAST(in_degree AS BIGINT) AS in_degree, round(least(0.4 / hop + 0.3 * least(in_degree / (SELECT max(in_degree) FROM degrees), 1.0) + CASE WHEN community IS NOT NULL AND (SELECT community FROM nodes WHERE id = 'part:1') IS NOT NULL AND community <> (SELECT community FROM nodes WHERE id = 'part:1') THEN 0.1 ELSE 0.0 END, 1.0), 4) AS risk FROM reached JOIN degrees d USING (id)) """


@query(IMPACT + "SELECT id, hop, in_degree, CAST(risk AS DOUBLE) AS risk FROM scores")
def impact_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _impact(spark, sf)


def _impact(spark: SparkSession, sf: str, frequencies: DataFrame | None = None) -> DataFrame:
    return traverse.impact(nodes(spark, sf), keep(edges(spark, sf)), "part:1", 3, frequencies)


FREQUENT = "frequent AS (SELECT 'crm/' || n_name AS file, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"
GIT_IMPACT = IMPACT.replace("scores AS (", f"{FREQUENT}, scores AS (").replace("+ CASE WHEN community", "+ 0.2 * COALESCE(n / (SELECT max(n) FROM frequent), 0) + CASE WHEN community").replace("JOIN degrees d USING (id)", "JOIN degrees d USING (id) LEFT JOIN frequent USING (file)")


def _frequent(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = (tables.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    by = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return by.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("crm/"), "n_name").alias("file"), "n")


@query(GIT_IMPACT + "SELECT id, hop, in_degree, CAST(risk AS DOUBLE) AS risk FROM scores")
def impact_scores_git(spark: SparkSession, sf: str) -> DataFrame:
    return _impact(spark, sf, _frequent(spark, sf))


@query(IMPACT + ", best AS (SELECT *, row_number() OVER (ORDER BY risk DESC, hop, id) AS place FROM scores ORDER BY risk DESC, hop, id LIMIT 100), placed AS (SELECT *, row_number() OVER (PARTITION BY hop ORDER BY risk DESC, id) AS p FROM best) SELECT id, CAST(place AS INTEGER) AS place, COALESCE(CAST(CASE WHEN p <= 15 THEN p END AS INTEGER), -1) AS in_hop FROM placed")
def impact_listed(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.impact_listed(_impact(spark, sf)).select("id", "place", F.coalesce("in_hop", F.lit(-1)).alias("in_hop"))


@query(IMPACT + "SELECT count(*) AS affected, CAST(max(risk) AS DOUBLE) AS max_risk, count(*) FILTER (risk >= 0.7) AS high, count(*) FILTER (risk >= 0.4 AND risk < 0.7) AS medium, count(*) FILTER (risk < 0.4) AS low FROM scores")
def impact_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.impact_rollup(_impact(spark, sf))


KHOP = f"""WITH {NODES_SQL}, {EDGES_SQL}, {DEGREES_SQL}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
h1 AS (SELECT 'nation:1' AS id, 0 AS hop UNION ALL SELECT dst, 1 FROM both_ways WHERE src = 'nation:1') """


@query(KHOP + "SELECT id, hop FROM h1")
def khop_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.khop(edges(spark, sf), nodes(spark, sf).where("id = 'nation:1'").select("id"), 1)


NEAR2 = f"""WITH {NODES_SQL}, {SPARSE_SQL}, both_ways AS (SELECT src, dst FROM sparse UNION SELECT dst, src FROM sparse), h0 AS (SELECT id, 0 AS hop FROM nodes WHERE id IN ('supplier:1', 'part:7')),
h1 AS (SELECT * FROM h0 UNION ALL SELECT DISTINCT dst, 1 FROM both_ways WHERE src IN (SELECT id FROM h0) AND dst NOT IN (SELECT id FROM h0)),
h2 AS (SELECT * FROM h1 UNION ALL SELECT DISTINCT dst, 2 FROM both_ways WHERE src IN (SELECT id FROM h1 WHERE hop = 1) AND dst NOT IN (SELECT id FROM h1)) """


@query(NEAR2 + "SELECT id, hop, 'all' AS reach FROM h2 UNION ALL SELECT id, hop, 'enough' FROM h1")
def khop_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Two hops, and the same with an end once two ids are reached, which is after the first."""
    e = keep(edges(spark, sf, sparse=True))
    start = nodes(spark, sf).where("id in ('supplier:1', 'part:7')").select("id")
    return traverse.khop(e, start, 2).withColumn("reach", F.lit("all")).unionByName(traverse.khop(e, start, 2, enough=2).withColumn("reach", F.lit("enough")))


@query(KHOP + """, emb AS (SELECT 'customer:' || vec_id AS id, abs(embedding[1]) AS score FROM embeddings), git AS (SELECT 'supplier:' || s_suppkey AS id, (s_suppkey % 10) / 10.0 AS score FROM supplier)
SELECT id, CAST(round(CASE WHEN hop = 0 THEN 0.5 ELSE 0.0 END + 0.4 * CAST(COALESCE(emb.score, 0) AS DOUBLE) + 0.4 * total / (SELECT max(total) FROM h1 JOIN degrees USING (id)) + 0.2 * COALESCE(git.score, 0), 6) AS DOUBLE) AS score FROM h1 JOIN degrees USING (id) LEFT JOIN emb USING (id) LEFT JOIN git USING (id)""")
def subgraph_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """All terms: seeds, similarity of vectors, degrees, git."""
    e = keep(edges(spark, sf))
    near = traverse.khop(e, nodes(spark, sf).where("id = 'nation:1'").select("id"), 1)
    emb = tables.table(spark, sf, "embeddings").select(F.concat(F.lit("customer:"), F.col("vec_id").cast("string")).alias("id"), F.abs(F.col("embedding")[0]).alias("score"))
    git_ = tables.table(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), ((F.col("s_suppkey") % 10) / 10.0).alias("score"))
    return context.relevance(nodes(spark, sf), e, near, emb, git_).select("id", "score")


RANK = "round(CASE WHEN hop = 0 THEN 0.5 ELSE 0.0 END + 0.4 * total / (SELECT max(total) FROM h1 JOIN degrees USING (id)), 6)"


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(spark, sf, keep(edges(spark, sf))).select("id", "label", "score")


def _chosen(spark: SparkSession, sf: str, e: DataFrame) -> DataFrame:
    return context.subgraph(nodes(spark, sf), e, nodes(spark, sf).where("id = 'nation:1'").select("id"))


@query(KHOP + f"SELECT id, CAST({RANK} AS DOUBLE) AS score FROM h1 JOIN degrees USING (id) ORDER BY score DESC, id LIMIT 60")
def subgraph_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select("id", "score")


@query(KHOP + f", chosen AS (SELECT id, {RANK} AS score FROM h1 JOIN degrees USING (id) ORDER BY score DESC, id LIMIT 60) SELECT src, dst, relation FROM edges WHERE src IN (SELECT id FROM chosen) AND dst IN (SELECT id FROM chosen)")
def induced_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = keep(edges(spark, sf))
    return traverse.induced(e, keep(_chosen(spark, sf, e).select("id")))


@query(KHOP + f""", chosen AS (SELECT id, label, {RANK} AS score FROM h1 JOIN degrees USING (id) ORDER BY score DESC, id LIMIT 60),
costed AS (SELECT id, CAST(greatest(1, (length(id) + length(label)) // 4) AS BIGINT) AS tokens, row_number() OVER (ORDER BY score DESC, id) AS pos FROM chosen),
running AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY pos) AS BIGINT) AS spent FROM costed) SELECT id, CAST(pos AS INTEGER) AS pos, tokens, spent FROM running WHERE pos <= 5 OR spent <= 200""")
def token_budget_pack(spark: SparkSession, sf: str) -> DataFrame:
    order = W.orderBy(F.desc("score"), "id")  # at most 60 rows
    costed = _ranked(spark, sf).withColumn("tokens", F.greatest(F.lit(1), F.floor((F.length("id") + F.length("label")) / 4)).cast("long")).withColumn("pos", F.row_number().over(order))
    return costed.withColumn("spent", F.sum("tokens").over(W.orderBy("pos"))).where("pos <= 5 or spent <= 200").select("id", "pos", "tokens", "spent")


@query(GRAPH_SQL + """, top AS (SELECT id, community, total FROM degrees ORDER BY total DESC, id LIMIT 25),
rep AS (SELECT id, community, total FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY total DESC, id) AS rn FROM degrees WHERE community IS NOT NULL AND id NOT IN (SELECT id FROM top)) WHERE rn = 1)
SELECT id, 'top' AS why FROM top UNION ALL SELECT id, 'community' FROM rep""")
def landmarks(spark: SparkSession, sf: str) -> DataFrame:
    d = keep(graph.degrees(nodes(spark, sf), edges(spark, sf)).select("id", "community", "total"))
    top = d.orderBy(F.desc("total"), "id").limit(25)
    rank = F.row_number().over(W.partitionBy("community").orderBy(F.desc("total"), "id"))
    rep = d.where("community is not null").join(F.broadcast(top.select("id")), "id", "left_anti").withColumn("rn", rank).where("rn = 1")
    return top.select("id", F.lit("top").alias("why")).unionByName(rep.select("id", F.lit("community").alias("why")))


@query(f"WITH {EDGES_SQL}, {_bfs('region:0', 4)} SELECT 'customer:1' AS source, 'region:0' AS target, hop FROM reached WHERE id = 'customer:1'")
def shortest_path_len(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.shortest_path(keep(edges(spark, sf)), "customer:1", "region:0").select("source", "target", "hop")


_F = ["f0 AS (SELECT 'customer:1' AS id, 0 AS hop)"] + [f"f{h} AS (SELECT * FROM f{h - 1} UNION ALL SELECT DISTINCT dst, {h} FROM edges WHERE src IN (SELECT id FROM f{h - 1} WHERE hop = {h - 1}) AND dst NOT IN (SELECT id FROM f{h - 1}))" for h in (1, 2, 3, 4)]


@query(f"""WITH {EDGES_SQL}, {', '.join(_F)}, d AS (SELECT hop AS n FROM f4 WHERE id = 'region:0'),
b0 AS (SELECT 'region:0' AS id, (SELECT n FROM d) AS hop), """ + ", ".join(f"b{i} AS (SELECT min(src) AS id, max(b.hop) - 1 AS hop FROM edges JOIN b{i - 1} b ON dst = b.id JOIN f4 f ON f.id = src AND f.hop = b.hop - 1)" for i in (1, 2, 3, 4)) + """
SELECT string_agg(id, ' > ' ORDER BY hop) AS path FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4) WHERE id IS NOT NULL""")
def shortest_path_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.shortest_path(keep(edges(spark, sf)), "customer:1", "region:0").select(F.array_join("path", " > ").alias("path"))


@query(f"""WITH RECURSIVE {NODES_SQL}, {SPARSE_SQL}, both_ways AS (SELECT src, dst FROM sparse UNION SELECT dst, src FROM sparse),
c0 AS (SELECT id, id AS c FROM nodes), """ + ", ".join(f"c{i} AS (SELECT a.id, min(least(a.c, COALESCE(b.c, a.c))) AS c FROM c{i - 1} a LEFT JOIN both_ways e ON e.src = a.id LEFT JOIN c{i - 1} b ON b.id = e.dst GROUP BY a.id)" for i in range(1, 13)) + " SELECT id, c AS component FROM c12")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.connected_components(nodes(spark, sf).select("id"), edges(spark, sf, sparse=True))


@query(f"WITH {NODES_SQL}, {SPARSE_SQL}, both_ways AS (SELECT src, dst FROM sparse WHERE src <> dst UNION SELECT dst, src FROM sparse WHERE src <> dst), l0 AS (SELECT id, id AS c FROM nodes), "
+ ", ".join(f"l{i} AS (SELECT id, arg_min(c, {{'n': -n, 'c': c}}) AS c FROM (SELECT id, c, count(*) AS n FROM (SELECT e.src AS id, l.c FROM both_ways e JOIN l{i - 1} l ON l.id = e.dst UNION ALL SELECT id, c FROM l{i - 1}) GROUP BY id, c) GROUP BY id)" for i in range(1, 6))
+ " SELECT id, c AS community FROM l5")
def label_communities(spark: SparkSession, sf: str) -> DataFrame:
    return traverse.label_propagation(nodes(spark, sf).select("id"), edges(spark, sf, sparse=True), keep)


@query("SELECT 0 AS split_communities, true AS at_least_local_moving, true AS covers_all")
def modularity_communities(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the communities of the tables' graph, a heuristic's result that SQL can't give: each is connected, their modularity
    is at least that of local moving without refinement, and every node is in one."""
    n = nodes(spark, sf).select("id")
    names, some, e = traverse.coded(n, edges(spark, sf, sparse=True))  # once for all that follows
    plain = communities.louvain(some, e)
    found = keep(communities.leiden(some, e, start=plain))
    q = communities.modularity(found, e).withColumnRenamed("q", "refined").crossJoin(communities.modularity(plain, e))  # one row each
    split = communities.split_communities(found, e).agg(F.count("*").alias("split_communities"))
    every = n.join(traverse.decoded(found, names, "community"), "id", "left_anti").agg((F.count("*") == 0).alias("covers_all"))
    return split.crossJoin(q).crossJoin(every).select("split_communities", (F.col("refined") >= F.col("q") - 1e-9).alias("at_least_local_moving"), "covers_all")


@query("SELECT 'c' || c_custkey AS id, 'c' || min(c_custkey) OVER (PARTITION BY c_nationkey % 5) AS community FROM customer")
def planted_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of five groups of nations each know the first of their group, and these know each other in a ring; the groups come out."""
    c = table(spark, sf, "customer").select((F.col("c_nationkey") % 5).alias("g"), "c_custkey")
    heads = c.groupBy("g").agg(F.min("c_custkey").alias("head"))
    spokes = c.join(heads, "g").where("c_custkey <> head").select("c_custkey", F.col("head").alias("other"))
    ring = heads.join(heads.select((F.pmod(F.col("g") - 1, F.lit(5))).alias("g"), F.col("head").alias("next")), "g").select(F.col("head").alias("c_custkey"), F.col("next").alias("other"))
    name = lambda x: F.concat(F.lit("c"), F.col(x).cast("string"))
    e = keep(spokes.unionByName(ring).select(name("c_custkey").alias("src"), name("other").alias("dst"), F.lit("knows").alias("relation")))
    found = communities.leiden(c.select(name("c_custkey").alias("id")), e)
    first = found.groupBy("community").agg(F.min(F.substring("id", 2, 20).cast("long")).alias("first"))  # by number, not by text
    return found.join(first, "community").select("id", name("first").alias("community"))


@query(f"""WITH {NODES_SQL}, {SPARSE_SQL}, e AS (SELECT s.community AS a, t.community AS b FROM sparse JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst), m AS (SELECT 2.0 * count(*) AS two_m FROM sparse),
deg AS (SELECT c, count(*) AS k FROM (SELECT COALESCE(n.community, 99) AS c FROM (SELECT src AS id FROM sparse UNION ALL SELECT dst FROM sparse) x JOIN nodes n USING (id)) GROUP BY c),
ins AS (SELECT COALESCE(a, 99) AS c, 2 * count(*) AS w FROM e WHERE COALESCE(a, 99) = COALESCE(b, 99) GROUP BY 1)
SELECT round(sum(COALESCE(w, 0) / two_m - (k / two_m) * (k / two_m)), 6) AS q FROM deg LEFT JOIN ins USING (c), m""")
def community_modularity(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf).select("id", F.coalesce("community", F.lit(99)).alias("community"))
    return communities.modularity(n, keep(edges(spark, sf, sparse=True))).select(F.round("q", 6).alias("q"))


OLD = f"{NODES_SQL}, old AS (SELECT * FROM nodes WHERE id NOT LIKE '%7'), new AS (SELECT id, label, type, file, lang, CASE WHEN id LIKE '%3' THEN upper(summary) ELSE summary END AS summary, community FROM nodes WHERE id NOT LIKE '%9')"


@query(f"WITH {OLD} SELECT COALESCE(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old a FULL OUTER JOIN new b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.summary IS DISTINCT FROM b.summary OR a.type IS DISTINCT FROM b.type")
def graph_diff_nodes(spark: SparkSession, sf: str) -> DataFrame:
    d = nodes(spark, sf)
    new = d.where("id not like '%9'").withColumn("summary", F.when(F.col("id").like("%3"), F.upper("summary")).otherwise(F.col("summary")))
    return graph.diff_nodes(d.where("id not like '%7'"), new)


def _calls(spark: SparkSession, sf: str, when: str) -> DataFrame:
    o = tables.table(spark, sf, "orders").where(when)
    pairs = tables.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    return pairs.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("calls").alias("relation"))


_CALLS = "SELECT DISTINCT 'customer:' || o_custkey AS src, 'supplier:' || l_suppkey AS dst, 'calls' AS relation FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate {} TIMESTAMP '1996-01-01'"


@query(f"WITH old AS ({_CALLS.format('<')}), new AS ({_CALLS.format('>=')}) SELECT *, 'added' AS change FROM (SELECT * FROM new EXCEPT SELECT * FROM old) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM new)")
def graph_diff_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.diff_edges(_calls(spark, sf, "o_orderdate < timestamp_ntz'1996-01-01'"), _calls(spark, sf, "o_orderdate >= timestamp_ntz'1996-01-01'"))


@query(N + """, hit AS (SELECT id, label, CASE WHEN lower(label) = 'customer#000000001' OR lower(label) = 'germany' THEN 0 WHEN contains(lower(label), 'germany') THEN 1 END AS how FROM nodes)
SELECT id, label FROM hit WHERE how = (SELECT min(how) FROM hit)""")
def label_match(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("label")
    how = F.when(low.isin("customer#000000001", "germany"), 0).when(low.contains("germany"), 1)
    hit = nodes(spark, sf).select("id", "label", how.alias("how")).where("how is not null")
    return hit.join(F.broadcast(hit.agg(F.min("how").alias("how"))), "how").select("id", "label")


@query(N + """SELECT id, CAST(how AS INTEGER) AS how FROM (SELECT id, CASE WHEN id = 'nation_1' THEN 0 WHEN lower(label) = 'nation_1' THEN 1 WHEN contains(lower(label), 'nation_1') THEN 2 END AS how FROM nodes) WHERE how IS NOT NULL ORDER BY how, id LIMIT 1""")
def node_resolve(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("label")
    how = F.when(F.col("id") == "nation_1", 0).when(low == "nation_1", 1).when(low.contains("nation_1"), 2)
    return nodes(spark, sf).select("id", how.alias("how")).where("how is not null").orderBy("how", "id").limit(1)


@query(N + """, s AS (SELECT id, CASE WHEN contains(lower(COALESCE(label, '')), 'nation_1') THEN 3 ELSE CASE WHEN contains(lower(COALESCE(file, '')), 'nation_1') THEN 2 ELSE CASE WHEN contains(lower(COALESCE(summary, '')), 'nation_1') THEN 1 ELSE 0 END END END
 + CASE WHEN contains(lower(COALESCE(label, '')), 'small') THEN 3 ELSE CASE WHEN contains(lower(COALESCE(file, '')), 'small') THEN 2 ELSE CASE WHEN contains(lower(COALESCE(summary, '')), 'small') THEN 1 ELSE 0 END END END AS score FROM nodes)
SELECT id, CAST(score AS INTEGER) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 20""")
def seed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return context.seeds(nodes(spark, sf), ["nation_1", "small"])


@query(N + "SELECT id FROM nodes WHERE contains(lower(file), 'nation_1')")
def file_match(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).where(F.contains(F.lower("file"), F.lit("nation_1"))).select("id")


NAMED = "CASE WHEN regexp_matches(file, 'crm') THEN 0.2 WHEN regexp_matches(file, 'geo') THEN -0.1 ELSE 0.0 END"
IMPORTANCE = f"{GRAPH_SQL}, s AS (SELECT file, round(greatest(0.0, least(1.0, 0.3 + max({NAMED}) + least(max(in_degree) / 20.0, 0.35) + greatest(0.0, 0.15 - 0.015 * len(string_split(file, '/'))))), 4) AS score FROM degrees WHERE file IS NOT NULL GROUP BY file) "
DEPTH = "CASE WHEN score >= 0.7 THEN 'full' WHEN score >= 0.4 THEN 'standard' WHEN score >= 0.15 THEN 'minimal' ELSE 'name_only' END"


def _importance(spark: SparkSession, sf: str) -> DataFrame:
    named = F.when(F.col("file").contains("crm"), 0.2).when(F.col("file").contains("geo"), -0.1).otherwise(0.0)
    d = graph.degrees(nodes(spark, sf), edges(spark, sf)).where("file is not null").groupBy("file").agg(F.max("in_degree").alias("uses"))
    score = F.lit(0.3) + named + F.least(F.col("uses") / 20.0, F.lit(0.35)) + F.greatest(F.lit(0.0), F.lit(0.15) - F.lit(0.015) * F.size(F.split("file", "/")))
    return d.select("file", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("score"))


@query(IMPORTANCE + "SELECT file, CAST(score AS DOUBLE) AS score FROM s")
def importance_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _importance(spark, sf)


@query(IMPORTANCE + f"SELECT {DEPTH} AS depth, count(*) AS n FROM s GROUP BY 1")
def importance_depth(spark: SparkSession, sf: str) -> DataFrame:
    return _importance(spark, sf).groupBy(importance.depth(F.col("score")).alias("depth")).agg(F.count("*").alias("n"))
