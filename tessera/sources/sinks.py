"""Graph sinks: text lines made by columns and written by executors; nothing is gathered."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import top_by_degree
from ..operators.keep import ranked


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def one_edge_per_pair(edges: DataFrame) -> DataFrame:
    """Parallel edges as the first by relation."""
    return edges.groupBy("src", "dst").agg(F.min("relation").alias("relation"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line, part of a GraphML document in four parts: head, nodes, edges, foot; null attributes left out."""
    spark = nodes.sparkSession
    fields = [c for c in nodes.columns if c != "id"]
    data = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), _xml(F.col(c).cast("string")), F.lit("</data>"))).otherwise("") for c in fields]
    keys = "".join(f'<key id="{c}" for="node" attr.name="{c}" attr.type="string"/>' for c in fields) + '<key id="relation" for="edge" attr.name="relation" attr.type="string"/>'
    ends = spark.createDataFrame([(0, '<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + keys + '<graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, line string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), *data, F.lit("</node>")).alias("line"))
    e = one_edge_per_pair(edges).select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('"><data key="relation">'), _xml(F.col("relation")), F.lit("</data></edge>")).alias("line"))
    return ends.unionByName(n).unionByName(e)


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """part, line: a MERGE for each node, a MATCH and MERGE for each edge."""
    q = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("'"), F.lit("\\'"))
    relation = F.replace(F.upper(F.coalesce("relation", F.lit("related"))), F.lit("-"), F.lit("_"))
    n = nodes.select(F.lit(0).alias("part"), F.concat(F.lit("MERGE (n:"), F.coalesce("type", F.lit("Node")), F.lit(" {id: '"), q("id"), F.lit("', label: '"), q("label"), F.lit("', summary: '"), q("summary"), F.lit("', file: '"), q("file"), F.lit("'});")).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.concat(F.lit("MATCH (a {id: '"), q("src"), F.lit("'}), (b {id: '"), q("dst"), F.lit("'}) MERGE (a)-[:"), relation, F.lit("]->(b);")).alias("line"))
    return n.unionByName(e)


def node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and links as line-JSON directories below path."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "relation").write.mode("overwrite").json(f"{path}/links")


def canvas(nodes: DataFrame, edges: DataFrame, columns: int = 10, step: int = 300) -> DataFrame:
    """part, line: JSON cards of all nodes in a grid by id, and one JSON arrow for each pair of cards with an edge."""
    i = F.col("rank")
    text = F.concat(F.lit("**"), F.coalesce("label", "id"), F.lit("** ("), F.coalesce("type", F.lit("?")), F.lit(")\n\n"), F.coalesce("summary", F.lit("")))
    card = F.struct(F.substring("id", 1, 50).alias("id"), F.lit("text").alias("type"), text.alias("text"), (F.pmod(i, F.lit(columns)) * step).alias("x"), (F.floor(i / columns) * step).alias("y"), F.lit(250).alias("width"), F.lit(120).alias("height"))
    one = edges.groupBy(F.substring("src", 1, 50).alias("a"), F.substring("dst", 1, 50).alias("b")).agg(F.min("relation").alias("label"))
    arrow = F.struct(F.concat_ws("-", F.substring("a", 1, 25), F.substring("b", 1, 25)).alias("id"), F.col("a").alias("fromNode"), F.lit("right").alias("fromSide"), F.col("b").alias("toNode"), F.lit("left").alias("toSide"), "label")
    return ranked(nodes, "id").select(F.lit(0).alias("part"), F.to_json(card).alias("line")).unionByName(one.select(F.lit(1).alias("part"), F.to_json(arrow).alias("line")))


PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Graph</title></head><body><svg id="g" width="100%" height="900"></svg><script>
const data = {data};
const svg = document.getElementById("g"), at = {{}}, n = data.nodes.length || 1;
const add = (tag, a, t) => {{ const e = document.createElementNS("http://www.w3.org/2000/svg", tag); for (const k in a) e.setAttribute(k, a[k]); if (t) e.textContent = t; svg.appendChild(e); }};
data.nodes.forEach((d, i) => {{ const w = 2 * Math.PI * i / n; at[d.id] = [600 + 400 * Math.cos(w), 450 + 400 * Math.sin(w)]; }});
data.links.forEach(l => add("line", {{ x1: at[l.source][0], y1: at[l.source][1], x2: at[l.target][0], y2: at[l.target][1], stroke: "#ccc" }}));
data.nodes.forEach(d => {{ add("circle", {{ cx: at[d.id][0], cy: at[d.id][1], r: 4 }}); add("text", {{ x: at[d.id][0] + 6, y: at[d.id][1], "font-size": 9 }}, d.label); }});
</script></body></html>
"""


def html_view(nodes: DataFrame, edges: DataFrame, most: int = 300) -> str:
    """A page with the `most` best connected nodes and the edges among them (a view of what a screen can show; all is in the other sinks)."""
    top = top_by_degree(nodes, edges, most, isolated=True).select("id", "label", "type")
    ids = top.select("id")
    inside = one_edge_per_pair(edges.join(F.broadcast(ids.withColumnRenamed("id", "src")), "src").join(F.broadcast(ids.withColumnRenamed("id", "dst")), "dst"))
    data = {"nodes": [r.asDict() for r in top.collect()], "links": [{"source": r.src, "target": r.dst, "relation": r.relation} for r in inside.collect()]}
    return PAGE.format(data=json.dumps(data).replace("</", "<\\/"))


def markdown_report(frames: dict[str, DataFrame], most: int = 50) -> str:
    """A report of small aggregate frames: a table for each title, at most `most` rows each."""
    out = ["# Graph report", ""]
    for title, df in frames.items():
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(most).collect()]
        out.append("")
    return "\n".join(out)


def write_lines(lines: DataFrame, path: str) -> None:
    """Write part by part, so that a concatenation of the files in name order is the document."""
    lines.repartitionByRange("part").sortWithinPartitions("part").select("line").write.mode("overwrite").text(path)
