"""File sources and sinks on small files."""

import json
import xml.etree.ElementTree as ET

from tessera.sources import files, sinks


def test_scan(spark, tmp_path):
    for name in ("main.py", "README.md", "paper.pdf", "logo.png", "archive.zip", "node_modules/ignored.js"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x = 1")
    got = {r.path.rsplit("/", 1)[-1]: r.type for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"main.py": "code", "README.md": "document", "paper.pdf": "paper", "logo.png": "image"}
    assert {r.type: r.n for r in files.summarize(files.scan(spark, str(tmp_path))).collect()} == {"code": 1, "document": 1, "paper": 1, "image": 1}


def test_graph_and_sinks(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "label": "A<b>", "type": "class"}, {"id": "b", "label": "B's", "type": "class"}], "links": [{"source": "a", "target": "b", "relation": "co-uses"}, {"source": "a", "target": "b", "relation": "calls"}]}
    (tmp_path / "partial.json").write_text(json.dumps(doc))
    nodes, edges, partial = files.best_graph(spark, str(tmp_path / "full.json"), str(tmp_path / "partial.json"))
    assert partial and nodes.count() == 2 and edges.count() == 2 and files.best_graph(spark, str(tmp_path / "x"), str(tmp_path / "y")) is None
    lines = [r.line for r in sinks.graphml(nodes, edges).orderBy("part").collect()]
    root = ET.fromstring("".join(lines))
    assert len(root.findall(".//{*}node")) == 2 and len(root.findall(".//{*}edge")) == 1
    text = "\n".join(r.line for r in sinks.cypher(nodes, edges).collect())
    assert "CO_USES" in text and "B\\'s" in text
    assert json.loads(sinks.canvas(nodes, edges).where("part = 0").orderBy("line").collect()[1].line)["x"] == 300
    assert "| a |" in sinks.markdown_report({"Nodes": nodes.select("id")})


def test_logs_and_manifests(spark, tmp_path):
    (tmp_path / "calls.jsonl").write_text('{"name": "q", "args": "{}", "result_preview": "x", "token_est": 3, "timestamp": "t"}\n\nnot json\n')
    assert [r.token_est for r in files.read_calls(spark, str(tmp_path / "calls.jsonl")).collect()] == [3]
    m = spark.createDataFrame([("a/package.json", '{"dependencies": {"x": "^1.2"}, "devDependencies": {"y": "~2"}}'), ("requirements.txt", "flask>=2.0\n# c\nnumpy\n")], "path string, content string")
    assert {(r.name, r.version) for r in files.dependencies(m).collect()} == {("x", "1.2"), ("y", "2"), ("flask", "2.0"), ("numpy", "")}
    q = spark.createDataFrame([('["a?", {"question": "b?"}]',)], "content string")
    assert {r.question for r in files.questions(q).collect()} == {"a?", "b?"}
    log = spark.createDataFrame([("@h1|Ann|2024-01-02|fix: a|b\nx.py\ny.py\n\n@h2|Bo|2024-01-03|add\nx.py\n",)], "content string")
    assert {(r.commit, r.subject, r.file) for r in files.commit_log(log).collect()} == {("h1", "fix: a|b", "x.py"), ("h1", "fix: a|b", "y.py"), ("h2", "add", "x.py")}
    d = spark.createDataFrame([("diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@ def foo(a):\n+x\n",)], "content string")
    assert [(r.file, r.function) for r in files.changed_functions(d).collect()] == [("x.py", "foo")]
    s = spark.createDataFrame([('{"a.py": [{"name": "F", "kind": 12}, {"name": "Q", "kind": 99}]}',)], "content string")
    assert {(r.id, r.type) for r in files.lsp_symbols(spark, s).collect()} == {("a.py::F", "function"), ("a.py::Q", "symbol")}


def test_cost_view_keeps_halves(spark):
    report = spark.createDataFrame([(124.5 / 1e6, 2.0, 0.0), (1.5 / 1e6, 0.0, 0.0), (0.0, 5.0, 0.0)], "naive_cost_usd double, total_input_tokens double, total_output_tokens double")
    assert [(r.naive_tokens, r.tokens_saved) for r in files.cost_view(report).collect()] == [(42, 40), (1, 1), (0, 0)]
