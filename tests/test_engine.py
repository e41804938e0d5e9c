"""The facade, the build, the stores and the parsers."""

import difflib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.engine import Engine
from tessera.functions import code, text
from tessera.operators import build, fragments, guard, parse, types
from tessera.sources import files, sinks
from tessera.sources.store import Store


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([("a", "Auth", "class", "a.py", None, "Signs people in", 0), ("b", "Store", "class", "b.py", None, "Keeps rows", 1), ("c", "Lonely", "class", "c.py", None, None, 1), ("m", "app", "module", "a.py", None, "python module: app", 0)], "id string, label string, type string, file string, lang string, summary string, community int")
    edges = spark.createDataFrame([("a", "b", "uses"), ("m", "a", "defines"), ("m", "b", "defines")], "src string, dst string, relation string")
    return nodes, edges


def test_engine(spark, small, tmp_path):
    nodes, edges = small
    told = []
    e = Engine(nodes, edges, store=Store(spark, str(tmp_path)), log_call=lambda name, args: told.append(name))
    ask = lambda q: e.tool("query_graph", question=q)
    assert [r.id for r in ask("who calls Store?").collect()] == ["a", "m"]
    assert [r.id for r in ask("show dead code").collect()] == ["c"]
    assert [r.path for r in ask("path from app to Store").collect()] == [["m", "b"]] and ask("how does Store connect to app").first().id is not None
    assert ask("which people sign").first().id == "a"
    assert [r.id for r in e.tool("get_dependencies", node="a").collect()] == ["b"]
    e.tool("remember", category="x", entry="1")
    assert [r.text for r in e.tool("remember", category="x", entry="2").collect()] == ["1", "2"]
    assert Engine(nodes, edges, store=Store(spark, str(tmp_path))).tool("recall", category="x").count() == 2  # it outlives the engine
    r = e.tool("validate_import", module="app", symbol="Stor").first()
    assert (r.valid, r.severity, r.close) == (False, "warning", "Store") and e.tool("validate_import", module="app", symbol="Auth").first().valid
    first = e.ask("which people sign")
    assert "**Auth**" in first and "uses Store" in first and e.ask("Which people sign ?") == first and e.ask("people sign which") == first
    assert {r.key: r.hits for r in e.store.questions().collect()}.popitem()[1] == 2
    assert e.context("which people sign").startswith("Codebase subgraph (") and "└─ uses → Store" in e.context("which people sign")
    one = e.tool("create_checkpoint", task="t", description="one", files=("a.py",), tokens=5).first()
    two = e.tool("create_checkpoint", task="t", description="two", tokens=7).first()
    assert one.parent is None and two.parent == one.checkpoint
    assert e.tool("rollback_to_checkpoint", checkpoint=two.checkpoint).first()[0] == 1
    p = e.tool("get_task_progress", task="t").first()
    assert (p.checkpoints, p.active, p.rolled_back, p.tokens) == (2, 1, 1, 12) and e.tool("list_checkpoints", task="t").count() == 2
    e.tool("learn_from_accept", diff="+++ b/test_x.py\n", description="be quick")
    assert "be quick" in {r.rule for r in e.tool("get_applicable_rules", path="test_y.py").collect()}
    assert len(e.tools) == 24 and "remember" in told and "remember" not in Engine(nodes, edges, disabled=("memory",)).tools


def test_vectors_make_seeds(spark, small):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "vec_id string, embedding array<double>")
    e = Engine(*small, vectors=vectors, embed=lambda q: [0.1, 0.9])
    assert e.seeds("anything")[1].first().id == "b"


def _repository(root):
    body = {
        "app/au.py": "import os\nfrom app.db import Store\n\nclass Login(Base):\n    \"\"\"Signs people in. Well.\"\"\"\n\ndef check(user: str) -> bool:\n    return True\n",
        "app/db.py": "class Store:\n    pass\n",
        "web/main.ts": "import { a } from './lib'\nexport function start(x: number): void {}\n",
        "README.md": "# Title\n\nWhat it is about.\n\n## Use\n\n[more](docs/a.md)\n",
        "package.json": '{"name": "x", "dependencies": {"left": "^1"}}',
        "gen/x_pb2.py": "class Gone: pass\n",
        "node_modules/y.js": "class Gone {}\n",
        "notes.adoc": "free text\n",
    }
    for name, content in body.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)


def test_build(spark, tmp_path):
    root, out = tmp_path / "repo", str(tmp_path / "out")
    root.mkdir()
    _repository(root)
    b = build.build_graph(spark, str(root), out, force=True)
    n = {r.id: r for r in b.nodes.collect()}
    assert n["app/au.py::Login"].summary == "Signs people in." and n["app/au.py::check"].summary.endswith("| sig: (user: str) -> bool")
    assert {"app/au.py", "app/db.py::Store", "web/main.ts::start", "README.md::Use", "pkg:left", "doc::notes.adoc", "Base"} <= set(n) and not any("Gone" in i for i in n)
    assert all(r.community is not None for r in n.values())
    e = {(r.src, r.dst, r.relation) for r in b.edges.collect()}
    assert {("app/au.py::Login", "Base", "extends"), ("web/main.ts", "web/lib", "imports"), ("README.md", "docs/a.md", "references")} <= e
    store = Store(spark, out)
    assert store.status()["percent"] == 100 and store.load_diff().where("change = 'added' and what = 'node'").count() == len(n)
    assert "Best connected" in store.read_text("GRAPH_REPORT.md") and "app/db.py" in store.read_text("graph.html")
    assert files.read_graph(spark, f"{out}/graph.json/nodes")[0] is not None
    (root / "app/db.py").write_text("class Shop:\n    pass\n")
    again = build.build_graph(spark, str(root), out, force=True, viz=False)
    assert {(r.id, r.change) for r in store.load_diff().where("what = 'node'").collect()} == {("app/db.py::Store", "removed"), ("app/db.py::Shop", "added")}
    assert again.counts["nodes"] == len(n)
    assert json.loads(cli.run(spark, ["--out", out, "build-status"]))["status"] == "complete"
    assert "Shop" in cli.run(spark, ["--out", out, "query", "what is Shop"])
    assert cli.run(spark, ["--out", out, "export", "cypher", str(tmp_path / "g")]).endswith("g") and spark.read.text(str(tmp_path / "g")).count() == again.counts["nodes"] + again.counts["edges"]
    assert json.loads(cli.run(spark, ["--out", out, "benchmark", str(root)]))["raw_tokens"] > 0


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.read("calls").count() == 0 and s.status()["status"] == "idle" and s.memory_text() == "" and s.load_diff() is None
    assert s.write_block("X.md", "one") and not s.write_block("X.md", "one") and s.write_block("X.md", "two")
    body = s.read_text("X.md")
    assert body.count("<!-- context:start -->") == 1 and "two" in body and "one" not in body
    assert s.write_status("building", 3, 10, "t")["percent"] == 30 and s.write_status("complete", 3, 10, "t")["percent"] == 100
    s.append("packages", [("a@1", "a", "1", "{}", None, False), ("b@1", "b", "1", "{}", None, False)])
    s.append("packages", [("a@1", None, None, None, None, True)])
    s.evict_packages(1)
    assert [r.key for r in s.packages().collect()] == ["a@1"]
    d = spark.createDataFrame([("p", "x"), ("q", "y")], "path string, content string")
    s.save_extractions(d.select(F.sha2(F.col("content").cast("binary"), 256).alias("hash"), "path", F.lit("{}").alias("extraction")))
    s.forget_extractions(d.where("path = 'p'"))
    assert [r.path for r in s.cached_extractions(d)[0].collect()] == ["q"]
    assert {r.store: (r.entries, r.hits) for r in s.stats().collect()} == {"questions": (0, 0), "packages": (1, 0), "extractions": (1, 0)}
    s.append("spend", [("s", "t", 90, 100, None)])
    assert s.budget().first().spent == 90
    s.append("memory", [("tasks", "do it", None)])
    assert s.memory_text().endswith("**Tasks:**\n- do it")


def test_documents(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>One &amp; all</w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve">Body </w:t><w:t>text</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Two</w:t></w:r></w:p>')
    (tmp_path / "b.docx").write_bytes(b"no zip")
    d = files.document_text(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2]: r.content for r in d.collect()}
    assert got == {"a.docx": "# One & all\nBody text\n# Two", "b.docx": None}
    f = fragments.docx(d.where("content is not null").withColumn("path", F.lit("a.docx")))
    assert {(r.src, r.dst) for r in f.edges.collect()} == {("a.docx", "a.docx::One & all"), ("a.docx::One & all", "a.docx::Two")} and f.nodes.where("type = 'doc'").first().summary == "Body text"
    p = fragments.pdf(spark.createDataFrame([("x.pdf", "1. INTRODUCTION\nSome words that are long enough to count here.\nRELATED WORK\n")], "path string, content string"))
    assert {r.label for r in p.nodes.where("type = 'concept'").collect()} == {"INTRODUCTION", "RELATED WORK"}
    w = spark.createDataFrame([(".github/workflows/ci.yml", "on: push\njobs:\n  test:\n    runs-on: ubuntu\n    steps:\n      - run: x\n  lint:\n    runs-on: mac\n")], "path string, content string")
    assert {(r.label, r.summary) for r in fragments.parse(w).nodes.collect()} == {("ci", "GitHub Actions: 2 jobs"), ("test", "CI job on ubuntu"), ("lint", "CI job on mac")}
    t = spark.createDataFrame([("tsconfig.json", '{"compilerOptions": {"target": "es6", "paths": {"@a/*": ["src/a/*"]}}}'), ("x.schema.json", '{"title": "T", "properties": {"p": {"type": "string"}}}'), ("a.yaml", "one: 1\ntwo:\n  - x\n"), ("b.toml", "[tool]\nx = 1\n[other.y]\n")], "path string, content string")
    got = {r.id: r.summary for r in fragments.parse(t).nodes.collect()}
    assert got == {"tsconfig.json": "TypeScript config: target=es6, module=?", "tsconfig.json::alias:@a/*": "TS path alias → src/a/*", "x.schema.json": "JSON Schema with fields: p", "x.schema.json::p": "string field", "a.yaml": "YAML config: one, two", "b.toml": "TOML config: sections=tool, other"}
    batch = spark.createDataFrame([(1, "a"), (1, "b")], "batch int, path string")
    n = spark.createDataFrame([(1, "x", "b"), (1, "y", "zzz"), (1, "z", None)], "batch int, id string, file string")
    assert {(r.path, r.id) for r in fragments.split_batch(n, n, batch).collect()} == {("b", "x"), ("a", "y"), ("a", "z")}


def test_types_and_guards(spark):
    d = spark.createDataFrame([("a.d.ts", "export declare function f(x: T): Promise<U>;\nclass C { get(k: string): V }"), ("b.ts", "function g(): void {}"), ("c.py", "def broken(:\n"), ("d.py", "async def h(a, *, b=1):\n  def inner() -> int: ...\n")], "path string, content string")
    assert {(r.key, r.signature) for r in types.typescript_types(d).collect()} == {("a.d.ts::f", "(x: T): Promise<U>"), ("a.d.ts::get", "(k: string): V")}
    assert {(r.key, r.signature) for r in types.python_types(d).collect()} == {("d.py::h", "(a)"), ("d.py::inner", "() -> int")}
    known = spark.createDataFrame([("m", n) for n in ("loads", "load", "dump", "_hidden")], "module string, symbol string")
    wanted = spark.createDataFrame([("m", "laods"), ("m", "load"), ("n", "x")], "module string, symbol string")
    assert {(r.symbol, r.rank, r.name) for r in guard.suggestions(wanted, known).collect()} == {("laods", 1, "loads"), ("laods", 2, "load")}
    layers = spark.createDataFrame([("a/conf.py", ["x"]), ("a/b.py", ["fastapi.x"]), ("t_test.py", []), ("x.js", ["flask"]), ("y.py", ["..z", "bokeh"])], "p string, i array<string>")
    assert [r.l for r in layers.select(code.layer(F.col("p"), F.col("i")).alias("l")).collect()] == ["config", "api", "test", "unknown", "ui"]


def test_suggestions_are_those_of_all_pairs(spark):
    import difflib
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdé_XY") for _ in range(r.randrange(1, 12)))
    known = sorted({(f"m{r.randrange(2)}", word()) for _ in range(150)})
    wanted = sorted({(f"m{r.randrange(3)}", word()) for _ in range(60)} - set(known))
    frame = lambda rows: spark.createDataFrame(rows, "module string, symbol string")
    want = set()
    for m, s in wanted:
        near = [(difflib.SequenceMatcher(None, n, s).ratio(), n) for k, n in known if k == m and not n.startswith("_")]
        want |= {(m, s, i + 1, n) for i, (_, n) in enumerate(sorted((x for x in near if x[0] >= 0.6), reverse=True)[:3])}
    assert {tuple(x) for x in guard.suggestions(frame(wanted), frame(known)).collect()} == want and len(want) > 20


def test_compression(spark):
    rows = [
        ("a.md", "![CI](x)\n[![License: MIT](y)](z)\n# T\n\n\n\n## Installation\npip\n\nmore\n## Use\nit \n", "# T\n\n## Use\nit\n"),
        ("a.py", "# Copyright X\n# all\nimport a\nfrom b import c\n\nx = 1\n    # increment counter\n    counter += 1\n", "# imports: a, b, c\n\nx = 1\n    counter += 1\n"),
        ("a.pdf", "Page\none\nPage\n\n\n\ntwo\nPage\n", "one\n\ntwo\n"),
        ("a.js", "/* MIT License */\nlet x\n", "let x\n"),
    ]
    d = spark.createDataFrame(rows, "p string, t string, want string")
    for r in d.select("p", "want", text.compressed(F.col("t"), F.col("p")).alias("got")).collect():
        assert r.got == r.want, r.p
    js = spark.createDataFrame([("function f(a) {\n  return { a }\n}\nexport class X {\n y\n}\n",)], "t string")
    assert js.select(text.signatures_only(F.col("t"))).first()[0] == "function f(a)  { ... }\nexport class X  { ... }\n"


def test_small_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"naive_cost_usd": 0.3, "total_input_tokens": 10000, "total_output_tokens": 5000, "cache_hits": 3}')
    r = files.cost_report(spark, str(tmp_path / "c.json")).first()
    assert (r.naive_tokens, r.actual_tokens, r.tokens_saved, r.compression_pct, r.cache_hits, r.calls_saved) == (100_000, 15_000, 85_000, 85, 3.0, 0.0)
    (tmp_path / "b.jsonl").write_text('{"s": 1}\n\n{"q": 1}\n{"q": 2}\n')
    head, rest = files.benchmark_results(spark, str(tmp_path / "b.jsonl"))
    assert head.first().json == '{"s": 1}' and [x.json for x in rest.orderBy("i").collect()] == ['{"q": 1}', '{"q": 2}']
    assert files.git(str(tmp_path), "status") is None
    assert build.is_unchanged(str(tmp_path), Store(spark, str(tmp_path))) is False
    n = spark.createDataFrame([("a", "</script>", "t")], "id string, label string, type string")
    e = spark.createDataFrame([("a", "a", "r")], "src string, dst string, relation string")
    assert sinks.html_view(n, e).count("</script>") == 1


def test_parsers(spark):
    f = spark.createDataFrame(
        [
            ("a/package.json", '{"dependencies": {"x": "1"}, "scripts": {"go": "y"}}'),
            ("docker-compose.yml", "version: 3\nservices:\n  web:\n    image: z\n  db:\n    image: p\nvolumes:\n  v:\n"),
            (".env", "A_KEY=1\n# c\nexport B=2\n"),
            ("Dockerfile", "FROM python:3\nEXPOSE 80\n"),
            ("pyproject.toml", '[project]\ndependencies = [\n "flask>=2",\n]\n'),
        ],
        "path string, content string",
    )
    ids = {r.id for r in fragments.parse(f).bare().nodes.collect()}
    assert {"pkg:x", "a/package.json::script:go", "docker-compose.yml::svc:web", "docker-compose.yml::svc:db", ".env::A_KEY", "docker:python:3", "pkg:flask"} <= ids
    api = spark.createDataFrame([("api.json", '{"openapi": "3", "paths": {"/u": {"get": {"responses": {"200": {"content": {"x": {"schema": {"$ref": "#/components/schemas/User"}}}}}}}}, "components": {"schemas": {"User": {}}}}')], "path string, content string")
    found = fragments.parse(api).bare()
    assert {r.id for r in found.nodes.collect()} == {"api.json", "api.json::GET:/u", "api.json::schema:User"} and ("api.json::GET:/u", "api.json::schema:User", "returns") in {tuple(r) for r in found.edges.collect()}
    js = spark.createDataFrame([("a.js", "const x = await import('./late');\nimport {y} from 'pkg';\nrequire('old')")], "path string, content string")
    assert {r.dst for r in fragments.parse(js).edges.where("relation = 'imports'").collect()} == {"late", "pkg:pkg", "pkg:old"}
    src = spark.createDataFrame([("m.py", 'def load(x):\n    """Loads the rows. And more."""\n'), ("m.rs", "/// Adds two numbers.\npub fn add() {}\n"), ("m.ts", "/** Starts it all. */\nexport function start() {}\n")], "path string, content string")
    docs = {r.name: r.doc for r in parse.docstrings(src, code.language(F.col("path"))).collect()}
    assert docs == {"load": "Loads the rows.", "add": "Adds two numbers.", "start": "Starts it all."}
    g = spark.createDataFrame([("x/yarn.lock", ""), ("a.py", "# Generated by y\n"), ("b.py", "x = 1"), ("c.ts", "says it is generated by hand")], "p string, c string")
    assert [r.g for r in g.select(parse.is_generated(F.col("p"), F.col("c")).alias("g")).collect()] == [True, True, False, False]


def test_suggestions_try_few_names(monkeypatch):
    """Of names that share most characters only those are compared that may be among the best."""
    names, symbols = [f"Part#{i:06d}" for i in range(3000)], [f"no_Part#{i:06d}" for i in range(0, 3000, 150)]
    real, tried = difflib.SequenceMatcher, []
    want = {s: sorted(((real(None, n, s).ratio(), n) for n in names), reverse=True)[:3] for s in symbols}
    monkeypatch.setattr(guard.difflib, "SequenceMatcher", lambda *a: tried.append(a) or real(*a))
    got = {}
    for symbol, name, ratio in guard.closest(symbols, names, 3, 0.6):
        got.setdefault(symbol, []).append((ratio, name))
    assert got == want
    assert len(tried) < len(symbols) * len(names) / 20
