"""Incremental and progressive builds: only what changed is parsed, and the result is a full build's."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import build, fragments, increment
from tessera.sources.store import Store
from tessera.streaming import progressive

FILES = {
    "app/au.py": "import os\nimport flask\nfrom app.db import Store\n\nclass Login(Base):\n    \"\"\"Signs people in. Well.\"\"\"\n\ndef check(user: str) -> bool:\n    return True\n",
    "app/db.py": "import flask\nclass Store:\n    pass\n",
    "web/main.ts": "import { a } from './lib'\nexport function start(x: number): void {}\n",
    "README.md": "# Title\n\nWhat it is about.\n\n## Use\n\n```python\n```\n",
    "a/package.json": '{"name": "x", "dependencies": {"left": "^1"}}',
    "b/package.json": '{"name": "y", "dependencies": {"left": "^0"}}',
    "gen/x_pb2.py": "class Gone: pass\n",
    "notes.adoc": "free text\n",
    "void.txt": "",
}


@pytest.fixture
def root(tmp_path):
    for name, content in FILES.items():
        (tmp_path / "repo" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / name).write_text(content)
    return tmp_path / "repo"


def graph_of(nodes, edges):
    n = nodes.drop("community", "is_partial")
    return sorted(map(tuple, n.select(*sorted(n.columns)).collect()), key=str), sorted((r.src, r.dst, r.relation) for r in edges.collect())


def full(spark, root, out):
    s = Store(spark, str(out))
    increment.update(s, str(root))
    return graph_of(*increment.settle(s))


def test_only_what_changed_is_parsed(spark, root, tmp_path):
    s = Store(spark, str(tmp_path / "g"))
    same = lambda name: graph_of(*increment.settle(s)) == full(spark, root, tmp_path / name)
    first = increment.update(s, str(root))
    assert (first.files, first.read, first.parsed, first.removed) == (8, 8, 7, 0)  # the empty file isn't listed, the generated one not parsed
    again = increment.update(s, str(root))
    assert (again.read, again.parsed, again.removed) == (0, 0, 0)
    (root / "app/db.py").write_text("class Shop:\n    pass\n")
    one = increment.update(s, str(root))
    assert (one.read, one.parsed) == (1, 1) and same("f1")
    (root / "b/package.json").unlink()  # the version of a shared package falls back to what is left
    (root / "app/au.py").unlink()
    two = increment.update(s, str(root))
    assert (two.read, two.parsed, two.removed) == (0, 0, 2) and same("f2")
    assert {r.id: r.summary for r in increment.settle(s)[0].where("id = 'pkg:left'").collect()} == {"pkg:left": "npm left@^1"}
    (root / "app/db.py").write_text(FILES["app/db.py"])  # a content that was parsed before
    os.utime(root / "README.md", (10**9, 10**9))  # another time, the same content
    three = increment.update(s, str(root))
    assert (three.read, three.parsed) == (2, 0) and same("f3")
    forced = increment.update(s, str(root), force=True)
    assert (forced.read, forced.parsed) == (6, 0) and same("f4")
    before = graph_of(*increment.settle(s))
    increment.rebuilt(s)
    increment.forget_old(s)
    assert graph_of(*increment.settle(s)) == before and s.read("parsed").count() == 5
    for f in list(FILES)[:8]:
        (root / f).unlink(missing_ok=True)
    (root / "void.txt").unlink()
    assert increment.update(s, str(root)).removed == 6 and increment.settle(s)[0].isEmpty()


def test_build_uses_it(spark, root, tmp_path):
    out = str(tmp_path / "g")
    assert build.build_graph(spark, str(root), out, viz=False).counts["parsed"] == 7
    (root / "app/db.py").write_text("class Shop:\n    pass\n")
    b = build.build_graph(spark, str(root), out, viz=False)
    assert (b.counts["read"], b.counts["parsed"], b.counts["files"]) == (1, 1, 7)
    assert {(r.id, r.change) for r in Store(spark, out).load_diff().where("what = 'node'").collect()} == {("app/db.py::Store", "removed"), ("app/db.py::Shop", "added")}
    assert build.build_graph(spark, str(root), out, force=True, viz=False).counts["parsed"] == 7


def test_named_changes_only(spark, root, tmp_path):
    s = Store(spark, str(tmp_path / "g"))
    increment.update(s, str(root))
    for f in ("app/db.py", "README.md"):
        (root / f).write_text("# Other\n")
    named = spark.createDataFrame([("app/db.py", "changed"), ("web/main.ts", "deleted")], "path string, state string")
    assert increment.update(s, str(root), only=named).read == 1 and increment.update(s, str(root)).read == 1


def test_extractions_are_kept(spark, root, tmp_path):
    asked = []

    def extract(files):
        asked.extend(r.path for r in files.collect())
        nodes = files.select(F.concat(F.lit("x:"), "path").alias("id"), F.col("path").alias("label"), F.lit("doc").alias("type"), F.col("path").alias("file"), F.lit(None).cast("string").alias("lang"), F.lit("from a model").alias("summary"))
        return fragments.Fragments(nodes, files.select(F.col("path").alias("src"), F.lit("topic").alias("dst"), F.lit("about").alias("relation")))

    out = str(tmp_path / "g")
    b = build.build_graph(spark, str(root), out, extract=extract, viz=False)
    assert asked == ["notes.adoc"] and b.nodes.where("id = 'x:notes.adoc'").first().summary == "from a model" and b.edges.where("dst = 'topic'").count() == 1
    build.build_graph(spark, str(root), out, extract=extract, force=True, viz=False)
    assert asked == ["notes.adoc"]  # the same content is not sent again
    (root / "notes.adoc").write_text("other text\n")
    build.build_graph(spark, str(root), out, extract=extract, viz=False)
    assert asked == ["notes.adoc"] * 2


def test_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.append("memory", [("a", str(i), None) for i in range(3)])
    old = s.read("memory")
    s.replace("memory", old.where("text <> '1'"))
    held = s.read("memory")
    (tmp_path / "memory.versions" / "000000009" / "_temporary").mkdir(parents=True)  # a write that broke off
    assert {r.text for r in held.collect()} == {"0", "2"} == {r.text for r in s.read("memory").collect()}
    s.append("memory", [("a", "3", None)])
    s.replace("memory", s.read("memory").where("text <> '0'"))
    assert {r.text for r in held.collect()} >= {"0", "2"}  # who began to read the version before can go on
    assert {r.text for r in s.read("memory").collect()} == {"2", "3"} and s.at("memory").endswith("000000010")
    for i in range(70):
        s.append("memory", [("b", str(i), None)])
    assert s.read("memory").count() == 72 and len(list((tmp_path / s.at("memory")).glob("part-*"))) < 70


def test_progressive(spark, root, tmp_path):
    out = str(tmp_path / "g")
    s = Store(spark, out)
    assert progressive.read(s) is None
    batches = []
    merge = progressive.merge_batch(s)

    def watched(batch, i):
        merge(batch, i)
        merge(batch, i)  # a batch that runs again changes nothing
        g = progressive.read(s)
        batches.append(({r.path for r in batch.collect()}, g.is_partial, graph_of(g.nodes, g.edges)))

    q = progressive.file_stream(spark, str(root), 3).writeStream.foreachBatch(watched).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None and len(batches) == 3
    seen = set()
    for k, (paths, partial, graph) in enumerate(batches):
        seen |= paths
        part = tmp_path / f"part{k}"
        for p in seen:
            (part / p).parent.mkdir(parents=True, exist_ok=True)
            (part / p).write_text(FILES[p])
        assert partial and graph == full(spark, part, tmp_path / f"full{k}")


def test_progress_is_told(spark, root, tmp_path, monkeypatch):
    told = []
    init = progressive.Progress.__init__
    monkeypatch.setattr(progressive.Progress, "__init__", lambda self, *a: (init(self, *a), told.append(self))[0])
    b = progressive.build_progressively(spark, str(root), str(tmp_path / "g"), at_once=3)
    seen = told[0].seen
    assert seen == sorted(seen) and seen[0] == 0 and seen[-1] == 100 and len(set(seen)) >= 3
    g = progressive.read(Store(spark, str(tmp_path / "g")))
    assert not g.is_partial and graph_of(g.nodes, g.edges) == full(spark, root, tmp_path / "f") and b.counts["parsed"] == 8
