"""Operators on small frames with known results."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import code, text
from tessera.operators import graph, ledger, search, traverse
from tessera.operators.keep import keep


@pytest.fixture(scope="module")
def impact_graph(spark):
    nodes = spark.createDataFrame(
        [("api", "APIRouter", 0, "api.py"), ("auth", "AuthService", 0, "auth.py"), ("session", "SessionMgr", 1, "session.py"), ("db", "DBClient", 1, "db.py"), ("admin", "AdminPanel", 0, "admin.py"), ("billing", "BillingModule", 2, "billing.py")],
        "id string, label string, community int, file string",
    ).withColumn("type", F.lit("class"))
    edges = spark.createDataFrame([("api", "auth", "uses"), ("auth", "session", "calls"), ("session", "db", "reads"), ("admin", "auth", "uses"), ("billing", "db", "uses")], "src string, dst string, relation string")
    return nodes, edges


def test_impact(impact_graph):
    nodes, edges = impact_graph
    got = {(r.id, r.hop): r.risk for r in traverse.impact(nodes, edges, "db", 3).collect()}
    assert got == {("auth", 2): 0.6, ("session", 1): 0.55, ("billing", 1): 0.5, ("admin", 3): 0.2333, ("api", 3): 0.2333}
    r = traverse.impact_rollup(traverse.impact(nodes, edges, "db", 3)).first()
    assert (r.affected, r.high, r.medium, r.low) == (5, 0, 3, 2)
    assert traverse.impact(nodes, edges, "api", 3).count() == 0


def test_cycles_and_components(spark, impact_graph):
    nodes, edges = impact_graph
    loop = edges.unionByName(spark.createDataFrame([("db", "api", "uses"), ("x", "y", "uses")], edges.schema))
    assert {r.id for r in traverse.reverse_bfs(loop, nodes.where("id = 'db'").select("id"), 9).collect()} == {"auth", "session", "billing", "admin", "api"}
    ids = nodes.select("id").unionByName(spark.createDataFrame([("x",), ("y",), ("z",)], "id string"))
    got = {r.id: r.component for r in traverse.connected_components(ids, loop, keep).collect()}
    assert got == dict.fromkeys("api auth session db admin billing".split(), "admin") | {"x": "x", "y": "x", "z": "z"}


def test_merge(spark):
    f = spark.createDataFrame([("auth:login", "login", "function", "auth.py", None, "Authenticate.", None, 1), ("db:connect", "connect", "function", "db.py", None, "Open.", None, 2)], "id string, label string, type string, file string, lang string, summary string, community int, ord int")
    e = spark.createDataFrame([("auth:login", "external:bcrypt", "imports"), ("auth:login", "db:connect", "calls"), ("auth:login", "db:connect", "calls"), ("a", "a", "calls")], "src string, dst string, relation string")
    nodes, edges = graph.merge_fragments(f, e)
    assert {(r.id, r.type) for r in nodes.collect()} == {("auth:login", "function"), ("db:connect", "function"), ("external:bcrypt", "external")}
    assert edges.count() == 2


def test_diff(spark):
    a = spark.createDataFrame([("x", "s", "t"), ("y", None, "t"), ("z", "s", "t")], "id string, summary string, type string")
    b = spark.createDataFrame([("x", "s2", "t"), ("y", None, "t"), ("w", "s", "t")], "id string, summary string, type string")
    assert {(r.id, r.change) for r in graph.diff_nodes(a, b).collect()} == {("x", "changed"), ("z", "removed"), ("w", "added")}


def test_redaction(spark):
    hexes = "0123456789abcdef" * 2 + "01234567"
    rows = [("token = " + hexes, "high_entropy_hex"), ("sk" + "-" + "a1B2" * 6, "openai_key"), ("AK" + "IA", None), ("my pass" + 'word = "' + "x" * 9 + '"', "password_assignment"), ("short pass" + 'word="abc"', None)]
    df = spark.createDataFrame(rows, "t string, rule string")
    for r in df.select("rule", text.rule_counts(F.col("t")).alias("c"), text.scrub(F.col("t")).alias("s")).collect():
        assert [x.rule for x in r.c if x.n] == ([r.rule] if r.rule else [])
    once = df.select(text.scrub(F.col("t")).alias("t"))
    assert [r.a for r in once.select((text.scrub(F.col("t")) == F.col("t")).alias("a")).collect()] == [True] * len(rows)


def test_debounce_and_budget(spark):
    df = spark.createDataFrame([(i, 1, "a", t, 10) for i, t in enumerate(("00:00:00", "00:00:01", "00:00:02", "00:00:03.5", "00:00:04"))], "call long, session long, tool string, t string, tokens long").withColumn("ts", F.concat(F.lit("2024-01-01 "), "t").cast("timestamp"))
    assert sorted(r.call for r in ledger.debounce(df, "session", 2.0).collect()) == [0, 2, 4]
    assert ledger.budget(df, 50).first().status == "EXCEEDED" and ledger.budget(df, 60).first().status == "WARNING" and ledger.budget(df, 100).first().status == "OK"


def test_text(spark):
    df = spark.createDataFrame([("# A\nfoo\n\n\n\nbar  \nfoo\nfoo\nlast",)], "t string")
    r = df.select(text.collapse_blank(text.strip_line_ends(F.col("t"))).alias("c"), text.repeated_lines_removed(F.col("t")).alias("r"), text.headings(F.col("t")).alias("h")).first()
    assert r.c == "# A\nfoo\n\nbar\nfoo\nfoo\nlast" and r.r == "# A\n\n\n\nbar  \nlast" and [(x.level, x.title) for x in r.h] == [(1, "A")]


def test_next_fit_and_packages(spark):
    d = spark.createDataFrame([(1, 60), (2, 50), (3, 40), (4, 200), (5, 10)], "id long, tokens long")
    got = {r.id: r.batch for r in search.next_fit(d, 100).collect()}
    assert got == {4: 0, 1: 1, 2: 2, 3: 2, 5: 2}
    m = spark.createDataFrame([("./a",), ("@x/y/z",), ("lodash/fp",)], "m string").select(code.package_of(F.col("m")).alias("p"))
    assert [r.p for r in m.collect()] == ["./a", "pkg:@x/y", "pkg:lodash"]


def test_similar_pairs_lose_no_link(spark):
    """Templates of which nearly all buckets are mixed, chains, and a large group of near copies, against all pairs."""
    import random

    r = random.Random(7)
    rows = []
    for t in range(3):
        common = [f"t{t}w{i}" for i in range(40)]
        for g in range(6):
            own = [f"t{t}g{g}w{i}" for i in range(14)]
            rows += [common + own + [f"x{r.random()}" for _ in range(r.randint(0, 3))] for _ in range(4)]
    chain = [f"c{i}" for i in range(60)]
    rows += [chain[i : i + 30] for i in range(0, 30, 2)]
    big = [f"b{i}" for i in range(50)]
    rows += [[*big, f"y{i}"] for i in range(120)]
    sets = [set(x) for x in rows]
    d = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "id long, s array<string>")
    got = search.similar_pairs(d, 0.82).collect()
    jac = lambda a, b: len(a & b) / len(a | b)
    assert all(x.a < x.b and jac(sets[x.a], sets[x.b]) >= 0.82 for x in got)

    def groups(pairs):
        head = list(range(len(sets)))

        def find(i):
            while head[i] != i:
                i = head[i]
            return i

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            head[b] = a
        return [find(i) for i in range(len(sets))]

    want = [(i, j) for i in range(len(sets)) for j in range(i) if jac(sets[i], sets[j]) >= 0.82]
    assert groups((x.a, x.b) for x in got) == groups(want)
    assert len(got) < len(want)


def test_representatives_estimate_pairs(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, 1, "long text", base), (1, 2, "short", base), (1, 3, "mid one", base[:55] + ["z"]), (2, 9, "alone", ["q"])]
    d = spark.createDataFrame(rows, "component long, id long, text string, s array<string>")
    r = search.representatives(d).collect()
    pairs = [1.0, 55 / 61, 55 / 61]
    assert len(r) == 1 and (r[0].representative, r[0].members) == (1, 3) and abs(r[0].similarity - sum(pairs) / 3) < 0.06


def test_next_fit_is_one_packing(spark):
    import random

    r = random.Random(1)
    for cap in (50, 97):
        sizes = [r.randint(0, 120) for _ in range(400)]
        d = spark.createDataFrame(list(enumerate(sizes)), "id long, tokens long").repartition(5)
        got = {x.id: x.batch for x in search.next_fit(d, cap).collect()}
        batch, used, want = -1, cap + 1, {}
        for i in sorted(range(400), key=lambda i: (-sizes[i], i)):
            if used + sizes[i] > cap or used > cap:
                batch, used = batch + 1, 0
            used += sizes[i]
            want[i] = batch
        assert got == want


def test_louvain_finds_planted_groups(spark):
    from tessera.operators import communities

    rows = []
    for g in range(5):
        m = [f"g{g}n{i}" for i in range(8)]
        rows += [(a, b, "r") for i, a in enumerate(m) for b in m[i + 1 :]]
        rows.append((m[0], f"g{(g + 1) % 5}n1", "r"))
    e = spark.createDataFrame(rows, "src string, dst string, relation string")
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().unionByName(spark.createDataFrame([("alone",)], "id string"))
    found = {r.id: r.community for r in communities.louvain(ids, e, 2, 4).collect()}
    assert all(found[f"g{g}n{i}"] == f"g{g}n0" for g in range(5) for i in range(8)) and found["alone"] == "alone"
    q = lambda df: communities.modularity(df, e).first().q
    two_m = 2 * len(rows)
    assert q(ids.withColumn("community", F.substring("id", 1, 2))) == pytest.approx(5 * (2 * 28 / two_m - (58 / two_m) ** 2))
    n = ids.withColumns({"community": F.lit(3), "file": F.lit("f")})
    assert communities.cluster(n, e, previous=41) is n  # hardly changed: communities stay
    again = communities.cluster(n, e, previous=10)
    assert again.select("community").distinct().count() == 6 and again.where("id = 'alone'").first().community == 5


def test_local_moving_leaves_no_mover(spark):
    """Ends of lone edges come together, though a round may draw none of them, or both."""
    from tessera.operators import communities

    rows = [(f"a{i}", f"b{i}") for i in range(12)]
    ids = spark.createDataFrame([(x,) for r in rows for x in r], "id string")
    got = {r.id: r.community for r in communities.louvain(ids, spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert got == {x: r[0] for r in rows for x in r}


def test_community_rounds_shuffle_numbers(spark, monkeypatch):
    """Rounds hold numbers for names, links are dealt by their other end once for all rounds, and the last level isn't refined."""
    from tessera.operators import communities

    held, refined = [], []
    put, refine = communities.keep, communities._refined
    monkeypatch.setattr(communities, "keep", lambda df, *n: (held.append((n, dict(df.dtypes).get("id"))), put(df, *n))[1])
    monkeypatch.setattr(communities, "_refined", lambda *a: (refined.append(1), refine(*a))[1])
    ids = spark.createDataFrame([("b10",), ("b9",), ("c",), ("d",)], "id string")
    edges = spark.createDataFrame([("b9", "b10"), ("d", "c"), ("d", "d"), ("c", None)], "src string, dst string")
    for found in (communities.louvain(ids, edges), communities.leiden(ids, edges), communities.leiden(ids, edges, start=ids.withColumn("community", F.lit("x")))):
        assert {r.id: r.community for r in found.collect()} == {"b10": "b10", "b9": "b10", "c": "c", "d": "c"}
    kinds = {t for (n, t) in held if n in (("placed",), ("choices",))}
    assert kinds == {"bigint"} and len(refined) <= 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        dealt = communities._dealt(put(spark.range(1000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), F.lit(1.0).alias("w"))))
        joined = dealt.join(spark.range(7).select(F.col("id").alias("b"), F.lit(1).alias("to")), "b")
        before = joined._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
        assert "SortMergeJoin" in before and "Exchange" not in before and "Sort [" not in before
        dealt.unpersist()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_leiden_is_connected(spark):
    """Random graphs: communities are connected, all nodes are in one, and modularity is not below that of local moving."""
    import random

    from tessera.operators import communities

    r = random.Random(4)
    for n, m in ((40, 60), (120, 200)):
        rows = list({(f"n{a}", f"n{b}", "r") for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b})
        e = spark.createDataFrame(rows, "src string, dst string, relation string")
        ids = spark.createDataFrame([(f"n{i}",) for i in range(n)], "id string")
        found, plain = communities.leiden(ids, e), communities.louvain(ids, e)
        of = {x.id: x.community for x in found.collect()}
        assert len(of) == n and all(of[c] == c and min(i for i in of if of[i] == c) == c for c in of.values())
        near = {i: set() for i in of}
        for a, b, _ in rows:
            near[a].add(b)
            near[b].add(a)
        for c in set(of.values()):
            reached, todo = {c}, [c]
            while todo:
                new = {x for x in near[todo.pop()] if of[x] == c} - reached
                reached |= new
                todo += new
            assert reached == {i for i in of if of[i] == c}
        assert communities.split_communities(found, e).isEmpty()
        q = lambda df: communities.modularity(df, e).first().q  # noqa: B023, E731
        assert q(found) >= q(plain) - 1e-9 and q(found) > 0.2
    apart = spark.createDataFrame([("n0", "x"), ("n1", "x"), ("n2", "y")], "id string, community string")
    e = spark.createDataFrame([("n0", "n2", "r"), ("n2", "n1", "r")], "src string, dst string, relation string")
    assert [(x.community, x.parts) for x in communities.split_communities(apart, e).collect()] == [("x", 2)]
    none = e.limit(0)
    assert {x.community for x in communities.leiden(apart.select("id"), none).collect()} == {"n0", "n1", "n2"}


def folded(rows, seconds):
    """Accepted calls of (call, key, t): the fold itself."""
    last, out = {}, []
    for call, key, t in sorted(rows, key=lambda x: (x[2], x[0])):
        if key not in last or t - last[key] >= seconds:
            last[key] = t
            out.append(call)
    return sorted(out)


@pytest.mark.parametrize("kind", ["one key", "no pause", "pauses", "many keys", "ties"])
def test_debounce_deals_runs(spark, kind):
    import random

    r = random.Random(3)
    t, rows = 0.0, []
    for i in range(3000):
        t += {"no pause": 0.3, "pauses": r.choice([0.1, 0.5, 2.0, 30.0])}.get(kind, r.choice([0.0, 0.25, 0.5, 1.75, 2.0]))
        rows.append((i, None if kind == "many keys" and i % 7 == 0 else r.randrange(9) if kind == "many keys" else 1, round(t, 2) if kind != "ties" else float(i // 50)))
    df = spark.createDataFrame([*rows, (-1, 1, None)], "call long, session long, t double").select("call", "session", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts")).repartition(7)
    assert sorted(x.call for x in ledger.debounce(df, "session", 2.0).collect()) == folded(rows, 2.0)
    assert ledger.debounce(df.limit(0), "session", 2.0).collect() == []
    if kind == "pauses":  # one key is many tasks
        parts = ledger.debounce(df, "session", 2.0).select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 1


def test_shortest_path(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("a", "x", "r"), ("x", "c", "r"), ("c", "a", "r"), ("c", "d", "r")], "src string, dst string, relation string")
    path = lambda a, b: [(r.hop, r.path) for r in traverse.shortest_path(e, a, b).collect()]
    assert path("a", "d") == [(3, ["a", "b", "c", "d"])] and path("d", "a") == [] and path("a", "a") == [(0, ["a"])] and path("a", "nowhere") == []


def test_debounce_streams_long_keys(spark):
    df = spark.range(50_000).select((F.col("id") % 2).alias("session"), F.col("id").alias("call"), F.timestamp_seconds(F.col("id") / 10).alias("ts"))
    got = ledger.debounce(df, "session", 1.0)
    assert got.count() == 2 * 5000 and got.where("session = 0 and call % 10 <> 0").count() == 0


def test_paths_and_imports(spark):
    d = spark.createDataFrame([("a/b/c.ts", "../x/./y"), ("a/b/c.ts", "./z"), ("c.ts", "../../q"), ("a/c.ts", "@s/p/r"), ("a/c.ts", "lib/sub")], "p string, m string")
    assert [r.t for r in d.select(code.import_target(F.col("m"), F.col("p")).alias("t")).collect()] == ["a/x/y", "a/b/z", "../../q", "pkg:@s/p", "pkg:lib"]


def test_prewarm_and_progress(spark, tmp_path):
    from tessera.streaming import ledger_stream as st

    for i, name in enumerate(("auth.py", "user_service.py")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text('{"path": "%s"}\n' % name)
    saved = {}
    q = st.rebuild_on(spark.readStream.schema("path string").json(str(tmp_path / "in")), st.prewarm(lambda q: q.upper() if "auth" in q else None, saved.__setitem__, 4), str(tmp_path / "state"))
    q.awaitTermination()
    assert saved["what does auth do?"] == "WHAT DOES AUTH DO?" and len(saved) <= 4
    assert st.progress(q, 2) == {"status": "complete", "files_done": 2, "files_total": 2, "percent": 100}


def test_shared_folder_is_asked_for(spark):
    from tessera.operators import keep as k

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "yarn"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        k.shared_dir(Session)
    kept = keep(spark.range(3))
    k.discard(kept)
    d = k.ranked(spark.range(1000).repartition(7), F.desc("id")).collect()
    assert all(r["rank"] == 999 - r.id for r in d)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_isolated_takes_each_end_once(spark):
    n = spark.createDataFrame([("a", "function"), ("b", "class"), ("c", "external"), ("d", "class")], "id string, type string")
    e = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "calls"), ("b", "a", "calls")], "src string, dst string, relation string")
    found = graph.isolated(n, e, ("external",))
    assert [tuple(r) for r in found.collect()] == [("d", "class")]
    assert "Aggregate [id" in _plan(found)


def test_stubs_need_no_distinct_edges(spark):
    f = spark.createDataFrame([("a", "A", "class", None, None, None, 1, 1)], "id string, label string, type string, file string, lang string, summary string, community int, ord int")
    e = spark.createDataFrame([("a", "x", "calls"), ("a", "x", "calls"), ("a", "a", "calls")], "src string, dst string, relation string")
    nodes, edges = graph.merge_fragments(f, e)
    assert sorted((r.id, r.type) for r in nodes.collect()) == [("a", "class"), ("x", "external")] and edges.count() == 1
    assert "relation" not in "".join(x for x in _plan(nodes).split("\n") if "Aggregate" in x)


def test_crossing_edges_meet_known_nodes_only(spark):
    n = spark.createDataFrame([("a", "class", 1), ("b", "class", 2), ("p", "external", 3), ("q", "external", None)], "id string, type string, community int")
    e = spark.createDataFrame([("a", "b", "imports"), ("a", "p", "imports"), ("a", "p", "calls"), ("a", "q", "calls"), ("b", "b", "calls")], "src string, dst string, relation string")
    assert {tuple(r) for r in graph.cross_community(n, e).collect()} == {(1, 2, "a", "b", "imports"), (1, 3, "a", "p", "calls")}


def test_crossing_queries_make_no_imports(spark):
    from tessera import plans, registry

    plans.load()
    for name in ("cross_community_edges", "cross_community_matrix"):
        assert "imports AS relation" not in _plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_co_changes_are_dealt_by_rows(spark):
    from tessera.operators import git

    df = spark.createDataFrame([(1, 5), (1, 3), (1, 9), (2, 3), (2, 5), (3, 9)], "commit int, file int")
    found = git.co_changes(df, 40_000_000, 15)
    assert "RepartitionByExpression [file_a" in _plan(found) and ", 40" in [x for x in _plan(found).split("\n") if "RepartitionByExpression" in x][0]
    assert {tuple(r) for r in found.collect()} == {(3, 5, 2), (3, 9, 1), (5, 9, 1)}


def test_co_changes_pair_all_files_of_a_commit(spark):
    """Files of a commit beyond the fifteenth are paired too, in its row or, of a large commit, in blocks over many tasks."""
    from collections import Counter
    from itertools import combinations

    from tessera.operators import git

    held = {1: range(20), 2: range(10, 900), 3: [3, 19, 899], 4: range(256), 5: [7], 6: range(257)}
    df = spark.createDataFrame([(c, f) for c, files in held.items() for f in files] + [(3, 19), (6, 0), (6, None)], "commit long, file long")
    want = Counter(p for files in held.values() for p in combinations(files, 2))
    found = git.co_changes(df, 1000)
    assert {(r.file_a, r.file_b): r.n for r in found.collect()} == want
    text = df.select(F.concat(F.lit("c"), "commit").alias("commit"), F.lpad(F.col("file").cast("string"), 4, "0").alias("file"))
    assert {(int(r.file_a), int(r.file_b)): r.n for r in git.co_changes(text, 1000).collect()} == want
    blocks = git._wide(df.where("commit = 2").withColumn("size", F.lit(890).cast("long")), 8)
    assert blocks.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_similar_pairs_put_aside_first_words_only(spark):
    """What is written follows the first words of sets, not all of their words."""
    import random
    from pathlib import Path

    r, at = random.Random(5), Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    d = keep(spark.createDataFrame([(i, [r.getrandbits(62) for _ in range(2000)]) for i in range(200)], "id long, s array<long>"))
    size = lambda: sum(p.stat().st_size for p in at.rglob("*") if p.is_file())
    before = size()
    assert search.similar_pairs(d, 0.82).collect() == []
    assert size() - before < 200 * 2000 * 8 / 2


def test_keys_of_a_group_meet_once(spark):
    """Keys that share their rows are one, however many; keys that share only their first row stay; no two rows that met are parted."""
    shared = [(k, i, 50, i % 3) for k in range(40) for i in range(100) if i != k + 1]
    lone = [(k, i, 50, i) for k in range(1000, 1050) for i in (500, *range(k * 70, k * 70 + 70))]
    rows = shared + lone + [(7777, i, 50, 0) for i in range(0, 99, 3)]
    found = search.pooled(spark.createDataFrame(rows, "key long, id long, n int, comp long")).collect()
    assert len(found) == 100 + len(lone) and len({r.key for r in found}) == 1 + 50
    meet = lambda rs: {(a, b) for ids in _by_key(rs).values() for a in ids for b in ids if a < b}
    assert meet([(r.key, r.id) for r in found]) >= meet([r[:2] for r in shared + lone])


def test_representatives_shuffle_no_sets(spark, monkeypatch):
    """What is put aside to compare the members of groups are 128 hashes of each, not its set, and it gives the same."""
    from tessera.plans import text_queries

    seen, real = [], search.representatives
    monkeypatch.setattr(search, "representatives", lambda df: (seen.append(df), real(df))[1])
    got = text_queries.near_dups_jaccard(spark, "/root/testdata/sf0.001").collect()
    assert set(seen[0].columns) == {"component", "id", "chars", "h"} and got and seen[0].where("size(h) <> 128").isEmpty()
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    whole = seen[0].select("component", "id").join(search.hashed_shingles(d), "id")
    want = {(r.component, r.representative, r.members, r.similarity) for r in real(whole).collect()}
    assert {(r.component, r.representative, r.members, r.similarity) for r in real(seen[0]).collect()} == want
    assert {(r.component, r.representative, r.members) for r in got} == {w[:3] for w in want}


def _by_key(rows) -> dict:
    out: dict = {}
    for key, i in rows:
        out.setdefault(key, set()).add(i)
    return out


def test_hashed_shingles_are_shingles(spark):
    texts = ["a b c d e a b c d e", "A, b!", "", None, "x", "a b c d e", "b c d e a", "é ß"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    plain = {x.id: frozenset(x.s or []) for x in d.select("id", search.shingles(F.col("text")).alias("s")).collect()}
    hashed = {x.id: frozenset(x.s) for x in search.hashed_shingles(d.repartition(3)).collect()}
    assert {i: len(s) for i, s in plain.items()} == {i: len(s) for i, s in hashed.items()}
    assert all((plain[i] & plain[j] == frozenset()) == (hashed[i] & hashed[j] == frozenset()) and (plain[i] == plain[j]) == (hashed[i] == hashed[j]) for i in plain for j in plain)


def test_impact_goes_over_edges_once_a_hop(impact_graph):
    """What is returned holds levels and degrees that were put aside: no join with the edges is left in it, let alone many of the first hop's."""
    nodes, edges = impact_graph
    scored = traverse.impact(nodes, edges, "db", 3)
    assert "[src" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: (r.hop, r.in_degree) for r in scored.collect()} == {"session": (1, 1), "billing": (1, 0), "auth": (2, 2), "api": (3, 0), "admin": (3, 0)}


def test_log_is_dealt_by_rows(spark):
    """Lines are dealt by their order once, over tasks that follow from the number of lines."""
    from tessera.plans import extract_queries

    plan = extract_queries.git_log_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("hashpartitioning(l_orderkey") == 1


def test_rounds_shuffle_numbers(spark, monkeypatch):
    """Rounds hold numbers for names; the smallest name still wins, also of ends that are no ids."""
    held = []
    marked = traverse.keep_marked
    monkeypatch.setattr(traverse, "keep_marked", lambda df, *c: (held.append(dict(df.dtypes)["u"]), marked(df, *c))[1])
    ids = spark.createDataFrame([("b10",), ("b9",), ("c",), ("d",)], "id string")
    edges = spark.createDataFrame([("b9", "b10"), ("c", "a"), ("d", "d"), ("c", None)], "src string, dst string")
    assert {r.id: r.component for r in traverse.connected_components(ids, edges).collect()} == {"b10": "b10", "b9": "b10", "c": "a", "d": "d"}
    assert set(held) == {"bigint"}
    labels = {r.id: r.community for r in traverse.label_propagation(ids, edges, lambda df: (held.append(df.dtypes[0][1]), keep(df))[1], 1).collect()}
    assert labels == {"b10": "b10", "b9": "b10", "c": "c", "d": "d", "a": "c"} and set(held) == {"bigint"}


def test_coupling_is_dealt_by_lines(spark, monkeypatch):
    import re

    from tessera import plans, registry
    from tessera.plans import answer_queries

    plans.load()
    monkeypatch.setattr(answer_queries, "spread", lambda *_: 7)  # as lines grow, so do tasks
    plan = registry.QUERIES["coupling_nodes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((\w+?)#\w+, 7\), REPARTITION_BY_NUM", plan)
    assert {"o", "k", "file_a", "file_b"} <= set(dealt)
    assert "o_custkey" not in plan  # nothing distinct is counted that coupling doesn't show
