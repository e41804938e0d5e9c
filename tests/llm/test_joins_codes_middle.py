"""Set join, vector codes and fill-in-middle against brute force, on odd tables and with every branch forced."""

import hashlib
import math
import os
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import codes, middle, queries, set_join

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
R = random.Random(5)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [
    (None, None), (None, "a text without a number"), (1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "WORD "), (6, "two words"), (7, "two words"),
    (7, "two  words"), (8, "a b c d"), (9, "A b\x0bc d"), (10, "Ärger ärger É é"), (11, "ärger ärger é é"), (12, "x " * 5000), (13, "x " * 4), (14, "😀 <P> marked"),
    (15, "  is   no space"), (16, "tail   "), (17, "tail"), (18, "many words " * 3000), (-3, "two words"), (19, "a<b <S"), (20, "<M>"),
]


def documents(spark, rows):
    """Rows with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in ("row", "id", "n", "key", "comp", "lang", "source", "form", "first", "end")])


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def set_of(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def joined(rows):
    """doc_id, size, component of each row, by comparing all pairs."""
    sets = [set_of(t) for _, t in rows]
    of = list(range(len(rows)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                of[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(n, words=90, edits=4, start=100):
    """Copies of one text with edits at random places: many pairs link, many only by way of others."""
    base = [f"w{R.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(R.randrange(edits + 1)):
            w[R.randrange(words)] = f"e{R.randrange(10**6)}"
        out.append((start + i, " ".join(w)))
    return out


def got_sets(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_set_join_odd(spark):
    rows = ODD + near_copies(60)
    assert got_sets(set_join.near_duplicates(documents(spark, rows))) == joined(rows)
    assert set_join.near_duplicates(documents(spark, [])).collect() == []


def test_set_join_memory(spark, monkeypatch):
    """Hashes kept and batches handed to workers are bounded, whatever the texts and the session's settings."""
    of = set_join.Shingler()
    for i in range(150):
        of(b" ".join(b"%d" % j for j in range(1000 * i, 1000 * i + 1000)))
        assert len(of.known) <= (1 << 16) + 1000
    sizes, plain = [], set_join.mapped

    def seen(df, *args, **more):
        sizes.append(int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
        return plain(df, *args, **more)

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(set_join, "mapped", seen)
    set_join.near_duplicates(documents(spark, ODD))
    assert sizes and max(sizes) <= 16 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


@pytest.mark.parametrize(("light", "hot"), [(0, 1 << 20), (20, 1 << 20), (10**6, 1 << 20), (20, 10)])
def test_set_join_branches(spark, monkeypatch, light, hot):
    """All sets heavy, some, none; keys with more rows than a list, and more than a block; salted keys."""
    monkeypatch.setattr(set_join, "boundary", lambda *a: light)
    monkeypatch.setattr(set_join, "LIST", 8)
    monkeypatch.setattr(set_join, "BLOCK", 16)
    monkeypatch.setattr(set_join, "HOT", hot)
    monkeypatch.setattr(set_join, "HOT", hot)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = near_copies(90) + near_copies(40, 18, 1, 300) + near_copies(30, 8, 1, 500)
    rows += [(700 + i, f"{shared} " + " ".join(f"u{i}x{j}" for j in range(5 + i % 3))) for i in range(40)]
    rows += [(800 + i, t) for i, (_, t) in enumerate(rows[::7])]
    R.shuffle(rows)
    assert got_sets(set_join.near_duplicates(documents(spark, rows))) == joined(rows)


def test_unit_links():
    sets = [np.array(sorted(R.sample(range(30), 26)), np.uint64) for _ in range(60)]
    comps = np.array([i // 3 for i in range(60)])
    minor = np.array([c != 0 for c in comps])
    of = {int(c): int(c) for c in comps}

    def find(c):
        while of[c] != c:
            c = of[c]
        return c

    for a, b in set_join.unit_links(np.arange(60), comps, minor, sets):
        assert set_join.linked(sets[a], sets[b]) and (minor[a] or minor[b])
        assert find(int(comps[a])) != find(int(comps[b]))  # a forest: no link is made twice
        of[find(int(comps[a]))] = find(int(comps[b]))
    for i in range(60):
        for j in range(i):
            if (minor[i] or minor[j]) and set_join.linked(sets[i], sets[j]):
                assert find(int(comps[i])) == find(int(comps[j]))


def test_signatures_bound_the_difference():
    for _ in range(300):
        n = R.choice([3, 60, 700, 5000])
        a = np.unique(np.array([R.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.unique(np.concatenate((a[: -R.randrange(1, max(2, n // 5))], np.array([R.getrandbits(64) for _ in range(R.randrange(n // 5 + 1))], np.uint64))))
        if set_join.linked(a, b):
            assert set_join.may_link(set_join.signature(a), set_join.signature(b), len(a), len(b))
    far = [np.unique(np.array([R.getrandbits(64) for _ in range(4000)], np.uint64)) for _ in range(2)]
    assert not set_join.may_link(set_join.signature(far[0]), set_join.signature(far[1]), 4000, 4000)


def test_signatures_bound_the_difference():
    for _ in range(300):
        n = R.choice([3, 60, 700, 5000])
        a = np.unique(np.array([R.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.unique(np.concatenate((a[: -R.randrange(1, max(2, n // 5))], np.array([R.getrandbits(64) for _ in range(R.randrange(n // 5 + 1))], np.uint64))))
        if set_join.linked(a, b):
            assert set_join.may_link(set_join.signature(a), set_join.signature(b), len(a), len(b))
    far = [np.unique(np.array([R.getrandbits(64) for _ in range(4000)], np.uint64)) for _ in range(2)]
    assert not set_join.may_link(set_join.signature(far[0]), set_join.signature(far[1]), 4000, 4000)


def test_boundary_follows_costs():
    assert set_join.boundary([(10, 100, 1e9), (400, 100, 10.0)]) == 10  # dear lists for small sets, dear subsets for large ones
    assert set_join.boundary([(10, 100, 1.0), (400, 100, 1.0)]) == 0
    assert set_join.boundary([]) == 0


# ---- codes


def floor_int(x):
    return math.floor(math.floor(x) * 1024 + (x - math.floor(x)) * 1024) if abs(x) < 2**40 else int(x) * 1024


def coded(rows, entries=256, rounds=4):
    """vec_id, code, error, label_error by plain integers and full recounts."""
    keep = [(i, lab, v) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    keep.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    keep = [r for r in keep if len(r[2]) == len(keep[0][2])]
    ints = [[floor_int(x) for x in v] for *_, v in keep]
    d = len(ints[0]) if ints else 0
    cut = [(i * d // 4, (i + 1) * d // 4) for i in range(4)]
    books = [[v[a:b] for v in ints[:entries]] for a, b in cut]

    def near(v, book):
        far = [sum((x - y) ** 2 for x, y in zip(v, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            of = defaultdict(list)
            for v in ints:
                of[near(v[a:b], books[p])[0]].append(v[a:b])
            books[p] = [[sum(c) // len(of[e]) for c in zip(*of[e], strict=True)] if e in of else x for e, x in enumerate(books[p])]
    out, label = [], defaultdict(int)
    for (i, lab, _), v in zip(keep, ints, strict=True):
        found = [near(v[a:b], books[p]) for p, (a, b) in enumerate(cut)]
        error = sum(e for _, e in found)
        label[lab] += error
        out.append((i, "".join(f"{c:02x}" for c, _ in found), error, lab))
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((i, c, e, label[lab], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, lab in out), key=str)


def vectors(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.select("*", *[F.lit(7).alias(c) for c in ("v", "now", "before", "error", "sum", "of", "part")])


def gauss(n, d=8, scale=1.0):
    f32 = lambda x: float(np.float32(x))
    return [(i, [f32(R.gauss(0, scale)) for _ in range(d)], R.choice([1, 2, None])) for i in range(n)]


def test_codes_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = gauss(400)
    rows += [(None, [0.5] * 8, 1), (3, [0.25] * 8, 2), (3, [0.25] * 8, 2), (900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [nan] + [1.0] * 7, 1), (903, [inf] * 8, 1), (904, [1.0] * 5, 1), (905, [], 1), (906, [0.0] * 8, None)]
    R.shuffle(rows)
    assert got_sets(codes.vector_codes(vectors(spark, rows))) == coded(rows)
    few = gauss(5, 6)
    assert got_sets(codes.vector_codes(vectors(spark, few))) == coded(few)
    assert codes.vector_codes(vectors(spark, [])).collect() == [] and codes.vector_codes(vectors(spark, [(1, None, 1)])).collect() == []


def test_codes_large_numbers(spark):
    """Integers beyond float64 and beyond long are exact; an error that no long can hold is null."""
    rows = [(i, [R.uniform(-1, 1) * 10.0 ** R.choice([0, 3, 9, 12]) for _ in range(4)], 1) for i in range(60)] + [(99, [1e300, 0.0, 0.0, 0.0], 2)]
    want = [(i, c, e if e < 2**63 else None, None, h) for i, c, e, _, h in coded(rows, 16)]
    found = [tuple(r) for r in codes.vector_codes(vectors(spark, rows, "double"), entries=16).select("vec_id", "code", "error", F.lit(None), "codebooks_sha256").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_deltas_carry_changes_only(spark):
    """After the last round most parts keep their entry, and the state says so."""
    rows = gauss(600, 8)
    state, books = codes.encode(vectors(spark, rows), entries=16)
    moved = state.select(F.expr("now <> before").alias("x")).groupBy("x").count().collect()
    assert {r.x: r["count"] for r in moved}.get(False, 0) > 300
    assert hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest() == coded(rows, 16)[0][4]


# ---- fill-in-middle


def middles(rows):
    out = []
    for d, t in rows:
        t = t or ""
        u = UNIT.findall(t)
        h = [int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
        form = "plain" if not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        text = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        out.append((d, len(u), form, *((None, None) if form == "plain" else (len(p), len(m))), text, t))
    return sorted(out, key=str)


def test_middle_odd(spark):
    rows = ODD + [(i, " ".join(R.choice(["a<", "😀", "<P", "S>", "", "\n", "w"]) for _ in range(R.randrange(12)))) for i in range(200, 500)]
    made = middle.fill_in_middle(documents(spark, rows))
    found = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", middle.restored(F.col("output"), F.col("form")).alias("back"))
    assert got_sets(found) == middles(rows)
    assert {r[2] for r in middles(rows)} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(documents(spark, [])).collect() == []


def test_middle_shuffles_texts_once(spark):
    made = middle.fill_in_middle(documents(spark, ODD))
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("ReusedExchange") == 2


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert got_sets(got) == sorted(want, key=str)


def test_key_rows_travel_in_half_their_bytes():
    import numpy as np
    import pyarrow as pa

    from tessera.llm import set_join

    r = np.random.default_rng(1)
    ids = np.sort(r.integers(5 << 33, (5 << 33) + 500, 400))
    rows = [r.integers(0, 1 << set_join.KEY_BITS, 400), np.where(np.arange(400) % 50, 0, 3).astype(np.int32), ids, r.integers(4, 300, 400).astype(np.int32), r.integers(0, 3, 400).astype(np.int8)]
    blob = set_join.packed(rows)
    assert all(np.array_equal(x, y) and x.dtype == y.dtype for x, y in zip(rows, set_join.unpacked(blob, 400), strict=True))
    assert len(blob) < 12 * 400  # 18 bytes a row before, measured in the shuffle
    entries = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([20, 20], pa.int32()), pa.array([[1, 2, 3, 4, 5], [3, 4, 5, 6, 7]], pa.list_(pa.int64()))], names=["id", "n", "prefix"])
    made = list(set_join._keys(85, 100, np.zeros(set_join.SLOTS, np.uint8), np.ones(256, np.int64), 8)(iter([entries])))
    (out,) = set_join._unpacked(iter(made))
    keys = list(zip(out.column(0).to_pylist(), out.column(2).to_pylist(), strict=True))
    both = {k for k, i in keys if i == 7} & {k for k, i in keys if i == 8}
    assert len(keys) == 20 and len(both) == 3 and set(out.column(3).to_pylist()) == {20}  # pairs of 5 shingles each, three of them shared
