"""Further cases: scores that decide, hot groups, forced collisions, broken pages, interactions, odd tables."""

import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
import zstandard

from tessera.llm import ann, common, html_extract, lm, packing, pii, quality, sentence_pieces, simhash, suffix_dedup, toxicity

R = random.Random(11)
LONG = "Prose with commas, and stops. It goes on, as prose does, for a while."


def multi(rows) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return {k: sorted(v, key=str) for k, v in out.items()}


# ---- pages


def test_path_scores_by_hand():
    page = "<div class=a><p>One, two.</p><p>Three <a href=x>four</a>.</p></div><ul><li><a href=y>Home</a></li></ul><div class=a><p>Five, six, seven.</p></div>"
    found = html_extract.Page(page).blocks
    assert [(t, n) for t, _, n in found] == [("One, two.", 0), ("Three four.", 4), ("Home", 4), ("Five, six, seven.", 0)]
    own, marks, paths = [9, 7, 0, 17], [2, 1 * 7 / 11, 0, 3], [0, 0, 1, 0]
    count = Counter(paths)
    text = [sum(o for o, q in zip(own, paths, strict=True) if q == p) / count[p] for p in paths]
    mark = [sum(m for m, q in zip(marks, paths, strict=True) if q == p) / count[p] for p in paths]
    weight = {0: 1.0, 1: 0.6, 2: 0.15}

    def smooth(x, i):
        near = [j for j in range(4) if abs(i - j) in weight]
        return sum(weight[abs(i - j)] * x[j] for j in near) / sum(weight[abs(i - j)] for j in near)

    fused = [math.log1p(smooth(text, i)) * math.sqrt(1 + smooth(mark, i)) for i in range(4)]
    want = {p: sum(f for f, q in zip(fused, paths, strict=True) if q == p) / count[p] * math.sqrt(share) for p, share in ((0, 33 / 37), (1, 0.0))}
    got = html_extract.path_scores(found)
    assert [got[found[0][1].path], got[found[2][1].path]] == pytest.approx([want[0], want[1]])


def test_scores_decide(monkeypatch):
    """No declared element and no class word: only the ratios tell the article from lists and blurbs."""
    page = "<body><ul>" + "<li>Topic</li>" * 12 + "</ul><h2>Title here</h2>" + f"<p>{LONG}</p>" * 6 + "<div><a href=1>Start page</a></div><div><a href=2>All topics</a></div></body>"
    want = "\n\n".join(["Title here", *[LONG] * 6])
    assert html_extract.extract(page) == want
    monkeypatch.setattr(html_extract, "path_scores", lambda found: dict.fromkeys((n.path for _, n, _ in found), 1.0))
    assert html_extract.extract(page) != want


def test_frames_and_marks():
    body = f"<h1>Head</h1><p>{LONG}</p>" * 5
    want = "\n\n".join(["Head", LONG] * 5)
    for page in (
        f"<body><form action=x><div>{body}</div><input></form></body>",  # all of a page in one form
        f"<body><form><div class=y>{body}",  # a form left open
        f"<body class='page sidebar-left'><div class='sidebar-layout'>{body}</div></body>",
        f"<body><div class='no-comments'>{body}</div><div class=comments><p>{LONG}</p><p>{LONG}</p></div></body>",
        f"<body><article class='post with-ads'>{body}<div class=ad><p>Buy now, really.</p></div></article><aside><p>{LONG}</p></aside></body>",
        f"<body><article><h1>Head</h1><p>{LONG}</p></article><div class=ads><p>{LONG}</p></div><article>" + f"<h1>Head</h1><p>{LONG}</p>" * 4 + "</article></body>",
    ):
        assert html_extract.extract(page) == want, page
    assert html_extract.extract("<body><div class=ad>Buy this, now.</div><article></article><footer>Foot, note.</footer></body>") == ""


def test_broken_pages_end_soon():
    began = time.time()
    for page in ("<a" * 200_000, '<a ">" ' * 20_000 + "'>", "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000, "<x>" * 30_000 + "<li><td>" * 30_000, "<!--" * 50_000, "<a class=" + '"' * 50_001 + ">x"):
        assert isinstance(html_extract.extract(page), str)
    assert html_extract.extract("<div>" * 100_000 + LONG + "</div>" * 100_000) == LONG
    assert time.time() - began < 30


def test_pages_frame(spark):
    rows = [(1, "u", f"<p>{LONG}</p>"), (1, "u", f"<p>{LONG}</p>"), (2, None, "<p>" + "word, " * 200_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS html2")
    got = html_extract.main_text(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, len(LONG)), (1, len(LONG)), (2, 1_199_999)]
    assert html_extract.main_text(df.where("false")).count() == 0


# ---- compression bands


def test_bands_by_length():
    packer = zstandard.ZstdCompressor(level=3)
    word = lambda: "".join(R.choice(("re", "ti", "on", "al", "men", "sta", "cor", "ve", "ly", "du", "pe", "hi")) for _ in range(R.randint(1, 4)))
    vocabulary = [word() for _ in range(3000)]
    prose = " ".join(R.choice(vocabulary) for _ in range(12_000))
    junk = "".join(R.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") + " " * (i % 76 == 75) for i in range(54_000))
    kept = lambda t: quality.score(t, packer)[6]
    assert kept(prose) and not kept(prose + " " + junk) and not kept(junk)
    assert kept(prose[:61_000] + " " + junk[:900] + " " + prose[:9000])  # one listing in a long text
    tail = prose[: quality.CHUNK] + " " + junk[:3000]
    judged, bad = quality.chunk_sizes(tail.encode(), packer)
    assert judged == [4096, 3001] and bad == [3001] and not kept(tail)
    assert quality.chunk_sizes(b"x" * 511, packer) == ([], [])
    for bands in (quality.WHOLE, quality.CHUNKS):
        assert [b.min_bytes for b in bands] == sorted(b.min_bytes for b in bands) and all(b.low < b.high for b in bands)


# ---- suffix arrays


def test_rows_that_share_a_key(spark):
    """Ranges come back by key; rows of different doc_ids that share one must each take their own only."""
    from pyspark.sql import functions as F

    base = ["".join(R.choice("abcdefgh ") for _ in range(120)) for _ in range(4)]
    rows = [(i, base[i % 4] + str(i) * 3 + base[(i * 7 + 1) % 4]) for i in range(30)] + [(-5, base[0]), (2**62, base[1] + base[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = multi(suffix_dedup.remove_repeats(df).collect())
    assert multi(suffix_dedup.remove_repeats(df, key=F.lit(1).cast("long")).collect()) == want
    assert multi(suffix_dedup.remove_repeats(df, key=F.pmod("doc_id", F.lit(3))).collect()) == want
    assert want[-5] == [(120, 0, 0, hashlib.sha256(base[0].encode()).hexdigest())]


# ---- bit-sliced comparison


def test_long_runs_split():
    rng = np.random.default_rng(5)
    far = rng.integers(0, 2**63, 6000, dtype=np.uint64) & np.uint64((1 << 40) - 1)  # one key: the upper bits agree
    near = far[:200] ^ (np.uint64(1) << rng.integers(0, 40, 200).astype(np.uint64))
    p = np.unique(np.concatenate((far, near)))
    assert len(p) > simhash.SPLIT
    a, b = simhash.link_sorted(np.zeros(len(p), np.int64), p, np.arange(len(p)))
    assert (np.bitwise_count(p[a] ^ p[b]) <= 4).all()
    head = list(range(len(p)))

    def find(i):
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    def union(pairs):
        for x, y in pairs:
            head[find(x)] = find(y)

    union(zip(a.tolist(), b.tolist(), strict=True))
    for i in range(0, len(p), 500):
        for x, y in np.argwhere(np.bitwise_count(p[i : i + 500, None] ^ p[None, :]) <= 4).tolist():
            assert find(x + i) == find(y)
    few = np.array([0, 1, 2, 3, 5], np.uint64)
    assert len(simhash._split(few, 4)[0][0]) == 4


def test_components_have_no_last_round(spark):
    n = 3000  # a path: as far across as components get
    df = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    got = simhash.components(df).collect()
    assert len(got) == n and {r.component for r in got} == {0}


# ---- nearest neighbours


def test_fewer_keeps_what_a_query_needs():
    r = random.Random(2)
    for _ in range(200):
        rows = sorted((r.randint(0, 2), r.randint(0, 6)) for _ in range(r.randint(1, 40)))
        x, ids = np.array([[float(v)] for v, _ in rows]), np.array([i for _, i in rows])
        some = ann.fewer(ids, x, 3)
        for q in range(-1, 7):
            for v in range(3):
                first = [i for (w, i) in rows if w == v and i != q][:3]
                assert [i for (w, i), s in zip(rows, some, strict=True) if s and w == v and i != q][:3] == first


def test_hot_list_is_dealt_in_parts(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    x[:1500] = x[0]
    x[1500:2400] = x[1] + rng.normal(size=(900, 16)).astype(np.float32) * 0.01
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)] + [(7, x[7].tolist(), 0, 1)] * 20 + [(100, None, 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int, part int").repartition(5)
    got: dict = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = np.concatenate((x, np.repeat(x[7:8], 20, 0))).astype(float)
    ids = np.array([*range(4000), *[7] * 20])
    hits = 0
    for q in range(0, 4000, 100):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, far)).tolist() if ids[i] != q][:10]
        found = sorted(got[q])
        if q < 1500:
            assert [(v, s) for _, v, s in found] == [(ids[i], 0.0) for i in order]
        hits += sum((Counter(v for _, v, _ in found) & Counter(ids[order].tolist())).values())
    assert hits >= 0.9 * 400


# ---- language model


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(3)
    count = Counter({b"w%d" % i: 400 - 2 * i for i in range(150)})
    n_of, v_of = np.zeros(lm.TAIL, int), np.zeros(lm.TAIL, int)
    for w, n in count.items():
        n_of[lm.tail_class(w)] += n
        v_of[lm.tail_class(w)] += 1
    vocabulary = lm.Vocabulary(count.most_common(100), n_of, v_of)
    p = lm.initial(vocabulary)
    for k in p:
        if k != "word_bias":
            p[k] += rng.normal(size=p[k].shape).astype(np.float32) * np.float32(0.2)
    return count, vocabulary, p


def _row(vocabulary, count, texts):
    words = list(count)
    return {"docs": list(range(len(texts))), "sizes": [len(t) for t in texts], "tokens": np.concatenate(texts).astype("<u4").tobytes(), "inputs": vocabulary.number(words).astype("<u2").tobytes(), "counts": np.array([count[w] for w in words], "<i8").tobytes()}


def test_windows_give_what_one_pass_gives(small_model):
    count, vocabulary, p = small_model
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 150, n) for n in (1, 5, 16, 17, 300, 2 * lm.SPAN + 3, 40)]
    got = lm.score_block(p, vocabulary, _row(vocabulary, count, texts))[3]
    words, number = list(count), vocabulary.number(list(count))
    q = {k: v.astype(float) for k, v in p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    for text, score in zip(texts, got, strict=True):
        h, x, total, hidden = np.zeros(lm.HIDDEN), np.zeros(lm.EMBED), 0.0, lm.HIDDEN
        for t in text.tolist():
            a = x @ q["in"] + q["bias"]
            z, r = sigmoid(a[:hidden] + h @ q["state"][:, :hidden]), sigmoid(a[hidden : 2 * hidden] + h @ q["state"][:, hidden : 2 * hidden])
            c = np.tanh(a[2 * hidden :] + (r * h) @ q["state"][:, 2 * hidden :])
            h = h + z * (c - h)
            n = number[t]
            head = n < len(vocabulary.rank)
            k = n // lm.WIDTH if head else vocabulary.bins + n - len(vocabulary.rank)
            total += math.log10(softmax(h @ q["class"] + q["class_bias"])[k])
            if head:
                total += math.log10(softmax(h @ q["word"][k] + q["word_bias"][k])[n % lm.WIDTH])
            else:
                tail = k - vocabulary.bins
                total += math.log10((count[words[t]] + 1) / (vocabulary.n_of[tail] + vocabulary.v_of[tail] + 1))
            x = q["embed"][n]
        assert score == pytest.approx(total, rel=2e-4)


def test_probabilities_sum_to_one(small_model):
    count, vocabulary, p = small_model
    states = np.tanh(np.random.default_rng(1).normal(size=(3, lm.HIDDEN))).astype(np.float32)
    number = vocabulary.number(list(count))
    classes, places = vocabulary.classes_of(number)
    for s in states:
        log_p = lm.log_probabilities(p, vocabulary.bins, np.repeat(s[None], len(number), 0), classes, places)
        inside = np.ones(len(number))
        for i, w in enumerate(count):
            if places[i] < 0:
                k = classes[i] - vocabulary.bins
                inside[i] = (count[w] + 1) / (vocabulary.n_of[k] + vocabulary.v_of[k] + 1)
        unseen = sum(math.exp(lm.log_probabilities(p, vocabulary.bins, s[None], np.array([vocabulary.bins + k]), np.array([-1]))[0]) / (vocabulary.n_of[k] + vocabulary.v_of[k] + 1) for k in range(lm.TAIL))
        assert (np.exp(log_p) * inside).sum() + unseen == pytest.approx(1, abs=1e-4)


def test_words_in_arrow():
    import pyarrow as pa

    texts = [None, "", " a b ", "A b\x0b\x0cC\tÉa", "\n", "x\x1cy z" * 50, "über ÜBER"]
    whole = pa.array(["skipped"] + texts)
    words, tokens, sizes = lm.tokens_of(whole.slice(1))
    want = [[*(t or "").encode().translate(common.LOWER).split(), lm.END] for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert [words[i] for i in tokens.tolist()] == [w for t in want for w in t] and words[0] == lm.END and len(set(words)) == len(words)


def test_held_out_texts_score_above_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    r = lm.score(docs).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b", "sum(n_tokens) AS n").first()
    assert r.n > 1000 and r.s > r.b
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


# ---- toxicity


def test_pairwise_sum_is_a_double_loop():
    rng = np.random.default_rng(6)
    m = toxicity.Machine(np.arange(12), 0.3, rng.normal(size=12), rng.normal(size=(12, toxicity.RANK)), 1.0, 0.0)
    for n in (0, 1, 2, 7, 12):
        active = sorted(rng.permutation(12)[:n].tolist())
        want = m.bias + sum(m.weights[i] for i in active) + sum(float(m.factors[i] @ m.factors[j]) for a, i in enumerate(active) for j in active[a + 1 :])
        assert m.raw(active) == pytest.approx(want)


def test_interactions_are_learnt():
    """An insult with a group is toxic; two insults or two groups are not. No sum of single weights can say so."""
    r = random.Random(4)
    insult, group = list(range(10, 16)), list(range(20, 26))
    labels, terms = [], []
    for i in range(9000):
        kind = i % 6
        pair = [r.choice(insult), r.choice(group)] if kind < 2 else r.sample(insult, 2) if kind == 2 else r.sample(group, 2) if kind == 3 else []
        labels.append(int(kind < 2))
        terms.append(np.array(sorted({*pair, *(r.randint(100, 400) for _ in range(12))}), np.int32))
    y = np.array(labels, float)
    m = toxicity.fit(y[:6000], terms[:6000])
    at = {int(f): i for i, f in enumerate(m.features)}
    active = [[at[t] for t in x.tolist() if t in at] for x in terms[6000:]]
    right = lambda f: np.mean([(f(a) > 0) == (v == 1) for a, v in zip(active, y[6000:], strict=True)])
    assert right(lambda a: m.slope * m.raw(a) + m.shift) > 0.95
    best = max(right(lambda a, c=c: m.bias + m.weights[a].sum() + c) for c in np.linspace(-8, 8, 65))
    assert best < 0.9


# ---- odd tables


@pytest.mark.parametrize("name", ["quality", "suffix", "pii", "pieces", "packing", "simhash", "toxicity", "lm"])
def test_odd_tables(spark, name):
    """Empty tables, null and repeated ids, empty and long texts, and columns whose names clash with those inside."""
    text = " ".join(f"word{i % 97} and{i % 13}" for i in range(20_000))
    rows = [(1, "a b c"), (1, "a b c"), (1, "other"), (None, "a b c"), (2, None), (3, ""), (4, text)]
    names = "base spans picked free b_email g_secret key data route part block list print component_id bucket toxic terms rank".split()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"{i} AS {n}" for i, n in enumerate(names)))
    labels = spark.createDataFrame([(1, 0), (4, 1), (None, 1)], "doc_id long, toxic int")
    run = {
        "quality": quality.compression_bands,
        "suffix": suffix_dedup.remove_repeats,
        "pii": lambda d: pii.find(d, model=([], dict.fromkeys(pii.GENERATORS, float("inf")))),
        "pieces": sentence_pieces.encode,
        "packing": packing.pack,
        "simhash": simhash.near_duplicates,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "lm": lm.score,
    }[name]
    got = Counter(r.doc_id for r in run(df).select("doc_id").distinct().collect())
    assert got == Counter([1, 2, 3, 4, None])
    if name != "packing":
        assert run(df).count() == len(rows)
    assert run(df.where("false")).count() == 0


def test_trees_as_columns(spark):
    """Added spans are those whose walk over the trees ends at or over the kind's limit."""
    from pyspark.sql import functions as F

    trees, limits = pii.train(spark)
    texts = ['api_key = "' + "aB3" * 10 + '"', "ssn: 123-45-6789 x", "see 123-45-6789", "call (555) 123-4567 now", "iban DE12 3456 7890 1234 5678", "mail me: jo at site dot com", "a/b/" * 9, "commit " + "0123456789abcdef" * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def walk(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    every: dict = {}
    for kind in pii.GENERATORS:
        each = df.select("doc_id", F.explode(pii.candidates(F.col("text"), kind)).alias("s"))
        for r in each.select("doc_id", "s.start", "s.end", F.array(*pii.features(F.col("s"), kind).values()).alias("x")).collect():
            score = sum(walk(t, r.x) for t in trees)
            if score >= limits[kind]:
                every.setdefault(r.doc_id, []).append((-score, r.start, pii.KINDS.index(kind), kind, r.end))
    meets = lambda a, b: a[0] < b[1] and b[0] < a[1]
    added = 0
    for r in pii.find(df, model=(trees, limits)).collect():
        base = [(s.start, s.end) for s in r.base]
        free = sorted(c for c in every.get(r.doc_id, []) if not any(meets((c[1], c[4]), b) for b in base))
        want = {(a, k, b) for i, (_, a, _, k, b) in enumerate(free) if not any(meets((a, b), (x[1], x[4])) for x in free[:i])}
        assert {(s.start, s.kind, s.end) for s in r.spans if s not in r.base} == want
        added += len(want)
    assert added >= 4


def test_shared_folder_is_asked_for():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_slices_are_bounded():
    import pyarrow as pa

    b = pa.record_batch([pa.array(range(1000)), pa.array(["x" * (i % 50) for i in range(1000)])], ["i", "t"])
    out = list(common.sliced(iter([b, b.slice(0, 0)]), rows=64, size=1500))
    assert pa.Table.from_batches(out).column("i").to_pylist() == list(range(1000))
    assert all(0 < x.num_rows <= 64 and (x.nbytes <= 1500 or x.num_rows == 1) for x in out)


def test_words_are_counted_and_classed_as_one_by_one(monkeypatch):
    """Arrow arrays of words give what words in Python give: packing, classes, input numbers, counts over blocks, the most frequent words."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(33, 256, n).astype(np.uint8).tobytes()) for n in (1, 2, 3, 4, 7, 8, 9, 40) for _ in range(30)]
    words = list(dict.fromkeys([lm.END, *words, b"w\0", b"w\0\0"]))
    arrow = pa.array([b"before", *words], pa.binary()).slice(1)
    flat, widths = lm._pack(arrow)
    assert lm._unpack(flat, widths.tobytes()).to_pylist() == words and lm._pack(arrow.slice(0, 0))[0] == b""
    assert lm.tail_classes(arrow).tolist() == [lm.tail_class(w) for w in words]
    vocabulary = lm.Vocabulary([(w, 5) for w in words[:20]], np.full(lm.TAIL, 50), np.full(lm.TAIL, 5))
    assert vocabulary.number(words).tolist() == [i if i < 20 else 20 + lm.tail_class(w) for i, w in enumerate(words)]

    monkeypatch.setattr(lm, "HEAD", 10)
    want, blocks = Counter(), []
    for k in range(70):
        own = sorted({words[i] for i in rng.integers(0, len(words), 60)})
        seen = rng.integers(0, 9, len(own)).astype("<u4")
        flat, widths = lm._pack(pa.array(own, pa.binary()))
        blocks.append((k, flat, widths.tobytes(), seen.tobytes(), own))
        want.update(dict(zip(own, seen.tolist(), strict=True)))
    batch = pa.RecordBatch.from_arrays([pa.array([b[i] for b in blocks], t) for i, t in enumerate((pa.int64(), *[pa.binary()] * 3))], names=["block", "flat", "widths", "seen"])
    asked = list(lm._ask(3)(iter([batch])))
    got, head, n_of, v_of = [{} for _ in blocks], [], Counter(), Counter()
    for bucket in range(3):
        part = [b.filter(pa.array([x == bucket for x in b.column(0).to_pylist()])) for b in asked]
        for r in (r for b in lm._answer(iter([b for b in part if b.num_rows])) for r in b.to_pylist()):
            if r["block"] is not None:
                got[r["block"]].update(zip(np.frombuffer(r["places"], "<u4").tolist(), np.frombuffer(r["counts"], "<i8").tolist(), strict=True))
            elif r["class"] is not None:
                n_of[r["class"]] += r["n"]
                v_of[r["class"]] += r["v"]
            else:
                head.append((-r["total"], r["word"]))
    for k, *_, own in blocks:
        assert got[k] == {i: want[w] for i, w in enumerate(own)}
    assert sorted(head)[:10] == sorted((-n, w) for w, n in want.items())[:10]
    for k in range(lm.TAIL):
        assert (n_of[k], v_of[k]) == (sum(n for w, n in want.items() if lm.tail_class(w) == k), sum(n > 0 and lm.tail_class(w) == k for w, n in want.items()))
    assert [r for b in lm._answer(iter([])) for r in b.to_pylist() if r["class"] is None] == []


def test_blocks_hold_two_bytes_a_token(small_model):
    """What training and scoring read: a token's input number; sums by document that no weights change are made once."""
    import pyarrow as pa

    count, vocabulary, p = small_model
    texts = [np.random.default_rng(4).integers(0, 150, n) for n in (1, 5, 300, 40)]
    row = _row(vocabulary, count, texts)
    flat, widths = lm._pack(pa.array(list(count), pa.binary()))
    answers = [{"places": np.arange(150, dtype="<u4").tobytes(), "counts": row["counts"]}]
    block = {"docs": row["docs"], "sizes": row["sizes"], "tokens": row["tokens"], "flat": flat, "widths": widths.tobytes(), "answers": answers}
    (made,) = lm._encoder(vocabulary)(iter([pa.RecordBatch.from_pylist([block])]))
    assert len(made.column("inputs")[0].as_py()) == 2 * 346 and "tokens" not in made.schema.names
    (got,) = lm._scorer(vocabulary, p)(iter([made]))
    for a, b in zip(got.columns[1:], lm.score_block(p, vocabulary, row), strict=True):
        assert a.to_pylist() == pytest.approx(b.tolist())
