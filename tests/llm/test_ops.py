"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats, long texts and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import ann, html_extract, lm, packing, pii, quality, sentence_pieces, simhash, suffix_dedup, toxicity

R = random.Random(3)
WORDS = ["the", "and", "é", "ción", "weird", "supercalifragilistic", "x"]


def prose(n: int) -> str:
    return " ".join(R.choice(WORDS) + str(R.randint(0, 50)) for _ in range(n))


SHARED = [prose(30) for _ in range(5)]
DOCS = [(i, prose(R.randint(0, 40)) + R.choice(SHARED)[R.randint(0, 20) :] + prose(R.randint(0, 20))) for i in range(60)]
DOCS += [(100, DOCS[3][1]), (101, None), (102, ""), (103, "a" * 500), (104, "a" * 300), (105, "ab" * 200), (106, "b" + "ab" * 100), (107, DOCS[5][1]), (None, DOCS[4][1]), (7, DOCS[7][1]), (99, SHARED[0]), (98, SHARED[0] * 2), (97, " \n\t"), (96, prose(3000))]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(d, t, f"r{i}", 1, 2) for i, (d, t) in enumerate(DOCS)], "doc_id long, text string, key string, bucket int, route int")
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def multi(rows) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return {k: sorted(v) for k, v in out.items()}


def test_quality(docs, empty):
    def base(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)

    got = quality.compression_bands(docs).collect()
    assert multi(r[:7] for r in got) == multi((d, *base(t)) for d, t in DOCS)
    assert all(not (r.base_failed and r.kept) for r in got) and any(r.kept for r in got)
    assert quality.compression_bands(empty).count() == 0
    assert quality.keep(docs).count() == sum(r.kept for r in got)
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    noise = "".join(chr(R.randint(33, 126)) + " " * (i % 70 == 0) for i in range(9000))
    assert quality.score(noise, packer)[5:7] == (False, False)
    assert not quality.score(" ".join("abcdefgh"[i % 8] + str(i // 3 % 2) for i in range(5000)), packer)[6]


def test_suffix_array():
    r = random.Random(4)
    for _ in range(40):
        alphabet, n = r.choice([b"ab", b"abc", bytes(range(256)), b"a"]), r.randint(1, 300)
        text = suffix_dedup.padded(bytes(r.choice(alphabet) for _ in range(n)))
        wanted = np.array([r.random() < 0.7 for _ in range(n)])
        order, raw = suffix_dedup.suffix_array(text, wanted), text.tobytes()
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        keys = [raw[i : i + suffix_dedup.DEPTH] for i in order]
        assert keys == sorted(keys)


def test_suffix_dedup(docs, empty):
    first: dict = {}
    for d, t in DOCS:
        b = (t or "").encode()
        for i in range(len(b) - 49 if d is not None else 0):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], 1 << 62), d)

    def brute(d, t):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 50, bool)
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        gone = gone[: len(b)]
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        return len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()

    assert multi(suffix_dedup.remove_repeats(docs).collect()) == multi((d, *brute(d, t)) for d, t in DOCS)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert set(suffix_dedup.remove_repeats(docs, with_text=True, carry=("key", "bucket")).columns) >= {"key", "bucket", "kept"}


def test_html():
    page = (
        "<html><head><title>T</title></head><body class=home><header><h1>Site</h1></header><div id='cookie-notice'>We use cookies, really, now.</div><div class='wrap'><div class='col'><h2>Real &amp; title</h2>"
        "<p>Some long text, with commas, and more. And <a href=x>a link</a> inside it, too.<p>Second   paragraph, unclosed &eacute;<ul><li>one item, ok<li>two items, fine</ul></div><div class='sidebar'><p>Side, boo.</p></div></div>"
        "<form>Search<input></form><div class='comments'><p>I think, that, this is a very long comment, and more.</p></div><!-- x <p>no</p> --><script>if(a<b){'</p>'}</script><footer>foot</footer></body></html>"
    )
    assert html_extract.extract(page) == "Real & title\n\nSome long text, with commas, and more. And a link inside it, too.\n\nSecond paragraph, unclosed é\n\none item, ok\n\ntwo items, fine"
    assert [html_extract.extract(x) for x in (None, "", "plain text", "<p>a<p>b<!-- open", "<div class='x>odd <p>hello</p>")] == ["", "", "plain text", "a\n\nb", "odd\n\nhello"]
    assert isinstance(html_extract.extract("<<<>>>"), str)
    assert html_extract.extract("<p>" * 3000 + "deep, text") == "deep, text"


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Hi, there.</p></article>", "z"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert multi(html_extract.main_text(df).collect()) == {1: [("u", "Hi, there.", 10)], None: [(None, "", 0)]}


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    return sum(int(c) if not i % 2 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pii(spark, docs):
    texts = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 000255.1.1.1", "+1 4111 1111 1111 1111 x 4111-1111-1111-1111", "é😀 me@x.io +49 (30) 1234-5678 9", "1" * 30000, "a." * 20000, None, "", "@@@ a@b", "12 " * 3000 + "4111111111111111", "x@y.z " * 1500, 'token = "' + "0123456789abcdef" * 2 + '01234567"', "plain prose, nothing else"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.train(spark)
    rows = pii.find(df, model=model).withColumns({"l": pii.listed("spans"), "r": pii.redacted()}).collect()
    for r in rows:
        want = []
        for o, (k, p) in enumerate(PII.items()):
            for m in re.finditer(p, r.text):
                h, d = m.group(), re.sub("[^0-9]", "", m.group())
                if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in h.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[k]():
                    want.append((m.start(), o, k, m.end()))
        assert [(s.start, s.ord, s.kind, s.end) for s in r.base] == sorted(want)
        assert set(r.base) <= set(r.spans)
    by = {r.doc_id: r for r in rows}
    assert by[11].l == "secret:9:49" and by[11].r == 'token = "<SECRET>"' and by[12].l == "" and by[12].r == texts[12]
    assert pii.find(docs, model=model).count() == len(DOCS)


def test_pii_zero_parts(spark):
    good = ["10.0.0.1", "0.0.0.0", "00.0.000.1", "1.2.3.0", "10.20.30.0", "192.168.1.1", "0" * 5000 + ".0.0." + "0" * 5000]
    bad = ["256.0.0.0", "0.0.0.300", "0001000.0.0.0", "0" * 5000 + "999.0.0.0"]
    df = spark.createDataFrame(list(enumerate(f"at {x} now" for x in good + bad)), "doc_id long, text string")
    model = ([], dict.fromkeys(pii.GENERATORS, float("inf")))  # base spans only
    rows = sorted(pii.find(df, model=model).select("doc_id", pii.count_of("base", "ip").alias("n"), pii.redacted().alias("r")).collect())
    assert [r.n for r in rows] == [1] * len(good) + [0] * len(bad)
    assert [r.r for r in rows] == ["at <IP> now"] * len(good) + [f"at {x} now" for x in bad]


def test_simhash(docs, empty, spark):
    def fp(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fp(t) for _, t in DOCS]
    head = list(range(len(DOCS)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(DOCS)):
        for j in range(i):
            if DOCS[i][0] is not None and DOCS[j][0] is not None and (prints[i] ^ prints[j]).bit_count() <= 4:
                head[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(DOCS):
        if d is not None:
            least[find(i)] = min(least.get(find(i), 1 << 62), d)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_print("print"), "component_id").collect()
    assert multi(got) == multi((d, f"{prints[i]:016x}", least[find(i)] if d is not None else None) for i, (d, _) in enumerate(DOCS) if d is not None) | {None: [(f"{prints[i]:016x}", None) for i, (d, _) in enumerate(DOCS) if d is None]}
    assert simhash.near_duplicates(empty).count() == 0


def test_bit_sliced_links():
    rng = np.random.default_rng(1)
    x = []
    for b in rng.integers(0, 2**63, 150, dtype=np.uint64).tolist():
        for _ in range(rng.integers(1, 6)):
            y = b
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                y ^= 1 << int(k)
            x.append(y)
    for _ in range(300):
        y = x[0]
        for k in rng.integers(0, 64, 3):
            y ^= 1 << int(k)
        x.append(y)
    p = np.unique(np.array(x, np.uint64))

    def groups(pairs):
        f = list(range(len(p)))

        def find(a):
            while f[a] != a:
                a = f[a]
            return a

        for a, b in pairs:
            a, b = find(a), find(b)
            f[max(a, b)] = min(a, b)
        return [find(i) for i in range(len(p))]

    far = np.bitwise_count(p[:, None] ^ p[None, :])
    want = groups(np.argwhere((far <= 4) & (far > 0)).tolist())
    for m in (5, 6):
        pairs = []
        for mask in simhash.keys_of(m):
            k = p & np.uint64(mask)
            o = np.argsort(k, kind="stable")
            a, b = simhash.link_sorted(k[o], p[o], np.arange(len(p))[o])
            assert all(far[i, j] <= 4 for i, j in zip(a, b, strict=True))
            pairs += list(zip(a.tolist(), b.tolist(), strict=True))
        assert groups(pairs) == want


def test_lm(spark, docs, empty):
    got = lm.score(docs).collect()
    count: Counter = Counter()
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), None]
    held = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 7 == 2
    for d, t in DOCS:
        if held(d) is False:
            count.update(split(t))
    n, v = sum(count.values()), len(count)
    want = multi((d, held(d), len(split(t)), sum(count[w] > 0 for w in split(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for d, t in DOCS)
    assert multi((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm.score(empty).count() == 0


def test_lm_trains_on_all():
    sizes = [5 + i % 7 for i in range(300)]
    count = Counter({b"w%d" % i: 10 for i in range(50)})
    vocabulary = lm.Vocabulary(count.most_common(), np.full(lm.TAIL, 50), np.full(lm.TAIL, 5))
    tokens = np.random.default_rng(1).integers(0, 50, sum(sizes))
    row = {"docs": list(range(300)), "sizes": sizes, "tokens": tokens.astype("<u4").tobytes(), "inputs": vocabulary.number(list(count)).astype("<u2").tobytes()}
    p = lm.initial(vocabulary)
    adam = lm.Adam(p)
    trained = sum(lm.train_block(p, adam, vocabulary, row, part) for part in range(lm.ROUNDS))
    assert trained == sum(n for i, n in enumerate(sizes) if zlib.crc32(str(i).encode()) % 7 != 2)


def test_lm_gradients():
    rng = np.random.default_rng(0)
    count = Counter({b"w%d" % i: 200 - i for i in range(200)})
    n_of, v_of = np.zeros(lm.TAIL, int), np.zeros(lm.TAIL, int)
    for w, n in count.items():
        n_of[lm.tail_class(w)] += n
        v_of[lm.tail_class(w)] += 1
    vocabulary = lm.Vocabulary(count.most_common(96), n_of, v_of)
    p = {k: x.astype(float) + (rng.normal(size=x.shape) * 0.1 if k != "word_bias" else 0) for k, x in lm.initial(vocabulary).items()}
    number = vocabulary.number(list(count))
    classes, places = vocabulary.classes_of(number)
    tok, fresh, live = rng.integers(0, 200, (lm.STEPS, 5)), rng.random((lm.STEPS, 5)) < 0.1, rng.random((lm.STEPS, 5)) < 0.9
    before = np.zeros_like(tok)
    before[1:] = number[tok[:-1]]
    before[fresh] = -1
    h = rng.normal(size=(5, lm.HIDDEN)) * 0.1

    def loss(q):
        on = live.ravel()
        states = lm._forward(q, lm.input_table(q), before, fresh, h, False)[0].reshape(-1, lm.HIDDEN)[on]
        return -lm.log_probabilities(q, vocabulary.bins, states, classes[tok].ravel()[on], places[tok].ravel()[on]).sum() / on.sum()

    g, _ = lm._gradients(p, vocabulary.bins, lm.input_table(p), before, fresh, h, classes[tok], places[tok], live)
    for name in p:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in p[name].shape)
            q = {a: b.copy() for a, b in p.items()}
            q[name][at] += 1e-4
            up = loss(q)
            q[name][at] -= 2e-4
            slope = (up - loss(q)) / 2e-4
            assert abs(slope - g[name][at]) < 1e-4 + 0.02 * abs(slope), name


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for d, x in [*DOCS, (1, "a\t  x"), (2, "  a \n\n b  "), (3, "it's <|endoftext|> ok"), (4, "x\x1cy z   w")]:
        want = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(packing.encoder()(x or ""), "<u4").tolist() == want
        ids[x] = [*want, 1]
    rows = packing.pack(docs).collect()
    expect = sorted((str(d), a, min(2048, len(ids[x]) - a), zlib.crc32(np.array(ids[x][a : a + 2048], "<u4").tobytes()), len(ids[x])) for d, x in DOCS for a in range(0, len(ids[x]), 2048))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expect
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_histogram():
    r = random.Random(1)
    h = Counter({n: r.randint(1, 9) for n in range(1, 2048)}) + Counter({2048: 5})
    p = packing.pack_histogram(h)
    used: Counter = Counter()
    for lengths, n in p:
        assert sum(lengths) <= 2048 and list(lengths) == sorted(lengths, reverse=True)
        for x in lengths:
            used[x] += n
    assert used == h
    assert sum(k * n for k, n in h.items()) / 2048 / sum(n for _, n in p) > 0.98


def test_ann(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(8, 16))
    x = centre[rng.integers(0, 8, 900)] + rng.normal(size=(900, 16)) * 0.7
    x[5], x[205], x[405] = x[0], x[0], x[0]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8), (1004, [1.0]), (1100, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    got: dict = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 100))
    hits = 0
    for q, found in got.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(900), far)).tolist() if i != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(far[v] - s) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(want))
    assert hits >= 0.9 * 90
    assert [v for _, v, s in sorted(got[0])[:3]] == [5, 205, 405]
    few = spark.createDataFrame([(0, [1.0, 2.0]), (3, [2.0, 2.0])], df.schema)
    assert [(r.query_id, r.vec_id, r.score) for r in ann.search(few).collect()] == [(0, 3, 1.0)]
    assert ann.search(df.where("false")).count() == 0


def test_ann_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64)).astype(np.float32)
    x[::3] = x[0]  # a third of the rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got: dict = {}
    for r in ann.search(df, every=150).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 150))
    for q, found in got.items():
        assert sorted(found) == [(i + 1, v, 0.0) for i, v in enumerate([v for v in range(0, 36, 3) if v != q][:10])]
    # a bound that falls to 0 inside a block must not lose smaller ids that come later
    ids, d = np.arange(1500)[::-1].copy(), 64
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.float32)
    y = x[::-1].astype(float)
    a, b = ann.scan(ids, y, np.ascontiguousarray((y.astype(np.float32) @ turn).T), -1, y[-1], y[-1].astype(np.float32) @ turn, np.inf)
    assert a.tolist() == list(range(0, 30, 3)) and not b.any()


def test_sentence_pieces(spark, docs):
    m = sentence_pieces.load()
    usable = {p.decode().replace(" ", "▁"): (i, m.score_of[i]) for i, p in m.bytes_of.items() if m.score_of.get(i, -1e9) > -1e8}

    def best(u):
        b = [0.0] + [-1e300] * len(u)
        for e in range(1, len(u) + 1):
            for s in range(max(0, e - 16), e):
                if u[s:e] in usable:
                    b[e] = max(b[e], b[s] + usable[u[s:e]][1])
            b[e] = max(b[e], b[e - 1] + m.unknown)
        return b[-1]

    for x in ["Hello  world, é", "a😀b 梦\n\nnew", "   ", "x" * 300, *[t for _, t in DOCS[:12]]]:
        ids = m.encode(x)
        assert m.decode(ids) == x
        total, spelled = m.score(ids)
        chars = len(bytes(m.byte_ids.index(i) for i in memoryview(ids).cast("I") if i not in m.score_of).decode()) if spelled else 0
        assert abs(total + chars * m.unknown - best((" " + x).replace(" ", "▁"))) < 1e-3
    assert m.decode(m.encode("a▁b ▁")) == "a▁b ▁"
    rows = sentence_pieces.encode(docs, with_ids=True)
    assert all(r.round_trip for r in rows.collect())
    assert Counter(r.text for r in sentence_pieces.decode(rows).collect()) == Counter(t or "" for _, t in DOCS)


def test_toxicity(spark):
    r = random.Random(8)
    bad, rows, labels = ["idiot", "moron", "scum"], [], []
    for i in range(900):
        toxic = i % 5 == 0
        w = [r.choice(WORDS) + str(r.randint(0, 300)) for _ in range(r.randint(10, 60))]
        if toxic:
            w[r.randrange(len(w))] = r.choice(bad)
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        if i % 10 < 8:
            labels.append((i, int(toxic)))
    d = spark.createDataFrame([*rows, (9000, None), (None, "idiot moron")], "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(d, y).collect()}
    held = [i for i in range(900) if got[i].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900))
    assert sum(got[i].predicted == (i % 5 == 0) for i in held) > 0.95 * len(held)
    assert got[9000].predicted == 0 and got[None].predicted == 1 and all(0 <= x.score <= 1 for x in got.values())
    assert max(x.score for x in toxicity.toxicity(d, y.where("false")).collect()) < 1e-9
