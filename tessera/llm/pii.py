"""Personal data: base patterns, high-recall candidate generators, boosted trees over format and context.

All on DataFrame functions. Positions come without any per-row code: a text is split by the same pattern that extracts
the matches, and the lengths of gaps and matches add up (code points).

Base spans (email, ip, card, phone) are what the patterns and checks say. The generators then propose further spans of
kinds that a pattern alone can't decide (SPANS beside them may overlap); each gets features of its format and of
the text around it, boosted trees give a score, a calibrated threshold per kind selects. Selected spans that overlap a base span go,
and of selected spans that overlap the one with the higher score stays. Base spans always stay.

The trees are fitted on the driver, on EXAMPLES labelled snippets drawn from a seeded grammar (there are no labelled
spans in the tables); their features come from the same expressions as those of the documents.

Null or empty text: no spans. Null doc_id stays null; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The four base kinds, in the order of the contract.
BASE = ("email", "ip", "card", "phone")

# The base patterns with possessive loops and \G anchors: the same matches in linear time and without deep recursion.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that hold wherever the pattern can give a valid match.
GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


VALID = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: hit.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda hit: F.length(_digits(hit)).between(12, 19) & F.call_function("luhn_check", _digits(hit)),
    "phone": lambda hit: F.length(_digits(hit)).between(9, 15),
}

#: Generators of further candidates: kind, pattern, guard (a cheap test of the text).
GENERATORS = {
    "secret": (r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-]{20,}+", r"[A-Za-z0-9_/+-]{20}"),
    "local_phone": (r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])", r"[0-9]{2}\)?[ .-][0-9]{3}"),
    "national_id": (r"(?<![0-9A-Za-z-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}"),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}"),
    "spelled_email": (r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40} ?[\[(]? ?(?:at|AT) ?[\])]? ?[A-Za-z0-9-]{2,40} ?[\[(]? ?(?:dot|DOT) ?[\])]? ?[a-z]{2,6}(?![A-Za-z0-9])", r"(?:dot|DOT)"),
}
KINDS = (*BASE, *GENERATORS)
CUES = {
    "secret": r"(?i)(?:token|secret|api|key|passw|pwd|auth|bearer|credential)[A-Za-z0-9_ ]*+[\"' ]*+[=:]?[\"' ]*+$",
    "local_phone": r"(?i)(?:tel|phone|call|mobile|fax|telefon|tél|móvil|whatsapp)[a-zé.: #]*+$",
    "national_id": r"(?i)(?:ssn|social|security|tax|insurance)[a-z.: #]*+$",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta|bank)[a-z.: #]*+$",
    "spelled_email": r"(?i)(?:mail|contact|write|reach|correo|kontakt)[a-z.: -]*+$",
}
BEFORE, AFTER = 32, 8
#: Hits that one inner loop collects; longer lists go in chunks of this size, so that the cost stays near linear.
CHUNK = 512
FEATURES = ("length", "digits", "letters", "upper", "others", "variety", "switches", "cue", "quoted", "assigned", "wordy", "kind")


def _found(text: Column, pattern: str, valid) -> Column:
    """array<struct<start, end, hit, before, after>> of the valid matches of pattern, in order."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return _located(hits, gaps, valid)


_SPAN = "array<struct<start:long,end:long,hit:string,before:string,after:string>>"


def _located(hits: Column, gaps: Column, valid) -> Column:
    both = F.struct(hits.alias("h"), gaps.alias("g"))

    def inner(x: Column, c: Column, at: Column) -> Column:
        h, g = x["h"], x["g"]
        first = c * CHUNK

        def step(acc: Column, i: Column) -> Column:
            start = acc["pos"] + F.length(F.get(g, i))
            end = start + F.length(F.get(h, i))
            hit = F.get(h, i)
            row = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), hit.alias("hit"), F.right(F.get(g, i), F.lit(BEFORE)).alias("before"), F.left(F.get(g, i + 1), F.lit(AFTER)).alias("after"))
            return F.struct(end.cast("long").alias("pos"), F.when(valid(hit), F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

        steps = F.sequence(first.cast("int"), F.least(first + CHUNK, F.size(h)).cast("int") - 1)
        return F.aggregate(steps, F.struct(at.cast("long").alias("pos"), F.array().cast(_SPAN).alias("out")), step)

    def outer(x: Column) -> Column:
        chunks = F.sequence(F.lit(0), ((F.size(x["h"]) - 1) / CHUNK).cast("int"))
        zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))

        def step(acc: Column, c: Column) -> Column:
            one = inner(x, c, acc["pos"])
            return F.transform(F.array(one), lambda o: F.struct(o["pos"].alias("pos"), F.concat(acc["out"], F.array(o["out"])).alias("out")))[0]

        return F.flatten(F.aggregate(chunks, zero, step)["out"])

    # transform() over a one-element array binds hits and gaps, so that they are computed once
    return F.transform(F.array(both), lambda x: F.when(F.size(x["h"]) > 0, outer(x)).otherwise(F.array().cast(_SPAN)))[0]


def base_spans(text: Column, kind: str) -> Column:
    return F.when(GUARDS[kind](text), _found(text, PATTERNS[kind], VALID[kind])).otherwise(F.array().cast(_SPAN))


def candidates(text: Column, kind: str) -> Column:
    pattern, guard = GENERATORS[kind]
    return F.when(text.rlike(guard), _found(text, pattern, lambda hit: F.lit(True))).otherwise(F.array().cast(_SPAN))


def features(span: Column, kind: str) -> dict[str, Column]:
    """Numbers that the trees read: format of the hit, then what stands around it."""
    hit, before, after = span["hit"], span["before"], span["after"]
    n = F.length(hit)
    count = lambda cls: n - F.length(F.regexp_replace(hit, cls, ""))
    values = {
        "length": n,
        "digits": count("[0-9]") / n,
        "letters": count("[A-Za-z]") / n,
        "upper": count("[A-Z]") / n,
        "others": count("[^A-Za-z0-9]") / n,
        "variety": F.size(F.array_distinct(F.split(F.lower(hit), ""))) / n,
        "switches": F.regexp_count(hit, F.lit("(?:[a-z][0-9A-Z]|[0-9][A-Za-z]|[A-Z][0-9])")) / n,
        "cue": before.rlike(CUES[kind]).cast("int"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("int"),
        "assigned": before.rlike("[=:] ?[\"'`]?$").cast("int"),
        "wordy": (hit.rlike("^[A-Za-z_/-]+$")).cast("int"),
        "kind": F.lit(list(GENERATORS).index(kind)),
    }
    return {k: values[k].cast("double") for k in FEATURES}


# ---- the model

EXAMPLES, SEED, ROUNDS, RATE, DEPTH, LEAST = 3000, 20240, 24, 0.4, 3, 12
PRECISION = 0.98


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, str, int]]:
    """(kind, snippet, label): half of them personal data of that kind, half look-alikes."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ka", "ren", "ti", "on", "la", "der", "mu", "st", "er", "qu", "e", "in")) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    hexes, alnum, upper, digit = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    out = []
    for i in range(n):
        kind, good = list(GENERATORS)[i % len(GENERATORS)], i // len(GENERATORS) % 2
        lead = words(0, 5) + " "
        if kind == "secret":
            value = r.choice((lambda: pick(hexes, r.choice((32, 40, 64))), lambda: pick(alnum, r.randint(20, 48)), lambda: r.choice(("sk_", "gh_", "AK")) + pick(alnum, r.randint(18, 36))))()
            name = r.choice(("token", "api_key", "secret", "password", "auth key", "bearer", "access_token"))
            quote = r.choice(('"', "'", ""))
            if good:
                text = lead + r.choice((f"{name} = {quote}{value}{quote}", f"{name}: {quote}{value}{quote}", f"{name}={quote}{value}{quote}"))
            else:
                dull = r.choice((lambda: "_".join(word() for _ in range(8)), lambda: "-" * r.randint(20, 60), lambda: "/".join(word() for _ in range(9)), lambda: word() * 8 + word() * 4, lambda: word().upper() * 9, lambda: pick(digit, r.randint(20, 40)), lambda: pick(hexes, 40)))()
                text = lead + r.choice(("", "", "commit ", "see ", "key ")) + (dull if len(dull) >= 20 else dull + "-" * 20)
        elif kind == "local_phone":
            number = r.choice((lambda: f"({pick(digit, 3)}) {pick(digit, 3)}-{pick(digit, 4)}", lambda: f"{pick(digit, 3)}-{pick(digit, 3)}-{pick(digit, 4)}", lambda: f"0{pick(digit, 2)} {pick(digit, 4)} {pick(digit, 4)}"))()
            plain = r.choice((lambda: f"{r.randint(1900, 2099)} {pick(digit, 4)} {pick(digit, 4)}", lambda: f"{pick(digit, 2)} {pick(digit, 3)} {pick(digit, 3)}", lambda: f"{pick(digit, 3)}.{pick(digit, 3)}.{pick(digit, 3)}"))()
            text = lead + (r.choice(("tel ", "phone: ", "call ", "mobile ", "fax: ")) + number if good else r.choice(("", "total ", "about ", "pages ")) + r.choice((number, plain)))
        elif kind == "national_id":
            number = f"{pick(digit, 3)}-{pick(digit, 2)}-{pick(digit, 4)}"
            text = lead + (r.choice(("ssn ", "ssn: ", "social security: ", "tax number ")) + number if good else r.choice(("", "item ", "on ", "range ")) + number.replace("-", r.choice("- ")))
        elif kind == "iban":
            groups = " ".join(pick(digit, 4) for _ in range(r.randint(3, 5)))
            text = lead + (r.choice(("iban ", "IBAN: ", "account ", "bank account: ")) + pick(upper, 2) + pick(digit, 2) + " " + groups if good else r.choice(("", "model ", "room ")) + pick(upper, 2) + pick(digit, 2) + " " + " ".join(pick(upper + digit, 4) for _ in range(r.randint(2, 4))))
        else:
            site = f"{word()}{r.choice((' at ', ' [at] ', ' (at) ', ' AT '))}{word()}{r.choice((' dot ', ' [dot] ', ' (dot) '))}{r.choice(('com', 'org', 'net', 'de'))}"
            text = lead + (r.choice(("mail me: ", "contact ", "write to ", "e-mail ")) + site if good else f"{words(1, 3)} at {word()} dot {r.choice(('line', 'matrix', 'plot', 'com'))}")
        out.append((kind, text + " " + words(0, 3), good))
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH) -> list:
    """Gradient boosted trees for logistic loss. A tree: a leaf's value, or (feature, limit, left, right); left is at or below."""
    trees, score = [], np.zeros(len(y))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        value = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        if level == 0 or len(rows) < 2 * LEAST:
            return value
        best, total = (1e-6, None, None), g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f in range(x.shape[1]):
            v = x[rows, f]
            for limit in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 19))):
                left = v <= limit
                if LEAST <= left.sum() <= len(rows) - LEAST:
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gain = gl**2 / (hl + 1.0) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + 1.0) - total
                    if gain > best[0]:
                        best = (gain, f, float(limit))
        if best[1] is None:
            return value
        left = x[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[left], g, h, level - 1), grow(rows[~left], g, h, level - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), y - p, p * (1 - p), depth))
        score += predict(trees[-1:], x)
    return trees


def predict(trees: list, x: np.ndarray) -> np.ndarray:
    def one(tree, rows: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(rows), tree)
        left = x[rows, tree[0]] <= tree[1]
        out = np.empty(len(rows))
        out[left], out[~left] = one(tree[2], rows[left]), one(tree[3], rows[~left])
        return out

    return sum((one(t, np.arange(len(x))) for t in trees), np.zeros(len(x)))


def as_column(trees: list, values: list[Column]) -> Column:
    """The trees' sum as an expression over the features."""

    def one(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(values[tree[0]] <= tree[1], one(tree[2])).otherwise(one(tree[3]))

    return reduce(lambda a, b: a + b, map(one, trees))


def train(spark: SparkSession, n: int = EXAMPLES, seed: int = SEED) -> tuple[list, dict[str, float]]:
    """Trees, and for each kind the score from which held-out examples are personal data with PRECISION at least."""
    rows = examples(n, seed)
    frame = spark.createDataFrame([(i, k, t, y) for i, (k, t, y) in enumerate(rows)], "i int, k string, t string, y int")
    parts = []
    for kind in GENERATORS:
        longest = F.array_sort(F.transform(candidates(F.col("t"), kind), lambda s: F.struct((-F.length(s["hit"])).alias("n"), s.alias("s"))))
        own = frame.where(F.col("k") == kind).withColumn("s", F.get(longest, F.lit(0))["s"]).where("s is not null")
        values = features(F.col("s"), kind)
        parts.append(own.select("i", "y", F.array(*values.values()).alias("x")))
    got = sorted(tuple(r) for r in reduce(DataFrame.unionAll, parts).collect())  # at most n rows
    i, y, x = (np.array(c) for c in zip(*got, strict=True))
    held = i % 3 == 0
    trees = fit(x[~held], y[~held].astype(float))
    score, limits = predict(trees, x), {}
    for k, kind in enumerate(GENERATORS):
        mine = held & (x[:, -1] == k)
        order = np.argsort(-score[mine], kind="stable")
        s, good = score[mine][order], y[mine][order]
        right = np.cumsum(good) / np.arange(1, len(good) + 1)
        fine = np.flatnonzero((right >= PRECISION) & (np.append(s[1:], -np.inf) < s))
        limits[kind] = float(max(s[fine[-1]], 0.0)) if len(fine) else float("inf")
    return trees, limits


#: Characters of a piece of text, and pieces of a stretch, by which spans are looked up.
PIECE, STRETCH = 1024, 64


def by_place(items: str, length: Column, span: Callable[[Column], Column]) -> Column:
    """For each piece of a text of that length the items whose spans reach into it. Stretches of pieces come first, so that each item is
    looked at about as often as there are stretches, and not for each piece."""
    inside = lambda x, at, size: (span(x)["start"] < (at + 1) * size) & (span(x)["end"] > at * size)
    upto = lambda size: F.sequence(F.lit(0).cast("long"), F.floor(length / size))
    stretches = F.transform(upto(PIECE * STRETCH), lambda i: F.filter(items, lambda x: inside(x, i, PIECE * STRETCH)))
    # the array is bound once, for all pieces that are looked up in it
    return F.transform(F.array(stretches), lambda s: F.transform(upto(PIECE), lambda i: F.filter(F.get(s, F.floor(i / STRETCH).cast("int")), lambda x: inside(x, i, PIECE))))[0]


def any_near(near: str, span: Column, test: Callable[[Column], Column]) -> Column:
    """Whether the test holds of an item in the pieces that a span (not empty) reaches into."""
    pieces = F.sequence(F.floor(span["start"] / PIECE), F.floor((span["end"] - 1) / PIECE))
    return F.exists(pieces, lambda i: F.exists(F.get(near, i.cast("int")), test))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns in carry, base and spans: arrays of (start, ord, kind, end) by start, then kind; all in one projection of the rows."""
    trees, limits = model or train(docs.sparkSession)
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)))
    text = F.col("text")
    df = df.withColumns({f"b_{k}": base_spans(text, k) for k in BASE} | {f"g_{k}": candidates(text, k) for k in GENERATORS})

    def as_span(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), s["end"].alias("end"))

    df = df.withColumn("base", F.array_sort(F.concat(*[F.transform(f"b_{k}", as_span(k)) for k in BASE])))

    def scored(kind: str) -> Column:
        every = F.transform(f"g_{kind}", lambda s: F.struct(as_column(trees, list(features(s, kind).values())).alias("score"), as_span(kind)(s).alias("span")))
        return F.filter(every, lambda c: c["score"] >= limits[kind])

    picked = [scored(k) for k in GENERATORS if limits[k] < float("inf")]
    df = df.withColumn("picked", F.concat(*picked) if picked else F.array().cast("array<struct<score:double,span:struct<start:long,ord:int,kind:string,end:long>>>"))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    df = df.withColumn("near", by_place("base", F.length("text"), lambda b: b))
    df = df.withColumn("free", F.filter("picked", lambda c: ~any_near("near", c["span"], lambda b: meets(b, c["span"]))))
    df = df.withColumn("near", by_place("free", F.length("text"), lambda d: d["span"]))
    better = lambda d, c: (d["score"] > c["score"]) | ((d["score"] == c["score"]) & ((d["span"]["start"] < c["span"]["start"]) | ((d["span"]["start"] == c["span"]["start"]) & (d["span"]["ord"] < c["span"]["ord"]))))
    best = F.filter("free", lambda c: ~any_near("near", c["span"], lambda d: meets(d["span"], c["span"]) & better(d, c)))
    return df.select("doc_id", "text", *(F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)), "base", F.array_sort(F.concat("base", F.transform(best, lambda c: c["span"]))).alias("spans"))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """The text with each maximal run of overlapping spans replaced by the kind of its first, in angle brackets."""
    kind = "struct<pos:long,out:array<string>>"
    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out")).cast(kind)
    cut_ = lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(cut_(acc["pos"], s["start"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], fresh).otherwise(acc["out"]).alias("out")).cast(kind)

    whole = F.aggregate(spans, zero, step)
    joined = F.transform(F.array(whole), lambda w: F.concat(F.array_join(w["out"], ""), F.substring(F.col(text), (w["pos"] + 1).cast("int"), F.lit(2147483647))))[0]
    return F.when(F.size(spans) > 0, joined).otherwise(F.col(text))
