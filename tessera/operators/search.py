"""Ranking and similarity: BM25, dense vectors, question caches, near duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import jaccard, ranking_terms, tokens
from .keep import discard, keep, ranked
from .traverse import connected_components


def weighted(nodes: DataFrame) -> DataFrame:
    """id, terms, fields of graph nodes for ranking: the label three times, the summary twice, file and type once; fields: each once."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    body = F.concat_ws(" ", *[filled("label")] * 3, *[filled("summary")] * 2, filled("file"), filled("type"))
    return nodes.select("id", ranking_terms(body).alias("terms"), ranking_terms(F.concat_ws(" ", filled("label"), filled("summary"), filled("file"), filled("type"))).alias("fields"))


def keyword_search(nodes: DataFrame, question: list[str], k: int = 10) -> DataFrame:
    """id, score of the k best nodes by BM25 over weighted fields, a document's length against 20 terms; all terms found: half more."""
    words = sorted(set(question))
    base = weighted(nodes).where(F.size("terms") > 0)
    asked = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    hits = base.select("id", F.size("terms").alias("n"), F.explode(F.filter("terms", lambda x: F.array_contains(asked, x))).alias("term")).groupBy("id", "n", "term").agg(F.count("*").alias("tf"))
    frequency = base.select(F.explode(F.array_distinct(F.filter("fields", lambda x: F.array_contains(asked, x)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = nodes.agg(F.count("*").alias("docs"))
    joined = hits.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(total))  # a row for each term of the question, and one row
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (F.lit(0.25) + 0.75 * F.col("n") / 20.0))
    full = F.when(F.countDistinct("term") == len(words), 1.5).otherwise(1.0)
    return joined.groupBy("id").agg(F.round(F.sum(part) * full, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def bm25(docs: DataFrame, question: list[str], k: int = 10, k1: float = 1.5, b: float = 0.75, average: float | None = None, boost: float = 1.5) -> DataFrame:
    """id, score of the k best rows of docs (id, text). Only the question's terms are exploded, so the shuffle follows the matches."""
    words = F.array(*[F.lit(w) for w in question])
    base = docs.select("id", tokens(F.coalesce("text", F.lit(""))).alias("t")).withColumn("n", F.size("t"))
    stats = base.agg(F.count("*").alias("docs"), F.avg("n").alias("avg"))
    hits = base.select("id", "n", F.explode(F.filter("t", lambda x: F.array_contains(words, x))).alias("term")).groupBy("id", "n", "term").agg(F.count("*").alias("tf"))
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    mean = F.lit(average) if average is not None else F.col("avg")
    joined = hits.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(stats))  # a row for each term of the question, and one row
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (F.lit(1 - b) + b * F.col("n") / mean))
    full = F.when(F.countDistinct("term") == len(set(question)), boost).otherwise(1.0)
    return joined.groupBy("id").agg(F.round(F.sum(part) * full, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def question_key(question: Column) -> Column:
    """Key of a stored question: twelve hex digits of its md5, without case and outer white space."""
    return F.substring(F.md5(F.lower(F.trim(question)).cast("binary")), 1, 12)


def question_words(question: Column) -> Column:
    """Distinct words of letters and digits, for likeness of questions."""
    return F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9]+"), F.lit(0)))


def stored_answer(stored: DataFrame, question: str, key: str, least: float = 0.8) -> DataFrame:
    """key, answer of the stored question (key, question, answer) of that key, else of the most similar one at or over `least`."""
    like = jaccard(question_words(F.col("question")), question_words(F.lit(question)))
    return stored.select("key", "answer", F.when(F.col("key") == key, 2.0).otherwise(like).alias("j")).where(F.col("j") >= least).orderBy(F.desc("j"), "key").limit(1).select("key", "answer")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_top_k(vectors: DataFrame, query: DataFrame, k: int = 15) -> DataFrame:
    """vec_id, score: the k rows nearest to the single query row by dot product."""
    q = F.broadcast(query.select(F.col("embedding").alias("q")))
    return vectors.crossJoin(q).select("vec_id", F.round(dot(F.col("embedding"), F.col("q")), 5).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


#: Rows of one key that are paired directly; words of a longest key.
PAIRED, LONGEST = 64, 3


def _fewest(n: str | Column, least: float) -> Column:
    """Words that a set of n must share with one that similar."""
    return F.ceil((F.col(n) if isinstance(n, str) else n) * least - 1e-9)


#: Counters by which words are ordered; each task sends what it counted in rows of CHUNK.
SLOTS, CHUNK = 1 << 20, 1 << 16


def _slot(words: np.ndarray) -> np.ndarray:
    """A counter for each hashed word; its multiplier spreads words that are small numbers, too."""
    return ((words.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each list begins (and the last one ends)."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False), at - at[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        counts += np.bincount(_slot(_lists(batch.column(0))[0]), minlength=SLOTS)
    used = [i for i in range(SLOTS // CHUNK) if counts[i * CHUNK : (i + 1) * CHUNK].any()]
    packed = [pa.compress(counts[i * CHUNK : (i + 1) * CHUNK].astype(np.int32).tobytes(), "lz4", asbytes=True) for i in used]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            total[c] = total.get(c, 0) + np.frombuffer(pa.decompress(x, 4 * CHUNK, "lz4", asbytes=True), np.int32).astype(np.int64)
    ranks = [np.rint(4 * np.log2(x + 1)).astype(np.uint8).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], names=["chunk", "ranks"])


def rarity(sets: DataFrame) -> np.ndarray:
    """A byte for each counter of words, more for more frequent ones: what the words of all sets (id, s: hashed words) count in it. It orders
    words for all sets alike, with ties by the word; no shuffle holds a word."""
    counted = sets.select("s").mapInArrow(_counted, "chunk int, counts binary").repartition("chunk").mapInArrow(_ranks, "chunk int, ranks binary")
    out = np.zeros(SLOTS, np.uint8)
    for r in counted.collect():  # SLOTS bytes in all
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.ranks, np.uint8)
    return out


def parities(words: np.ndarray) -> bytes:
    """A bit for each residue of a word, flipped by every word that has it; at least half as many bits as words."""
    bits = max(128, 1 << max(0, (len(words) // 2 - 1)).bit_length())
    odd = np.bincount((words & (bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def parted(a: bytes, b: bytes) -> int:
    """Words that are in one of two sets only, at the least, by their parities."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _prefixed(least: float, longest: int, ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _lists(batch.column(1))
            size, firsts, signs = np.diff(at), [], []
            for i, n in enumerate(size.tolist()):
                s = flat[at[i] : at[i + 1]]
                firsts.append(s[np.lexsort((s, ranks[_slot(s)]))[: n - int(np.ceil(n * least - 1e-9)) + longest]])
                signs.append(parities(s))
            ends = np.concatenate(([0], np.cumsum([len(f) for f in firsts])))
            w = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts) if firsts else flat[:0], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), w, pa.array(signs, pa.binary())], names=["id", "n", "w", "sign"])

    return run


def _longest(least: float, longest: int = LONGEST) -> int:
    """Words of a longest key: different sets of this Jaccard share as many words as keys are long, or keys stay shorter."""
    return max(1, min(longest, max((k for k in range(1, 10) if least > (k - 1) / k), default=1)))


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """id, n, w, sign of sets (id long, s: hashed words): size, the words that keys are made of (rarest first), and parities."""
    return sets.select(F.col("id").cast("long").alias("id"), "s").mapInArrow(_prefixed(least, _longest(least), rarity(sets)), "id long, n int, w array<long>, sign binary")


def keyed(first: DataFrame, least: float, paired: int = PAIRED, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Keys under which sets of Jaccard `least` and more meet, from what `prefixes` gives, written: rows (key, id, n, p) of keys with at
    most `paired` rows, and of the others, with the key's first id. p: the place of the key's last word.

    Sets that similar share a word among the first n - c + 1 of each, c being what they must share (prefix filter). Where a word is in
    too many sets, its rows get keys of two words, then three: the first k words two sets share are among the first n - c + k of each.
    So a frequent word costs pairs only of sets that share rarer company, too.
    """
    longest = _longest(least, longest)
    upto = lambda k: (F.col("n") - _fewest("n", least) + k).cast("int")
    rows = first.select("id", "n", F.posexplode(F.slice("w", 1, upto(1))).alias("i", "key")).select("key", "id", "n", (F.col("i") + 1).alias("p"))
    few = []
    for k in range(1, longest + 1):
        sizes = keep(rows.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("first")).where("m > 1"), f"sizes{k}")  # most words are in one set
        met = keep(rows.join(sizes, "key"), f"keys{k}")
        discard(sizes)
        few.append(met.where(F.col("m") <= paired).drop("m", "first"))
        hot = met.where(F.col("m") > paired).drop("m")
        if k == longest:
            break
        more = hot.join(first.select("id", "w"), "id").select("key", "id", "n", "p", F.posexplode(F.slice("w", 1, upto(k + 1))).alias("i", "x")).where("i >= p")
        rows = more.select(F.xxhash64("key", "x").alias("key"), "id", "n", (F.col("i") + 1).alias("p"))
    hot.written = met.written
    return reduce(DataFrame.unionByName, few), hot


def _met(rows: DataFrame, least: float) -> DataFrame:
    """a, b (a < b): pairs of rows of one key that sizes and places allow to be that similar, if the key is the first they share."""
    other = rows.toDF("key", "other", "n2", "p2")
    both = rows.join(other, "key").where("id < other")
    most = 1 + F.least(F.col("n") - F.col("p"), F.col("n2") - F.col("p2")) + F.lit(LONGEST - 1)
    needed = F.ceil((F.col("n") + F.col("n2")) * (least / (1 + least)) - 1e-6)
    fits = (F.least("n", "n2") >= F.greatest("n", "n2") * least - 1e-9) & (most >= needed)
    return both.where(fits).select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()


def earlier_match(questions: DataFrame, least: float = 0.8) -> DataFrame:
    """For each question (id, w: its distinct words) the earlier one of highest Jaccard at or over `least`; ties: the smallest id.

    Equal sets are one entry. Entries meet under keys of their rarest words (`keyed`), so only those are joined.
    """
    rows = questions.where(F.size("w") > 0).select("id", F.array_sort("w").alias("w"))
    entries = keep(rows.groupBy("w").agg(F.min("id").alias("key")), "entries")
    few, hot = keyed(keep(prefixes(entries.select(F.col("key").alias("id"), _hashed("w").alias("s")), least), "first"), least)
    pairs = _met(few.unionByName(hot.drop("first")), least).select(F.col("a").alias("key"), F.col("b").alias("other"))
    scored = pairs.join(entries.select("key", F.col("w").alias("a")), "key").join(entries.select(F.col("key").alias("other"), F.col("w").alias("b")), "other")
    scored = keep(scored.select("key", "other", jaccard(F.col("a"), F.col("b")).alias("j")).where(F.col("j") >= least), "scored")
    each = scored.unionByName(scored.select(F.col("other").alias("key"), F.col("key").alias("other"), "j")).unionByName(entries.select("key", F.col("key").alias("other"), F.lit(1.0).alias("j")))
    found = rows.join(entries, "w").select("id", "key").join(each, "key").where("other < id")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("j"), "other"))
    return found.withColumn("rn", rank).where("rn = 1").select("id", F.col("other").alias("key"), F.round("j", 6).alias("similarity"))


def _hashed(words: str) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def shingles(text: Column, n: int = 4) -> Column:
    """Distinct n-word shingles, the whole text if it has fewer words."""

    def of(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, F.array_distinct(many)).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(tokens(text)), of)[0]


def _windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(n)]
        for batch in batches:
            flat, at = _lists(batch.column(1))
            flat, sets = flat.view(np.uint64), []
            for i in range(len(at) - 1):
                h = flat[at[i] : at[i + 1]]
                k = min(n, len(h))
                out = np.full(len(h) - k + 1 if k else 0, k, np.uint64)
                for j in range(k):
                    out += h[j : len(h) - k + 1 + j] * odd[j]
                out = (out ^ (out >> np.uint64(32))) * odd[0]
                sets.append(np.unique((out ^ (out >> np.uint64(29))).view(np.int64)))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
            s = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else flat[:0].view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), s], names=["id", "chars", "s"])

    return run


def hashed_shingles(docs: DataFrame, n: int = 4) -> DataFrame:
    """id, chars, s of docs (id long, text): the length of the text, and the sorted hashes of its shingles (as `shingles` has them). Nothing
    is shuffled or written, so it may be asked for more than once."""
    words = docs.select(F.col("id").cast("long").alias("id"), F.coalesce(_hashed(tokens(F.col("text"))), F.array().cast("array<long>")).alias("t"), F.length("text").alias("chars"))
    return words.mapInArrow(_windows(n), "id long, chars int, s array<long>")


#: Bits of a test for ids, at most.
MOST_BITS = 1 << 25


def may_hold(ids: DataFrame):
    """A test of a column of ids: true for all of ids (id) and few others, so that little more than their sets is shuffled; the join that
    follows decides. A bit for each slot of a hash, at most MOST_BITS, whatever the number of ids."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (8 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    set_ = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("set"))
    held = np.zeros(bits >> 6, np.int64)
    for r in set_.toLocalIterator():  # at most MOST_BITS / 64 rows
        held[r.word] = r["set"]

    @F.pandas_udf("boolean")
    def test(slots: pd.Series) -> pd.Series:
        s = slots.to_numpy()
        return pd.Series((held[s >> 6] >> (s & 63)) & 1 == 1)

    return lambda column: test(F.pmod(F.xxhash64(column), F.lit(bits)))


def fetched(texts: DataFrame, ids: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows of texts (id, ...) whose id is in ids (id, each once), dealt over that many tasks where it is set."""
    ids = keep(ids, "ids")
    some = texts.where(may_hold(ids)("id"))
    return (some if tasks is None else some.repartition(tasks, "id")).join(ids, "id", "left_semi")


#: Rows of a block; two blocks are compared in one unit of work.
BLOCK = 256


def unit_links(ids: list[int], comps: list[int], minor: list[bool], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between rows of different components, at least one of them minor, that join what isn't joined yet."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not sizes.all():
        raise ValueError("sets must not be empty")
    flat, word = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    marked, head = np.zeros(len(flat), np.int64), {c: c for c in comps}

    def find(c: int) -> int:
        while head[c] != c:
            head[c] = c = head[head[c]]
        return c

    out = []
    for x in np.flatnonzero(minor).tolist():
        own = word[start[x] : start[x] + sizes[x]]
        marked[own] = 1
        both = np.add.reduceat(marked[word], start)
        marked[own] = 0
        for y in np.flatnonzero(both >= least * (sizes + sizes[x] - both) - 1e-9).tolist():
            u, v = find(comps[x]), find(comps[y])
            if u != v:
                head[u] = v
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
    return out


def _units(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            pairs = unit_links(*(list(c) for c in zip(*held, strict=True)), least)
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:  # sorted by unit, each of about two blocks
            for key, i, j, id_, comp, minor, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != now and held:
                    yield out()
                    held = []
                now = (key, i, j)
                held.append((id_, comp, minor, np.unique(np.array(s, np.int64))))
        if held:
            yield out()

    return run


def _sized(rows: DataFrame) -> DataFrame:
    """key, first, cost of keys whose rows (key, id, comp) are in several components: the first id, and how many rows the key's units would have."""
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    keys = parts.groupBy("key").agg(F.count("*").alias("comps"), F.min("first").alias("first"), F.sum("size").alias("rows"), F.max("size").alias("most")).where("comps > 1")
    minor = F.col("rows") - F.col("most")
    mine, theirs = F.ceil(minor / BLOCK), F.ceil(F.col("most") / BLOCK)
    return keys.select("key", "first", (minor * (mine + theirs) + F.col("most") * mine).alias("cost"))


def pooled(rows: DataFrame) -> DataFrame:
    """Rows (key, id, n, comp) of keys in several components, by key or pooled. A group of near copies shares very many keys, under each of which its
    rows would meet again; keys with one first row are pooled to one key of all their rows where its units have no more rows than theirs."""
    keys = keep(_sized(rows), "sized")
    open_ = keep(rows.join(keys, "key").select("key", "id", "n", "comp", "first"), "open")
    once = keep(open_.select(F.xxhash64("first").alias("key"), "id", "n", "comp", "first").distinct(), "pooled")
    together = _sized(once).select("key", F.col("cost").alias("together"))
    by_key = keys.groupBy(F.xxhash64("first").alias("key"), "first").agg(F.sum("cost").alias("by_key"))
    better = keep(by_key.join(together, "key").where("together <= by_key").select("first"), "better")
    apart, one = open_.join(better, "first", "left_anti"), once.join(better, "first", "left_semi")
    out = keep(apart.unionByName(one).select("key", "id", "n", "comp"), "meeting")
    discard(keys, open_, once, better)
    return out


def dealt(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Blocks of keys whose rows (key, id, n, comp) are in several components: the rows with their block (key, id, comp, minor, n, at), and the
    blocks with the sizes in them (key, minor, at, low, high). Rows outside of a key's largest component are minor. A block has about
    `block` rows of neighbouring sizes: it follows from how many rows are smaller, and within one size from the id."""
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("size"))
    split = parts.groupBy("key").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("size", "comp")).alias("major")).where("comps > 1").drop("comps")
    side = rows.join(split, "key").withColumn("minor", F.col("comp") != F.col("major")).drop("major")
    sizes = side.groupBy("key", "minor", "n").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("key", "minor").orderBy("n")) - F.col("c")
    spread = sizes.withColumn("before", before)  # a row for each size
    at = F.floor((F.col("before") + F.pmod(F.xxhash64("id"), F.col("c"))) / block)
    placed = keep(side.join(spread, ["key", "minor", "n"]).select("key", "id", "comp", "minor", "n", at.alias("at")), "placed")
    blocks = placed.groupBy("key", "minor", "at").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    return placed, blocks


def _allowed(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb, most = (c.to_pylist() for c in batch.columns)
            hit = pa.array([parted(x, y) <= m for x, y, m in zip(sa, sb, most, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["a", "b"])

    return run


def similar_pairs(docs: DataFrame, least: float, texts: Callable[[DataFrame], DataFrame] | None = None, only: DataFrame | None = None) -> DataFrame:
    """a, b (a < b): links of rows (id, s: a set) with Jaccard at or over `least`; every group of such rows is spanned, no link
    between different groups is lost, and not all pairs within a group are made.

    Sets meet under keys of one to LONGEST of their rarest words (`keyed`). Keys of at most PAIRED rows pair them. What shares a whole key and
    is still many, as near copies of one text are, meets the key's first row; what is then in one component needs no more, and the rest
    is compared in units of two blocks, dealt out over tasks, once for all keys that such a group shares (`pooled`). Equal sets are one row before; empty sets are linked with nothing.

    A set is not shuffled before the parities of its words and another's allow a link; until then only its first words are. docs is read
    for the counts, the first words, and the sets of what may link. texts: docs of some ids (id) only, where the caller knows a
    shorter way. only: the ids (id) that are to be linked, where docs has more.
    """
    whole_of = texts or (lambda ids: fetched(docs, ids))
    long_ = dict(docs.dtypes)["s"] == "array<bigint>"
    hashed = lambda df: df.select("id", F.col("s") if long_ else _hashed("s").alias("s"))
    first = prefixes(hashed(docs.where(F.size("s") > 0)), least)
    first = keep(first if only is None else first.join(only, "id", "left_semi"), "first")
    few, hot = keyed(first, least)
    signs = first.select("id", "n", "sign")

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(signs.toDF("a", "na", "sa"), "a").join(signs.toDF("b", "nb", "sb"), "b")
        most = ((F.col("na") + F.col("nb")) * ((1 - least) / (1 + least)) + 1e-6).alias("most")
        some = keep(both.select("a", "b", "sa", "sb", most).mapInArrow(_allowed(least), "a long, b long"), "allowed")
        sets = keep(hashed(whole_of(some.select(F.explode(F.array("a", "b")).alias("id")).distinct())), "sets")
        both = some.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        out = keep(both.where(jaccard(F.col("sa"), F.col("sb")) >= least).select("a", "b"), "links")
        discard(some, sets)
        return out

    star = hot.where("first < id").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    found = near(_met(few, least).unionByName(star).distinct())
    discard(first)
    if hot.isEmpty():
        return found
    comps = connected_components(hot.select("id").distinct(), found.select(F.col("b").alias("src"), F.col("a").alias("dst"))).withColumnRenamed("component", "comp")
    meeting = pooled(hot.drop("p", "first").join(comps, "id"))
    discard(hot)
    placed, blocks = dealt(meeting)
    mine, other = blocks.where("minor").drop("minor"), blocks.toDF("key", "minor2", "at2", "low2", "high2")
    fit = (F.col("low") <= F.col("high2") / least + 1e-9) & (F.col("low2") <= F.col("high") / least + 1e-9) & (~F.col("minor2") | (F.col("at") <= F.col("at2")))
    pairs = keep(mine.join(other, "key").where(fit).select("key", F.col("at").alias("i"), F.when(F.col("minor2"), F.col("at2")).otherwise(-F.col("at2") - 1).alias("j")), "units")
    at = F.when(F.col("minor"), F.col("at")).otherwise(-F.col("at") - 1)
    rows = placed.select("key", "id", "comp", "minor", at.alias("at"))
    sides = pairs.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("at"))
    sides = keep(sides.join(rows, ["key", "at"]), "sides")
    sets = hashed(whole_of(sides.select("id").distinct()))
    whole = sides.join(sets, "id").select("key", "i", "j", "id", "comp", "minor", "s")
    compared = whole.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_units(least), "a long, b long")
    return found.unionByName(compared).distinct()


def representatives(groups: DataFrame) -> DataFrame:
    """component, representative, members, similarity of groups (component, id, text or its chars, s: a set, or h: its `minhash`) with two members and more: the member
    with the longest text (ties: the first by id), and the average similarity of pairs as MinHash estimates it: the share of equal
    hashes in HASHES positions. Positions are counted by value, so no pairs are made."""
    chars = F.col("chars") if "chars" in groups.columns else F.length("text")
    many = groups.groupBy("component").agg(F.count("*").alias("members"), F.min_by("id", F.struct((-chars).alias("neg"), "id")).alias("representative")).where("members > 1")
    signed = groups.join(many.select("component"), "component").select("component", F.posexplode(F.col("h") if "h" in groups.columns else minhash(F.col("s"), HASHES)).alias("i", "h"))
    equal = signed.groupBy("component", "i", "h").agg((F.count("*") * (F.count("*") - 1) / 2).alias("p")).groupBy("component").agg(F.sum("p").alias("p"))
    pairs = F.col("members") * (F.col("members") - 1) / 2
    return many.join(equal, "component").select("component", "representative", "members", F.round(F.col("p") / (pairs * HASHES), 6).alias("similarity"))


HASHES = 128


def minhash(sets: Column, hashes: int) -> Column:
    """Signature: the least hash of the set for each of `hashes` seeds."""
    return F.array(*[_least(sets, i) for i in range(hashes)])


def _least(sets: Column, seed: int) -> Column:
    return F.array_min(F.transform(sets, lambda s: F.xxhash64(F.lit(seed), s)))


def next_fit(sizes: DataFrame, capacity: int) -> DataFrame:
    """id, batch: items (id, tokens; at most some ten thousand different sizes) in descending order, ties by id, go to the current batch
    or open the next when it is full; an item over the capacity has a batch of its own.

    Items of one size fill batches in a regular way: some go to the batch that is open, the others in equal numbers to the next ones. So the
    histogram says where each rank of a size goes, and items find their batch by a join on the size: one packing, without a fold.
    """
    placed = ranked(sizes.select("id", "tokens"), F.desc("tokens"), F.col("id"))
    histogram = [(r.tokens, r.n) for r in placed.groupBy("tokens").agg(F.count("*").alias("n")).orderBy(F.desc("tokens")).collect()]
    rows, batch, used, first = [], -1, capacity + 1, 0  # batch: the open one; nothing is open at first
    for tokens, n in histogram:
        room = max(1, capacity // tokens) if tokens > 0 else n
        here = min(n, (capacity - used) // tokens if tokens > 0 else n) if 0 <= used <= capacity else 0
        rows.append((tokens, first, here, batch, room))
        left = n - here
        if left:
            batch += -(-left // room)
            used = (left - 1) % room * tokens + tokens
        else:
            used += here * tokens
        first += n
    slots = sizes.sparkSession.createDataFrame(rows, "tokens long, first long, here long, open long, room long")
    r = F.col("rank") - F.col("first")
    found = placed.withColumn("tokens", F.col("tokens").cast("long")).join(slots, "tokens")
    return found.select("id", F.when(r < F.col("here"), F.col("open")).otherwise(F.col("open") + 1 + F.floor((r - F.col("here")) / F.col("room"))).cast("long").alias("batch"))
