"""Jaccard join of shingle sets, size-aware: small sets meet by enumerated subsets, large ones by scanning inverted lists.

1. A document's set: distinct hashes of its 4-word shingles. Equal sets become one entry.
2. One order of shingles for all: by how often they occur in all documents (counts in SLOTS slots, summed over all tasks), then by hash.
   Two sets that link share at least `need` = ceil(least * size) of each one's shingles, so
   - the first shared one is among the first size - need + 1 of each (the lists to scan), and
   - the first K shared ones are among the first size - need + K of each (the subsets to enumerate).
3. Sets of at most `boundary` shingles are light: each subset of K from its first shingles is a key, and chance hardly ever makes two sets
   share one. Larger ones are heavy: they scan the inverted lists of single shingles, in which light sets that are large enough for a heavy
   partner stand too. The boundary is where enumerating plus scanning costs least, from the sizes and list lengths of all entries.
4. Rows of a key stream past up to LEADERS leaders (the first of each class of ids) in order, so a key is linear in its rows and held by
   nobody; a key that the counts show hot is dealt out over salts, whose leaders meet again. What links becomes components. Keys that still
   hold several components are finished exactly: all pairs between components for keys of at most LIST rows, else blocks of BLOCK rows in
   units of two blocks, dealt out over tasks. Rows of a key's largest component don't meet each other again, so a large group of near
   copies costs about one pass.
5. A pair goes on if its signatures allow it: every shingle flips one bit of a set's bitmap, so bits that differ bound the difference of
   the sets from below. Then whole texts are fetched and sets compared. Components are grown to the fixed point.

Rows are judged each by itself: a repeated doc_id is several nodes. Null or empty text, or no words: an empty set, linked with nothing.
Rows with a null doc_id link like any other; component_id is the smallest doc_id that isn't null, or null if there is none.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batch_bytes, cut, mapped, shuffle_partitions
from .simhash import components

WORDS, LEAST = 4, 85  #: least: percent of the union
K = 2  #: shingles of an enumerated subset
SLOTS, CHUNK = 1 << 22, 1 << 16  #: counters of shingles, and counters of a row while they are summed
LIGHTEST = 4096  #: no set above this size is ever light
LEADERS, LIST, BLOCK = 4, 16, 256
HELD = 1 << 16  #: words whose hashes a task keeps
TEXTS = 500  #: texts whose sets a task holds at once
HOT = 1 << 20  #: rows of a key, by the counts, from which on it is salted
KEY_BITS = 48  #: of a key in the shuffle; keys that fall together only give pairs to look at
BITS = 128  #: least bits of a signature; sets of more shingles have more
MOST_BITS = 1 << 25  #: bits of a test for ids
_SEED = 42
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, _SEED)
        return h


class Shingler:
    """The set of a text: sorted distinct 64-bit hashes of its shingles."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, _Words()
        self.odd = [np.uint64(pow(int(_MIX), i + 1, 1 << 64)) for i in range(words)]

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(LOWER).split()
        if len(self.known) > HELD:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(h))
        if not n:
            return h
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out += h[i : len(h) - n + 1 + i] * self.odd[i]
        return np.unique(mix(out))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def need(n, least: int = LEAST):
    """Shingles that a set of n must share with a partner."""
    return (least * n + 99) // 100


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(42)).astype(np.int64)


def _first(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = Shingler(words), np.zeros(SLOTS, np.int32)
        names = ["row", "doc_id", "n", "digest", "chunk", "counts"]
        for b in batches:
            sets = [of(t) for t in b.column(2).to_pylist()]
            np.add.at(counts, _slot(np.concatenate(sets)), 1)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        cut_ = range(0, SLOTS, CHUNK)
        none = pa.nulls(len(cut_))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64())] * 3 + [none.cast(pa.binary()), pa.array([i // CHUNK for i in cut_], pa.int32()), pa.array([pa.compress(counts[i : i + CHUNK].tobytes(), "zstd", asbytes=True) for i in cut_], pa.binary())], names=names)

    return run


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranks of a chunk's slots: four steps for each doubling of what all tasks counted."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[c] = total.get(c, 0) + np.frombuffer(pa.decompress(x, 4 * CHUNK, "zstd", asbytes=True), np.int32).astype(np.int64)
    ranks = [np.rint(4 * np.log2(x + 1)).astype(np.uint8).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], names=["chunk", "ranks"])


def signature(s: np.ndarray) -> bytes:
    """A bit for each residue of a shingle, flipped by every shingle that has it; at least half as many bits as shingles."""
    bits = max(BITS, 1 << max(0, (len(s) // 2 - 1)).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(a: bytes, b: bytes, na: int, nb: int, least: int = LEAST) -> bool:
    """Whether signatures allow two sets of these sizes to link; never false for sets that do."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (100 + least) <= (100 - least) * (na + nb)


def _prefixes(words: int, least: int, ranks: np.ndarray, partners: np.ndarray):
    """row, n, prefix (in the common order), signature, and what scanning its lists would cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(words)
        for b in batches:
            n, prefix, cost, signs = [], [], [], []
            for t in b.column(1).to_pylist():
                s = of(t)
                slots = _slot(s)
                order = np.lexsort((s, ranks[slots]))[: len(s) - need(len(s), least) + K]
                n.append(len(s))
                prefix.append(s[order].view(np.int64))
                lists = order[: len(s) - need(len(s), least) + 1]
                cost.append(len(lists) + float(partners[ranks[slots[lists]]].sum()))
                signs.append(signature(s))
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(p) for p in prefix]))), pa.int32()), pa.array(np.concatenate(prefix), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), flat, pa.array(signs, pa.binary()), pa.array(cost, pa.float64())], names=["row", "n", "prefix", "sign", "cost"])

    return run


def boundary(sizes: list[tuple[int, int, float]], least: int = LEAST) -> int:
    """The largest light size, from (size, entries, cost of scanning their lists): where subsets of light sets, lists of heavy ones and
    the rows of light sets in those lists cost least together."""
    rows = sorted(sizes)
    lists = sum(c for _, _, c in rows)
    best, at, subsets = lists, 0, 0
    for i, (n, count, cost) in enumerate(rows):
        subsets += count * comb(n - need(n, least) + K, K)
        lists -= cost
        shared = sum(m * (k - need(k, least) + 1) for k, m, _ in rows[: i + 1] if 100 * k >= least * n)
        if subsets + lists + shared < best:
            best, at = subsets + lists + shared, n
    return at


#: Kinds of key rows: a subset of a light set, and a light or heavy set in an inverted list.
SUBSET, LIGHT, HEAVY = 0, 1, 2


#: Key rows: key, salt, id, n, kind.
ROW = "key long, salt int, id long, n int, kind byte"
ROW_TYPES = (np.int64, np.int32, np.int64, np.int32, np.int8)


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of ROW, sorted by id, in the bytes of KEY_BITS keys and byte by byte of the others, ids by their differences."""
    key, salt, ids, n, kind = columns
    planes = lambda x, most: np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :most].T.tobytes()
    flat = planes(key, KEY_BITS // 8) + planes(salt, 4) + planes(np.diff(ids, prepend=0), 8) + planes(n, 4) + planes(kind, 1)
    return pa.compress(flat, "zstd", asbytes=True)


def unpacked(blob: bytes, rows: int) -> list[np.ndarray]:
    widths = (KEY_BITS // 8, 4, 8, 4, 1)
    flat, at, out = np.frombuffer(pa.decompress(blob, rows * sum(widths), "zstd", asbytes=True), np.uint8), 0, []
    for width, kind in zip(widths, ROW_TYPES, strict=True):
        wide = np.zeros((rows, np.dtype(kind).itemsize), np.uint8)
        wide[:, :width] = flat[at : at + rows * width].reshape(width, rows).T
        out.append(wide.view(kind).ravel())
        at += rows * width
    out[2] = np.cumsum(out[2])
    return out


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [unpacked(x, n) for n, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=[c.split()[0] for c in ROW.split(", ")])


def _keys(least: int, light: int, ranks: np.ndarray, rows: np.ndarray, buckets: int):
    """Key rows, packed by bucket of their key and salt: bucket, count, packed. rows: how many rows a shingle of each rank may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[np.ndarray, np.ndarray, int, int, int]] = []
            for i, n, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                p = p.values.to_numpy().view(np.uint64)
                salts = np.maximum(1, rows[ranks[_slot(p)]] // HOT)
                if n <= light:
                    x, y = np.triu_indices(len(p), 1)
                    out.append((mix(p[x] * _MIX + p[y] + np.uint64(K)), np.minimum(salts[x], salts[y]), i, n, SUBSET))
                if n > light or 100 * n >= least * (light + 1):
                    lists = n - need(n, least) + 1
                    out.append((p[:lists], salts[:lists], i, n, HEAVY if n > light else LIGHT))
            many = [len(k) for k, *_ in out]
            wide = lambda j, kind: np.repeat(np.array([x[j] for x in out], kind), many)
            both = lambda j, kind: np.concatenate([x[j] for x in out]) if out else np.empty(0, kind)
            ids, salts = wide(2, np.int64), both(1, np.int64)
            salt = np.where(salts > 1, mix(ids.view(np.uint64)) % salts.astype(np.uint64) + np.uint64(1), 0).astype(np.int32)
            key = both(0, np.uint64) & np.uint64((1 << KEY_BITS) - 1)
            own = (mix(key ^ (salt.astype(np.uint64) * _MIX)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            edge = np.searchsorted(own[order], np.arange(buckets + 1)).tolist()
            columns = [c[order] for c in (key.view(np.int64), salt, ids, wide(3, np.int32), wide(4, np.int8))]
            some = [(k, s, e) for k, (s, e) in enumerate(zip(edge, edge[1:], strict=False)) if s < e]
            blobs = [packed([c[s:e] for c in columns]) for _, s, e in some]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in some], pa.int32()), pa.array([e - s for _, s, e in some], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "count", "packed"])

    return run


class _Key:
    """What is held of the key that streams past: its first row, until there is a second, and its leaders."""

    def __init__(self, key: tuple[int, int], least: int):
        self.key, self.least, self.first, self.leaders = key, least, None, {}
        self.salted = key[1] > 0

    def feed(self, i: int, n: int, kind: int, met: list, pairs: list) -> None:
        if self.first is None:
            self.first = (i, n, kind)
            if self.salted:
                met.append((self.key[0], *self.first, True))
        elif not self.salted and self.first:
            met.append((self.key[0], *self.first, False))
            self.first = ()
        own = i % LEADERS
        if self.leaders:
            met.append((self.key[0], i, n, kind, self.salted and own not in self.leaders))
        for other, m, k in self.leaders.values():
            if other != i and 100 * min(n, m) >= self.least * max(n, m) and not kind == k == LIGHT:
                pairs.append((i, other))
        self.leaders.setdefault(own, (i, n, kind))


def _heads(least: int):
    """Of rows sorted by key, salt and id: those that aren't alone in their key (other null), and pairs of a row and a leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            met: list[tuple] = []
            pairs: list[tuple[int, int]] = []
            key, salt, ids, n, kind = (c.to_numpy() for c in b.columns)
            new = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1
            for s, e in zip(np.concatenate(([0], new)).tolist(), np.concatenate((new, [len(key)])).tolist(), strict=True):
                if e - s == 1 and s and e < len(key) and not salt[s]:
                    continue  # alone
                at = (int(key[s]), int(salt[s]))
                if now is None or now.key != at:
                    now = _Key(at, least)
                for row in zip(ids[s:e].tolist(), n[s:e].tolist(), kind[s:e].tolist(), strict=True):
                    now.feed(*row, met, pairs)
            pairs = list(dict.fromkeys(pairs))
            rows = [(*m, None) for m in met] + [(None, i, None, None, None, o) for i, o in pairs]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["key", "id", "n", "kind", "head", "other"])

    return run


def _allowed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb, sa, sb = (c.to_pylist() for c in b.columns[2:])
            hit = pa.array([100 * min(m, n) >= least * max(m, n) and may_link(x, y, m, n, least) for m, n, x, y in zip(na, nb, sa, sb, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(hit), b.column(1).filter(hit)], names=["a", "b"])

    return run


def linked(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= least * (len(a) + len(b) - both)


def _judge(words: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(words)
        held: dict[int, np.ndarray] = {}

        def set_of(i: int, text: bytes) -> np.ndarray:
            if i not in held:
                if len(held) >= 64:
                    held.clear()
                held[i] = of(text)
            return held[i]

        for b in batches:
            hit = pa.array([linked(set_of(i, x), set_of(j, y), least) for i, j, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(hit), b.column(1).filter(hit)], names=["a", "b"])

    return run


def unit_links(ids: np.ndarray, comps: np.ndarray, minor: np.ndarray, sets: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int]]:
    """Links between rows of different components, at least one of them minor, that join what isn't joined yet."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, local = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    mark = np.zeros(len(flat), np.int64)
    root = dict.fromkeys(comps.tolist())
    for c in root:
        root[c] = c

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for x in np.flatnonzero(minor).tolist():
        own = local[start[x] : start[x] + size[x]]
        mark[own] = 1
        both = np.add.reduceat(mark[local], start)
        mark[own] = 0
        hits = np.flatnonzero(100 * both >= least * (size + size[x] - both))
        for y in hits.tolist():
            u, v = find(int(comps[x])), find(int(comps[y]))
            if u != v:
                root[u] = v
                out.append((int(ids[x]), int(ids[y])))
    return out


def _units(words: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, of = None, [], Shingler(words)

        def out() -> pa.RecordBatch:
            ids, comps, minor, sets = zip(*held, strict=True)
            pairs = unit_links(np.array(ids), np.array(comps), np.array(minor), list(sets), least)
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], names=["a", "b"])

        for b in batches:  # sorted by unit; a unit has about two blocks
            for unit, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if unit != now and held:
                    yield out()
                    held = []
                now = unit
                held.append((*row[:3], of(row[3])))
        if held:
            yield out()

    return run


def may_hold(ids: DataFrame):
    """A test of ids that is true for all of ids (id) and for few others, so that little more than their texts is shuffled: a bit for each slot
    of a hash. It has at most MOST_BITS bits; beyond that it lets more through, and the join that follows decides."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (8 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("set"))
    held = np.zeros(bits >> 6, np.int64)
    for r in words.toLocalIterator():  # at most MOST_BITS / 64 rows
        held[r.word] = r["set"]

    @F.pandas_udf("boolean")
    def test(slots: pd.Series) -> pd.Series:
        s = slots.to_numpy()
        return pd.Series((held[s >> 6] >> (s & 63)) & 1 == 1)

    return lambda column: test(F.pmod(F.xxhash64(column), F.lit(bits)))


def links(entries: DataFrame, texts: DataFrame, light: int, ranks: np.ndarray, rows: np.ndarray, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """a, b: links that span every component of entries (id, n, prefix, sign); texts: id, text (binary) of at least these."""
    made = "key long, id long, n int, kind byte, head boolean, other long"
    made_keys = _keys(least, light, ranks, rows, shuffle_partitions(entries.sparkSession))
    blobs = mapped(entries.select("id", "n", "prefix"), made_keys, "bucket int, count int, packed binary", rows=500)
    keys = mapped(blobs.repartition("bucket"), _unpacked, ROW, rows=64)  # all rows of a key and salt are in one bucket
    heads = cut(mapped(keys.sortWithinPartitions("key", "salt", "id"), _heads(least), made, rows=20_000), "heads")
    met = heads.where("other is null").select("key", "id", "n", "kind")
    salted = heads.where("head").select("key", F.lit(0).alias("salt"), "id", "n", "kind")
    again = mapped(salted.repartition("key").sortWithinPartitions("key", "id"), _heads(least), made, rows=20_000).where("other is not null")
    pairs = heads.where("other is not null").select("id", "other").unionByName(again.select("id", "other"))
    signs = entries.select("id", "n", "sign")

    def allowed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(signs.toDF("a", "na", "sa"), "a").join(signs.toDF("b", "nb", "sb"), "b")
        return cut(mapped(both.select("a", "b", "na", "nb", "sa", "sb"), _allowed(least), "a long, b long"), "allowed")

    def judged(pairs: DataFrame, whole: DataFrame) -> DataFrame:
        both = pairs.join(whole.toDF("a", "ta"), "a").join(whole.toDF("b", "tb"), "b")
        return mapped(both.select("a", "b", "ta", "tb"), _judge(words, least), "a long, b long")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def fetched(ids: DataFrame) -> DataFrame:
        ids = cut(ids, "ids")
        return cut(texts.where(may_hold(ids)("id")).join(ids, "id", "left_semi"), "texts")

    first = allowed(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
    whole = fetched(ends(first))
    found = cut(judged(first, whole), "links")
    comps = components(found).withColumnRenamed("component", "comp")
    some = cut(met.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "open")
    open_ = cut(_sized(some).where("rows > 2"), "split")
    few = open_.where(F.col("rows") <= LIST).select("key", "id", "n", "kind", "comp")
    across = few.join(few.toDF("key", "other", "n2", "kind2", "comp2"), "key").where(f"id < other and comp <> comp2 and not (kind = {LIGHT} and kind2 = {LIGHT})")
    across = across.where(F.least("n", "n2") * 100 >= F.greatest("n", "n2") * least).select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    second = allowed(across.join(first, ["a", "b"], "left_anti"))
    dealt = cut(_dealt(_pooled(open_)), "dealt")
    rest = fetched(ends(second).unionByName(dealt.select("id")).distinct())
    units = dealt.join(rest, "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    unit = F.concat_ws(" ", "key", "i", "j").alias("unit")
    return found.unionByName(judged(second, rest)).unionByName(mapped(units.select(unit, "id", "comp", "minor", "text"), _units(words, least), "a long, b long"))


def _sized(rows: DataFrame) -> DataFrame:
    """rows (key, id, comp, ...) with their key's rows, major component, its rows (most), its first id, and the rows that its units would have (cost);
    keys with one component fall out."""
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    split = parts.groupBy("key").agg(F.count("*").alias("comps"), F.sum("size").alias("rows"), F.max_by("comp", F.struct("size", "comp")).alias("major"), F.max("size").alias("most"), F.min("first").alias("first")).where("comps > 1").drop("comps")
    minor, mine, theirs = F.col("rows") - F.col("most"), F.ceil((F.col("rows") - F.col("most")) / BLOCK), F.ceil(F.col("most") / BLOCK)
    return rows.join(split.withColumn("cost", minor * (mine + theirs) + F.col("most") * mine), "key")


def _pooled(rows: DataFrame) -> DataFrame:
    """Rows (sized) of keys with more than LIST rows, by key or pooled. A group of near copies shares dozens of keys, under each of which its rows
    would meet again; keys that have rows in common are pooled to one where the pool's units have fewer rows than those of its keys."""
    hot = rows.where(F.col("rows") > LIST).select("key", "id", "comp", "rows", "major", "most", "first", "cost")
    found = components(hot.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct())  # the first is the same one for many keys that share their rows
    pooled = hot.join(found, "id", "left").withColumn("pool", F.coalesce("component", "id"))
    pooled = cut(pooled.select("pool", "key", "id", "comp", "cost"), "pools")
    once = cut(_sized(pooled.select(F.col("pool").alias("key"), "id", "comp").distinct()), "pooled")
    each = pooled.groupBy("pool", "key").agg(F.first("cost").alias("cost")).groupBy("pool").agg(F.sum("cost").alias("by_key"))
    better = each.join(once.groupBy(F.col("key").alias("pool")).agg(F.first("cost").alias("cost")), "pool").where("cost <= by_key").select("pool")
    kept = hot.join(pooled.select("pool", "key", "id").join(better, "pool", "left_anti").select("key", "id"), ["key", "id"], "left_semi")
    return kept.unionByName(once.join(better.withColumnRenamed("pool", "key"), "key", "left_semi"))


def _dealt(rows: DataFrame) -> DataFrame:
    """key, i, j, id, comp, minor of keys' rows: each block of minor rows (i) with every block (j; major ones below 0)."""
    minor = F.col("comp") != F.col("major")
    blocks = lambda n: F.ceil(n / BLOCK)
    many = rows.select("key", "id", "comp", minor.alias("minor"), blocks(F.col("rows") - F.col("most")).alias("mine"), blocks(F.col("most")).alias("theirs"))
    at = F.pmod(F.xxhash64("id", F.lit(_SEED)), F.when(F.col("minor"), F.col("mine")).otherwise(F.col("theirs")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    unit = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    own = F.transform(upto("mine"), lambda j: unit(F.least(j, F.col("at")), F.greatest(j, F.col("at"))))
    to_major = F.transform(upto("theirs"), lambda j: unit(F.col("at"), -j - 1))
    from_major = F.transform(upto("mine"), lambda i: unit(i, -F.col("at") - 1))
    dealt = many.withColumn("at", at).select("key", "id", "comp", "minor", F.explode(F.when(F.col("minor"), F.concat(own, to_major)).otherwise(from_major)).alias("u"))
    return dealt.select("key", "u.i", "u.j", "id", "comp", "minor")


def near_duplicates(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    with batch_bytes(docs.sparkSession):  # all that runs Python runs in here
        return _near_duplicates(docs, words, least)


def _near_duplicates(docs: DataFrame, words: int, least: int) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    first = cut(mapped(rows, _first(words), "row long, doc_id long, n long, digest binary, chunk int, counts binary", rows=TEXTS), "shingled")
    ranks = np.zeros(SLOTS, np.uint8)
    summed = mapped(first.where("chunk is not null").select("chunk", "counts").repartition("chunk"), _ranks, "chunk int, ranks binary", rows=64)
    for r in summed.collect():  # SLOTS bytes, whatever the input
        ranks[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.ranks, np.uint8)
    mean = (first.agg(F.sum("n")).first()[0] or 0) / SLOTS
    held = np.maximum(0, 2 ** (np.arange(256) / 4) - mean - 3 * mean**0.5)  # rows of a shingle beyond what its slot holds by chance
    each = first.where("chunk is null").select("row", "doc_id", "n", "digest")
    distinct = cut(each.where("n > 0").groupBy("digest").agg(F.min("row").alias("id"), F.min("doc_id").alias("least_id")), "distinct-sets")
    prefixes = mapped(rows.select("row", "text"), _prefixes(words, least, ranks, held / 2), "row long, n int, prefix array<long>, sign binary, cost double", rows=TEXTS)
    entries = cut(prefixes.withColumnRenamed("row", "id").join(distinct.select("id"), "id", "left_semi"), "entries")
    sizes = entries.where(F.col("n") <= LIGHTEST).groupBy("n").agg(F.count("*"), F.sum("cost")).collect()  # at most LIGHTEST rows
    light = boundary([tuple(r) for r in sizes], least)
    spanning = links(entries, rows.select(F.col("row").alias("id"), "text"), light, ranks, np.minimum(held, 2.0**62).astype(np.int64), words, least)
    grouped = components(spanning)
    named = distinct.join(grouped, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_set = named.join(smallest, "component").select("digest", "component_id")
    out = each.join(of_set, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
