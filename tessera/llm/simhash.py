"""SimHash near-duplicates: 64-bit fingerprints, linked by bit-sliced comparison, grouped by connected components.

1. Fingerprints: lower-case A-Z, words, 4-word shingles with repeats; bit set if set in over half of the XXH64 hashes.
2. Equal fingerprints collapse to one row (smallest doc_id) before anything is compared.
3. Candidates: the 64 bits are cut into m blocks. Two fingerprints within r bits agree exactly on at least m - r blocks, so
   a table for each choice of m - r blocks loses no link. m follows the number of fingerprints (`blocks_for`), so that
   a table's key has about as many values as there are rows, at any size.
4. Inside a key, fingerprints are compared bit-sliced: 64 bit planes, one bit a lane, 64 lanes a word. Differences are added
   with carry-save counters, and words (blocks of lanes) leave once all their lanes exceed the radius.
   Runs of up to RUN rows compare at offsets 1, 2, ...; longer ones (a hot key) grow one component at a time, comparing its
   frontier with what is still unreached only, so a large group of near copies costs about one pass; runs beyond SPLIT fall
   apart by parts of their bits first. Only links that span the components found are emitted.
5. Components by alternating large-star and small-star rounds over the links, until nothing changes.

Null or empty text, or no words: fingerprint zero, linked like any other. Rows with a null doc_id form no component
(component_id null). Repeated doc_ids: one row each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, discard, mapped, shuffle_partitions

WORDS, RADIUS, SEED = 4, 4, 42
#: Longest run that compares at offsets, and the run from which on one is split by parts of its bits.
RUN, SPLIT = 48, 4096
FRONTIER = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], SEED) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    n = len(hashes)
    count = np.zeros(64, np.int64)
    every = np.array(hashes, "<u8")
    for i in range(0, n, 1 << 16):
        count += np.unpackbits(every[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), *batch.columns[2:]], names=["doc_id", "print", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, print (the fingerprint's bits as a signed long), the long columns in carry."""
    schema = ", ".join(("doc_id long, print long", *(f"{c} long" for c in carry)))
    return mapped(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *carry), _fingerprints, schema)


def blocks_for(rows: int, radius: int = RADIUS) -> int:
    """Number of blocks m: the fewest (so the fewest tables) whose keys have at least a quarter as many values as there are rows."""
    m = radius + 1
    while m < radius + 5 and 2 ** (64 * (m - radius) // m) < rows / 4:
        m += 1
    return m


def keys_of(m: int, radius: int = RADIUS) -> list[int]:
    """A mask for each choice of m - radius of m blocks."""
    edge = [64 * i // m for i in range(m + 1)]
    mask = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(m)]
    return [sum(mask[i] for i in chosen) for chosen in combinations(range(m), m - radius)]


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of prints: (64, words), lane i of word w is print 64 * w + i."""
    n = -(-len(prints) // 64) * 64
    padded = np.zeros(n, "<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(left: np.ndarray, right: np.ndarray, over: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lanes (as words) whose left and right planes differ in at most radius bits, of those not set in over.

    left, right: (64, words). The counters are carry-save: bit planes of each lane's distance; a carry out of what is above the
    radius sets over for good. After every 8 planes, the words of which all lanes are over leave.
    """
    out = np.zeros(over.shape, "<u8")
    size = max(1, (radius + 1).bit_length())
    at = np.flatnonzero(over != FULL)
    if not len(at):
        return out
    left, right, over = left[:, at], right[:, at], over[at]
    count = [np.zeros(len(at), "<u8") for _ in range(size)]
    for i in range(64):
        carry = left[i] ^ right[i]
        for k in range(size):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over = over | carry
        if i % 8 == 7:
            above = np.zeros(len(at), "<u8")  # lanes whose count is over the radius
            equal = np.full(len(at), FULL)
            for k in reversed(range(size)):
                if radius >> k & 1:
                    equal &= count[k]
                else:
                    above |= equal & count[k]
                    equal &= ~count[k]
            over = over | above
            stay = over != FULL
            if not stay.any():
                return out
            if stay.mean() < 0.7:
                at, over, left, right = at[stay], over[stay], left[:, stay], right[:, stay]
                count = [c[stay] for c in count]
    out[at] = ~over
    return out


def lanes(words: np.ndarray) -> np.ndarray:
    """Numbers of the set lanes."""
    return np.flatnonzero(np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little"))


def _grow(prints: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of one long run: grows a component at a time, its frontier against what is not yet reached."""
    links, rest = [], np.arange(len(prints))
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        sliced = planes(prints[rest])
        while len(frontier) and len(rest):
            now, frontier = frontier[:FRONTIER], frontier[FRONTIER:]
            words = sliced.shape[1]
            pad = np.zeros(words * 64, np.uint8)
            pad[len(rest) :] = 1
            over = np.tile(np.packbits(pad, bitorder="little").view("<u8"), len(now))
            bits = np.unpackbits(prints[now].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            left = np.repeat(np.where(bits.T, FULL, np.uint64(0)), words, axis=1)
            hit = within(left, np.tile(sliced, (1, len(now))), over, radius).reshape(len(now), words)
            who, word = np.nonzero(hit)
            if not len(who):
                continue
            which = np.unpackbits(np.ascontiguousarray(hit[who, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(which)
            far, first = np.unique(word[k] * 64 + lane, return_index=True)
            links.append((now[who[k][first]], rest[far]))
            frontier = np.concatenate((frontier, rest[far]))
            rest = np.delete(rest, far)
            sliced = planes(prints[rest]) if len(rest) else sliced
    return links


def _split(prints: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of a very long run: prints within radius bits agree on one of radius + 1 parts of the bits that vary in the
    run, so the run falls apart by each part in turn, and what is unrelated is hardly ever compared. What is still very long falls
    apart again, by the bits that vary in it; these get fewer each time."""
    differ = np.bitwise_or.reduce(prints ^ prints[0])
    bits = [1 << i for i in range(64) if int(differ) >> i & 1]
    if len(bits) <= radius:
        return [(np.zeros(len(prints) - 1, np.int64), np.arange(1, len(prints)))]
    links = []
    for i in range(radius + 1):
        key = prints & np.uint64(sum(bits[i :: radius + 1]))
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True])))
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if e - s > 1:
                own = order[s:e]
                links += [(own[a], own[b]) for a, b in (_split if e - s > SPLIT else _grow)(prints[own], radius)]
    return links


def link_sorted(keys: np.ndarray, prints: np.ndarray, ids: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, id) among rows of the same key; keys are sorted."""
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    length = np.diff(np.concatenate((start, [len(keys)])))
    short = np.repeat((length > 1) & (length <= RUN), length)
    left, right = [], []
    for s, n in zip(start[length > RUN], length[length > RUN], strict=True):
        for a, b in _split(prints[s : s + n], radius) if n > SPLIT else _grow(prints[s : s + n], radius):
            left.append(ids[s + a])
            right.append(ids[s + b])
    k, p, x = keys[short], prints[short], ids[short]
    for d in range(1, int(length[length <= RUN].max(initial=1))):
        if len(k) <= d:
            break
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        a, b = same, same + d
        over = np.zeros(-(-len(a) // 64) * 64, np.uint8)
        over[len(a) :] = 1
        hit = lanes(within(planes(p[a]), planes(p[b]), np.packbits(over, bitorder="little").view("<u8"), radius))
        left.append(x[a[hit]])
        right.append(x[b[hit]])
    if not left:
        return ids[:0], ids[:0]
    return np.concatenate(left), np.concatenate(right)


def _linker(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> pa.RecordBatch:
            a, b = link_sorted(rows[:, 0], rows[:, 1].view(np.uint64), rows[:, 2], radius)
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:  # rows of a key are adjacent, so all before the last key are complete
            rows = np.stack([c.to_numpy() for c in batch.columns], 1)
            last = rows[-1, 0]
            if sum(map(len, held)) + len(rows) < 200_000 or rows[0, 0] == last:  # too few, or all of one key: nothing is put together yet
                held.append(rows)
                continue
            end = int(np.searchsorted(rows[:, 0], last))
            yield out(np.asfortranarray(np.concatenate([*held, rows[:end]])))
            held = [rows[end:]]
        if held and sum(map(len, held)):
            yield out(np.asfortranarray(np.concatenate(held)))

    return run


def links(prints: DataFrame, rows: int, radius: int = RADIUS) -> DataFrame:
    """a, b: ids of distinct prints (columns id, print) within radius bits; every component is spanned."""
    spark = prints.sparkSession
    masks = keys_of(blocks_for(rows, radius), radius)
    keyed = prints.select(F.posexplode(F.array([F.col("print").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])), "print", "id")
    keyed = keyed.select(F.xxhash64("pos", "col").alias("key"), "print", "id")
    n = shuffle_partitions(spark)
    sorted_ = keyed.repartition(n, "key").sortWithinPartitions("key")
    return mapped(sorted_, _linker(radius), "a long, b long", rows=10_000).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for each id of edges (a, b). Large-star then small-star, until stable."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        old, now = now, cut(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "links")
        discard(old)
        before, after = mark(now), before
        if after == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, print, component_id, the long columns in carry for each document."""
    each = cut(fingerprints(docs, id_col, text_col, carry), "prints")
    distinct = cut(each.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("id")), "distinct-prints")
    grouped = components(links(distinct, distinct.count(), radius))
    named = distinct.join(grouped, "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    out = each.join(named, "print", "left")
    return out.select("doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), *carry)


def hex_print(column: str = "print"):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
