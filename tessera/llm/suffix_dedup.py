"""Removal of byte strings that also start in an earlier document, by suffix arrays built with two-stage sorting.

Every LENGTH-byte string (window) is held against all others, without shipping all suffixes:
1. Each window has an anchor: the K-byte string inside it whose hash comes first (leftmost on ties). Equal windows have equal
   anchors. Consecutive windows with the same anchor form a segment: their bytes stay together (`segments`).
2. Anchors go to buckets by hash, packed; those that occur in one document only are settled: no other document can have
   their windows. Wrong hits of the 32 + log2(buckets) bits compared here only cost work.
3. The segments of the other anchors go to buckets by anchor. A bucket keeps equal segments once, with their smallest doc_id,
   and builds the suffix array over them: suffixes smaller than their successors are sorted directly, the rest is induced
   by scanning the buckets of first bytes in order (`suffix_array`). Adjacent suffixes with LENGTH common bytes are equal windows;
   a document loses each window that has a smaller doc_id in its group.
4. Removed ranges go back by document, where they are merged and cut out of the whole text.

The text is dealt out once, by document; steps 3 and 4 share that exchange. A bucket holds what hashing gives it: a passage that
very many documents share takes 24 bytes for each of them there, its bytes only once for each batch.

Null or empty text: zero bytes, nothing removed, the digest of no bytes. A null doc_id is neither smaller nor larger than
another: its text stays and removes nothing. Rows of the same doc_id don't remove each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, shuffle_partitions

LENGTH = 50
K = 20
#: Bytes that one pass of `segments` looks at; a longer text goes in overlapping pieces.
PIECE = 1 << 21
#: Sorting depth in bytes (whole words); at least LENGTH.
DEPTH = 56


def _words(buffer: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The number at every byte position, without a copy."""
    size = np.dtype(kind).itemsize
    return np.ndarray((max(0, len(buffer) - size + 1),), kind, buffer, strides=(1,))


def segments(buffer: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, and anchor hash, of each segment of a concatenation; ends: where each text ends."""
    n = len(buffer)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    at = n - k + 1
    h = _words(buffer)[:at] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += _words(buffer)[8 : 8 + at]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += _words(buffer, "<u4")[16 : 16 + at]
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    first = (h * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(0xFFFFFFFF00000000)
    first |= np.arange(at, dtype=np.uint64)
    wide, span = length - k + 1, 1
    while span * 2 <= wide:  # the smallest of each run of `span` positions
        first = np.minimum(first[:-span], first[span:])
        span *= 2
    if span < wide:
        first = np.minimum(first[: len(first) - (wide - span)], first[wide - span :])
    anchor = (first & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.ones(n - length + 1, bool)
    for end in ends[:-1]:
        valid[max(0, end - length + 1) : end] = False
    change = np.empty(len(anchor), bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(change)
    last = np.concatenate((start[1:], [len(anchor)])) - 1
    keep = valid[start]
    start, last = start[keep], last[keep]
    return start, last, h[anchor[start]]


def pieces(texts: list[bytes], length: int = LENGTH, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts as (buffer, ends, number of the text, offset in the text); long texts in pieces that share length - 1 bytes."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text) - length + 1), piece):
            part = text[a : a + piece + length - 1]
            if len(part) < length:
                continue
            if size and size + len(part) > piece + length:
                yield _joined(group)
                group, size = [], 0
            group.append((part, i, a))
            size += len(part)
    if group:
        yield _joined(group)


def _joined(group: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts, number, offset = zip(*group, strict=True)
    return np.frombuffer(b"".join(parts) + bytes(8), np.uint8)[:-8], np.cumsum([len(p) for p in parts]), np.array(number), np.array(offset)


def _segments_of(texts: list[bytes]) -> Iterator[tuple]:
    """(buffer, start, last, hash, number of the text, offset of the buffer in it) for each group of pieces."""
    for buffer, ends, number, offset in pieces(texts):
        start, last, h = segments(buffer, ends)
        which = np.searchsorted(ends, start, side="right")
        shift = offset[which] - np.concatenate(([0], ends[:-1]))[which]
        yield buffer, start, last, h, number[which], shift


# ---- the suffix array


def _sort_directly(text: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions in order of their first `depth` bytes: a word at a time, only what is still tied goes on."""
    word = _words(text, ">u8")
    key = word[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    tied = np.zeros(len(at), bool)
    if len(at) > 1:
        same = key[1:] == key[:-1]
        tied[1:] = same
        tied[:-1] |= same
        group = np.cumsum(np.concatenate(([True], ~same)))
    for d in range(8, depth, 8):
        slot = np.flatnonzero(tied)
        if not len(slot):
            break
        key, g = word[at[slot] + d].astype(np.uint64), group[slot]
        order = np.lexsort((key, g))
        at[slot], key = at[slot][order], key[order]
        same = (key[1:] == key[:-1]) & (g[1:] == g[:-1])
        still = np.zeros(len(slot), bool)
        still[1:] = same
        still[:-1] |= same
        tied[slot] = still
        group[slot] = slot[np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(slot)), 0))] + len(at)
    return at


def suffix_array(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted positions (a mask) in the order of their suffixes, to at least DEPTH bytes.

    text ends with a byte smaller than its successor and DEPTH + 8 more bytes (`padded`), so that every chain of suffixes larger
    than their successors ends inside it.
    """
    n = len(wanted)
    smaller = text[: n + 1] < text[1 : n + 2]
    level = text[: n + 1] == text[1 : n + 2]
    # a suffix that starts with equal bytes is smaller than its successor if the first differing byte makes it so
    nxt = np.where(level, n, np.arange(n + 1))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    small = smaller[nxt]
    small[n] = True
    active = np.zeros(n + 1, bool)
    active[:n] = wanted
    # a larger suffix needs its successor in the order: go on from the wanted ones to the next smaller suffix
    reach = np.where(active, np.arange(n + 1), -1)
    reach = np.maximum.accumulate(reach)
    stop = np.where(small, np.arange(n + 1), -1)
    stop = np.maximum.accumulate(stop)  # last smaller suffix at or before
    before = np.concatenate(([-1], stop[:-1]))
    active |= (reach >= 0) & (before < reach)
    directly = _sort_directly(text, np.flatnonzero(active & small))
    induced = active & ~small
    bounds = np.searchsorted(text[directly], np.arange(257))
    lists: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        layers = lists[c]
        now = np.concatenate(layers) if layers else np.empty(0, np.int64)
        found = [now]
        while len(now):
            now = now[now > 0] - 1
            now = now[induced[now] & (text[now] == c)]
            found.append(now)
        bucket = np.concatenate((*found, directly[bounds[c] : bounds[c + 1]]))
        lists[c] = []
        out.append(bucket)
        before_it = bucket[bucket > 0] - 1
        before_it = before_it[induced[before_it]]
        first = text[before_it]
        larger = first > c
        before_it, first = before_it[larger], first[larger]
        order = np.argsort(first, kind="stable")
        before_it, first = before_it[order], first[order]
        for a, b in _runs(first):
            lists[first[a]].append(before_it[a:b])
    every = np.concatenate(out)
    every = every[every < n]
    return every[wanted[every]]


def padded(text: bytes) -> np.ndarray:
    return np.frombuffer(text + b"\x00\xff" + bytes(DEPTH + 16), np.uint8)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common bytes of each suffix of order with the one before it, up to `most`; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    word = _words(text, ">u8")
    left = np.arange(1, len(order))
    for d in range(0, most, 8):
        if not len(left):
            break
        differ = word[order[left] + d].astype(np.uint64) ^ word[order[left - 1] + d].astype(np.uint64)
        equal = np.full(len(left), 8)
        for b in range(8):  # bytes before the first differing one
            equal[(differ >> np.uint64(8 * b)) & np.uint64(0xFF) != 0] = 7 - b
        out[left] += equal
        left = left[equal == 8]
    return np.minimum(out, most)


def smallest_owner(parts: list[bytes], owner: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each part, in order: the smallest owner of a part with that window. Also each part's first window."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    text = padded(b"".join(parts))
    windows = sizes - length + 1
    first = np.concatenate(([0], np.cumsum(windows)))
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    total = int(sizes.sum())
    which = np.repeat(np.arange(len(parts)), windows)
    at = np.arange(first[-1]) - first[which] + begin[which]
    wanted = np.zeros(total, bool)
    wanted[at] = True
    order = suffix_array(text, wanted)
    fresh = common_prefixes(text, order, length) < length
    number = np.full(total, -1)
    number[at] = np.arange(len(at))
    window = number[order]
    group = np.flatnonzero(fresh)
    least = np.minimum.reduceat(owner[which[window]], group) if len(group) else owner[:0]
    out = np.empty(len(at), np.int64)
    out[window] = np.repeat(least, np.diff(np.concatenate((group, [len(order)]))))
    return out, first


# ---- the stages


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    if not len(values):
        return []
    edge = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *edge.tolist()], [*edge.tolist(), len(values)], strict=True))


def _split_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    for a, b in _runs(sorted_):
        yield int(sorted_[a]), order[a:b]


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            docs, hashes = [], []
            for _, _, _, h, number, _ in _segments_of(_texts(batch.column("text"))):
                order = np.lexsort((h, number))
                h, number = h[order], number[order]
                once = np.concatenate(([True], (h[1:] != h[:-1]) | (number[1:] != number[:-1]))) if len(h) else np.empty(0, bool)
                docs.append(number[once])
                hashes.append(h[once])
            if not docs:
                continue
            doc, h = np.concatenate(docs), np.concatenate(hashes)
            rows = []
            for b, at in _split_by(((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)):
                at = at[np.argsort(doc[at], kind="stable")]
                d, start = np.unique(doc[at], return_index=True)
                n = np.diff(np.concatenate((start, [len(at)])))
                rows.append((b, key[d].tobytes(), n.astype("<u4").tobytes(), h[at].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "keys", "counts", "hashes"])

    return run


#: Packed values for many row keys on their way to the partition (route) of those keys.
PACKED = "route int, high int, keys binary, counts binary, data binary"


def _routed(keys: np.ndarray, counts: np.ndarray, data: np.ndarray, routes: int, high: int = 0) -> Iterator[pa.RecordBatch]:
    """One packed row for each route; data holds counts[i] words of 32 bits for keys[i], one after the other; high: the upper half of all."""
    if not len(keys):
        return
    start = np.cumsum(counts) - counts
    rows = []
    for r, at in _split_by(keys % routes):
        n = counts[at]
        words = np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        rows.append((r, high, keys[at].tobytes(), n.astype("<u4").tobytes(), data[words].astype("<u4").tobytes()))
    types = (pa.int32(), pa.int32(), *[pa.binary()] * 3)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["route", "high", "keys", "counts", "data"])


def _regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key of the partition with all its words."""
    keys, counts, data = [], [], []
    for batch in batches:
        for to, column, kind in ((keys, "keys", "<i8"), (counts, "counts", "<u4")):
            to.extend(np.frombuffer(x, kind) for x in batch.column(column).to_pylist())
        for high, x in zip(batch.column("high").to_pylist(), batch.column("data").to_pylist(), strict=True):
            data.append(np.frombuffer(x, "<u4").astype(np.int64) | high << 32)
    if not keys:
        return
    k, n, words = np.concatenate(keys), np.concatenate(counts).astype(np.int64), np.concatenate(data)
    del keys, counts, data
    words = words[np.argsort(np.repeat(k, n), kind="stable")]
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    k, n = k[edge], np.add.reduceat(n, edge)
    end = np.cumsum(n)
    for a in range(0, len(k), 2000):
        blobs = [words[e - m : e].tobytes() for e, m in zip(end[a : a + 2000].tolist(), n[a : a + 2000].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 2000]), pa.array(blobs, pa.binary())], names=["key", "data"])


def _shared(routes: int):
    """Of one partition's buckets, the anchors that occur in two rows or more, back towards those rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, keys, count, h in _anchor_buckets(batches):
            order = np.sort(h)
            twice = np.unique(order[1:][order[1:] == order[:-1]])
            if not len(twice):
                continue
            hit = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
            owners, n = np.unique(np.repeat(np.arange(len(keys)), count)[hit], return_counts=True)
            yield from _routed(keys[owners], n, h[hit], routes, bucket)

    return run


def _anchor_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Each bucket of the partition: number, row keys, anchors of each, anchor hashes."""
    rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    rows.sort(key=lambda r: r[0])
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        bucket = rows[i][0]
        keys = np.frombuffer(b"".join(r[1] for r in rows[i:j]), "<i8")
        count = np.frombuffer(b"".join(r[2] for r in rows[i:j]), "<u4").astype(np.int64)
        h = np.frombuffer(b"".join(r[3] for r in rows[i:j]), "<u4")
        rows[i:j] = [(bucket,)] * (j - i)  # lets go of the bytes
        i = j
        yield bucket, keys, count, h


def _cutter(anchor_buckets: int, buckets: int, length: int = LENGTH):
    """Segments whose anchor is shared, packed by bucket; a bucket's equal segments of a batch come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
            known = [np.sort(np.frombuffer(x, "<u8")) for x in batch.column("data").to_pylist()]
            packed: dict[int, list] = {}
            for buffer, start, last, h, number, shift in _segments_of(_texts(batch.column("text"))):
                mine = h & np.uint64(0xFFFFFFFF) | (h >> np.uint64(32)) % np.uint64(anchor_buckets) << np.uint64(32)
                hit = np.zeros(len(h), bool)
                for a, b in _runs(number):
                    k = known[number[a]]
                    hit[a:b] = k[np.minimum(np.searchsorted(k, mine[a:b]), len(k) - 1)] == mine[a:b]
                at = np.flatnonzero(hit)
                raw = buffer.tobytes()
                for b, sel in _split_by((h[at] % np.uint64(buckets)).astype(np.int64)):
                    own = packed.setdefault(b, [{}, [], [], [], []])
                    seen = own[0]
                    s, e, i = start[at[sel]], last[at[sel]] + length, number[at[sel]]
                    own[1].extend([seen.setdefault(raw[x:y], len(seen)) for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                    own[2].append(key[i])
                    own[3].append(doc[i])
                    own[4].append(s + shift[at[sel]])
            rows, z = [], zstandard.ZstdCompressor(level=1)
            for b, (seen, part, keys, docs, places) in packed.items():
                sizes = np.fromiter(map(len, seen), "<u4", len(seen))
                rows.append((b, *map(z.compress, (b"".join(seen), sizes.tobytes(), np.array(part, "<u4").tobytes(), np.concatenate(keys).tobytes(), np.concatenate(docs).tobytes(), np.concatenate(places).astype("<u4").tobytes()))))
            if rows:
                types = (pa.int32(), *[pa.binary()] * 6)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "text", "sizes", "part", "keys", "docs", "places"])

    return run


def _removed(routes: int):
    """Of one partition's segments, the ranges that a smaller doc_id has too, back towards the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, ranges in _ranges(batches):
            yield from _routed(keys, n, ranges, routes)

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row keys, words for each, and lower and upper half of doc_id, start, end of each removed range."""
    held: dict[int, list] = {}
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            r = (packed[0], *map(z.decompress, packed[1:]))
            seen, part, keys, docs, places = held.setdefault(r[0], [{}, [], [], [], []])
            sizes = np.frombuffer(r[2], "<u4").tolist()
            own, at = [], 0
            for n in sizes:
                own.append(seen.setdefault(r[1][at : at + n], len(seen)))
                at += n
            part.append(np.array(own)[np.frombuffer(r[3], "<u4")])
            keys.append(np.frombuffer(r[4], "<i8"))
            docs.append(np.frombuffer(r[5], "<i8"))
            places.append(np.frombuffer(r[6], "<u4").astype(np.int64))
    while held:
        _, (seen, part, keys, docs, places) = held.popitem()
        part, keys, docs, places = map(np.concatenate, (part, keys, docs, places))
        owner = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(owner, part, docs)
        least, first = smallest_owner(list(seen), owner)
        del seen
        counts = np.diff(first)[part]
        for a, b in _spans_of_rows(counts):
            n = counts[a:b]
            row = np.repeat(np.arange(a, b), n)
            window = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            hit = least[first[part[row]] + window] < docs[row]
            row, place = row[hit], (places[row] + window)[hit]
            if not len(row):
                continue
            order = np.lexsort((place, docs[row], keys[row]))
            k, d, place = keys[row][order], docs[row][order], place[order]
            cutp = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (place[1:] > place[:-1] + LENGTH)))
            s = np.flatnonzero(cutp)
            e = np.concatenate((s[1:], [len(k)])) - 1
            own = d[s].view(np.uint64)
            ranges = np.stack((own & np.uint64(0xFFFFFFFF), own >> np.uint64(32), place[s].astype(np.uint64), (place[e] + LENGTH).astype(np.uint64)), 1).ravel()
            keys_of, n = np.unique(k[s], return_counts=True)  # k is sorted
            yield keys_of, 4 * n, ranges


def _spans_of_rows(counts: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` windows in all."""
    total = np.cumsum(counts)
    a = 0
    while a < len(counts):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right"))
        b = max(b, a + 1)
        yield a, b
        a = b


def merged(ranges: bytes | None, doc_id: int | None) -> np.ndarray:
    """Maximal removed runs of that doc_id as rows (start, end)."""
    if not ranges or doc_id is None:
        return np.empty((0, 2), np.int64)
    r = np.frombuffer(ranges, "<i8").reshape(-1, 4)
    r = r[(r[:, 0] | r[:, 1] << 32) == doc_id, 2:]
    if not len(r):
        return r
    r = r[np.argsort(r[:, 0], kind="stable")]
    reach = np.maximum.accumulate(r[:, 1])
    fresh = np.concatenate(([True], r[1:, 0] > reach[:-1]))
    s = np.flatnonzero(fresh)
    return np.stack((r[s, 0], reach[np.concatenate((s[1:], [len(r)])) - 1]), 1)


def _kept(text: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


COLUMNS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _finish(carry: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, doc, ranges in zip(_texts(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                runs = merged(ranges, doc)
                kept = _kept(text, runs)
                # a range may end inside a character, of which the rest then goes too
                rows.append((len(text), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            new = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(f"c_{i}") for i in range(len(carry))), *new], names=["doc_id", *carry, *(x.split()[0] for x in COLUMNS.split(", "))])

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """doc_id, the columns in carry, n_bytes, n_removed, n_spans, kept_sha256 and (with_text) the kept text, for each row.

    key: where a row's ranges come back to, by default a hash of doc_id and text. Ranges carry their doc_id, so rows of different
    doc_ids may share a key; rows of one doc_id that share one must have the same text.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    anchor_buckets, buckets = max(8, n // 3), 2 * n
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"), *(docs[c].alias(f"c_{i}") for i, c in enumerate(carry)))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text") if key is None else key)
    dealt = rows.repartition(n, "key")
    anchors = mapped(rows.where("doc_id is not null").select("key", "text"), _anchors(anchor_buckets), "bucket int, keys binary, counts binary, hashes binary")
    shared = mapped(anchors.repartition(anchor_buckets, "bucket"), _shared(n), PACKED)
    shared = mapped(shared.repartition(n, "route"), _regrouped, "key long, data binary")
    found = mapped(dealt.join(shared.hint("shuffle_merge"), "key"), _cutter(anchor_buckets, buckets), "bucket int, text binary, sizes binary, part binary, keys binary, docs binary, places binary")
    ranges = mapped(found.repartition(buckets, "bucket"), _removed(n), PACKED)
    ranges = mapped(ranges.repartition(n, "route"), _regrouped, "key long, data binary")
    schema = ", ".join(["doc_id long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), COLUMNS])
    out = mapped(dealt.join(ranges.hint("shuffle_merge"), "key", "left"), _finish(list(carry), with_text), schema)
    return out if with_text else out.drop("kept")
