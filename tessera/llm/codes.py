"""Codes of vectors by product quantization, with codebooks from Lloyd rounds that move only what changed.

1. Components become integers floor(1024 x); a vector is cut into PARTS equal consecutive parts.
2. A part position's codebook starts as that part of the ENTRIES smallest kept vec_ids.
3. The state is a written table: a vector with the entries of its parts, now and one round before. A round assigns all parts against the
   codebooks and writes the state anew.
4. Running integer sums and counts of each entry stay from round to round. Only parts whose assignment changed contribute, plus to the new
   entry and minus to the old one; they are added up inside a task first, so a task ships at most a row for each entry. Sums are exact
   integers, so what the deltas give is what a full recount would.
5. Entries become the floor of sum over count; unused ones stay. After the rounds parts are assigned once more.

Dropped: null vectors, vectors with a null, NaN or infinite component, and vectors of another length than the smallest kept vec_id's.
Repeated and null vec_ids are coded each by itself (null ones come last in order; equal ones are ordered by their components). A length
that PARTS doesn't divide is cut as evenly as can be. Fewer vectors than ENTRIES: as many entries. Integers of any size are exact; an error
beyond the range of long is null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, mapped

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Float64 holds integers below this exactly.
EXACT = 1 << 53

Books = list[np.ndarray]  # for each part position: entries x width, whole numbers


def integers(vectors: pa.Array, d: int) -> np.ndarray:
    """Rows of floor(SCALE x): float64 where that is exact in all that follows, else Python integers."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    if not x.size or np.abs(x).max() * SCALE < 1 << 40:
        return np.floor(x * SCALE)
    scaled = lambda v: int(v) * SCALE if abs(v) >= EXACT else int(np.floor(v * SCALE))
    return np.array([[scaled(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def cuts(d: int) -> list[slice]:
    return [slice(i * d // PARTS, (i + 1) * d // PARTS) for i in range(PARTS)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (ties: the lower index) and the squared distance of each row."""
    most = max((int(np.abs(a).max()) if a.size else 0) for a in (x, book))
    if x.shape[1] * (2 * most) ** 2 < EXACT and x.dtype != object and book.dtype != object:
        far = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
        at = far.argmin(1)
        return at, far[np.arange(len(x)), at]
    x, book = np.vectorize(int, otypes=[object])(x) if x.size else x, np.vectorize(int, otypes=[object])(book) if book.size else book
    at, least = np.empty(len(x), np.int64), np.empty(len(x), object)
    for i, row in enumerate(x):
        far = ((book - row) ** 2).sum(1) if x.shape[1] else np.zeros(len(book), object)
        at[i] = far.argmin()
        least[i] = int(far[at[i]])
    return at, least


def _assign(books: Books, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column("v"), d)
            now = [nearest(x[:, s], book) for s, book in zip(cuts(d), books, strict=True)]
            errors = [sum(int(e[i]) for _, e in now) for i in range(len(x))]
            codes = np.stack([at for at, _ in now], 1).astype(np.uint8)
            done = pa.array([c.tobytes() for c in codes], pa.binary())
            error = pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), done, b.column("now"), error], names=["vec_id", "label", "v", "now", "before", "error"])

    return run


def _deltas(d: int):
    """part, entry, n, sums: what a task's changed parts add to and take from each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            x = integers(b.column("v"), d)
            now = np.frombuffer(b"".join(b.column("now").to_pylist()), np.uint8).reshape(-1, PARTS)
            old = b.column("before").to_pylist()
            fresh = np.array([o is None for o in old], bool)
            before = np.frombuffer(b"".join(o or bytes(PARTS) for o in old), np.uint8).reshape(-1, PARTS)
            for p, s in enumerate(cuts(d)):
                changed = np.flatnonzero(fresh | (now[:, p] != before[:, p]))
                for sign, codes, rows in ((1, now, changed), (-1, before, changed[~fresh[changed]])):
                    if not len(rows):
                        continue
                    order = rows[np.argsort(codes[rows, p], kind="stable")]
                    entries, first = np.unique(codes[order, p], return_index=True)
                    for e, part in zip(entries.tolist(), np.split(x[order, s], first[1:]), strict=True):
                        have = total.setdefault((p, e), [0, [0] * (s.stop - s.start)])
                        have[0] += sign * len(part)
                        have[1] = [a + sign * int(c) for a, c in zip(have[1], part.sum(0), strict=True)]
        keys = list(total)
        sums = pa.array([[str(v) for v in total[k][1]] for k in keys], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()), sums], names=["part", "entry", "n", "sums"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], list] = {}
    for b in batches:
        for p, e, n, sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
            have = total.setdefault((p, e), [0, [0] * len(sums)])
            have[0] += n
            have[1] = [a + int(v) for a, v in zip(have[1], sums, strict=True)]
    keys = list(total)
    sums = pa.array([[str(v) for v in total[k][1]] for k in keys], pa.list_(pa.string()))
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()), sums], names=["part", "entry", "n", "sums"])


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v of the vectors without null, NaN and infinite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", bad)).select("vec_id", "label", F.col("embedding").alias("v"))


def _book(rows: list[list[int]]) -> np.ndarray:
    """Float64 where exact, else Python integers."""
    small = all(abs(v) < 1 << 40 for r in rows for v in r)
    return np.array(rows, np.float64 if small else object).reshape(len(rows), -1)


def encode(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, Books]:
    """The state after the last assignment (vec_id, label, now: the code of each part in a byte, error) and the codebooks."""
    spark = vectors.sparkSession
    rows = kept(vectors)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()  # at most `entries` rows
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, v {rows.schema['v'].dataType.simpleString()}, now binary, before binary, error long"
    if not seeds:
        return spark.createDataFrame([], schema), [np.empty((0, 0))] * PARTS
    d = len(seeds[0].v)
    start = integers(pa.array([r.v for r in seeds if len(r.v) == d], pa.list_(pa.float64())), d)
    if any(len(r.v) != d for r in seeds):
        seeds = rows.where(F.size("v") == d).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
        start = integers(pa.array([r.v for r in seeds], pa.list_(pa.float64())), d)
    books = [_book([[int(v) for v in r] for r in start[:, s]]) for s in cuts(d)]
    sums: dict[tuple[int, int], list] = {}
    state = rows.where(F.size("v") == d).withColumn("now", F.lit(None).cast("binary"))
    old = None
    for _ in range(rounds):
        state = cut(mapped(state.select("vec_id", "label", "v", "now"), _assign(books, d), schema), "assigned")
        if old is not None:
            discard(old)
        old = state
        changed = state.where("before is null or now <> before").select("v", "now", "before")
        deltas = mapped(changed, _deltas(d), "part int, entry int, n long, sums array<string>")
        moved = deltas.repartition("part", "entry").mapInArrow(_merged, deltas.schema).collect()  # at most PARTS * ENTRIES rows
        for r in moved:
            have = sums.setdefault((r.part, r.entry), [0, [0] * len(r.sums)])
            sums[r.part, r.entry] = [have[0] + r.n, [a + int(v) for a, v in zip(have[1], r.sums, strict=True)]]
        books = [_book([[v // sums[p, e][0] for v in sums[p, e][1]] if sums.get((p, e), [0])[0] else [int(v) for v in book[e]] for e in range(len(book))]) for p, book in enumerate(books)]
    return mapped(state.select("vec_id", "label", "v", "now"), _assign(books, d), schema), books


def digest(books: Books) -> str:
    """sha256 of all entries' integer components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for row in book for v in row).encode()).hexdigest()


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept vector."""
    state, books = encode(vectors, rounds, entries)
    coded = cut(state.select("vec_id", "label", F.lower(F.hex("now")).alias("code"), "error"), "coded")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", F.expr("try_cast(sum as long)").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
