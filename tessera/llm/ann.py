"""Approximate nearest neighbours: inverted lists, scanned by adaptive dimensions.

Fit (on at most SAMPLE rows, those first by hash of vec_id): k-means centres of about sqrt(n) lists and a random rotation. Every row is
indexed: it goes to its nearest centre's list, in blocks of at most BLOCK rows that keep the rotated vectors by column. A list that holds
far more rows than the mean is dealt in parts; of equal vectors there a part keeps those that some query may find (`fewer`).
A query probes its nearest lists. Within a block it reads COLUMNS rotated columns at a time; after each, a hypothesis test holds the
partial distance, scaled to all dimensions, against the distance of the worst neighbour so far, and drops candidates that are
farther with high confidence. What is left gets its distance from the original vectors in double precision.
The first bound of a query is its K-th distance within the sample, so that the first block prunes too.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, neither as query nor as
candidate. Equal distances go to the smaller vec_id. Rows with the same vec_id are candidates each; a query never finds rows of its own
vec_id. Fewer candidates than K: all of them. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, discard, mapped, shuffle_partitions

K = 10
SAMPLE, BOUND_SAMPLE, ROUNDS, SEED = 20_000, 4096, 8, 11
#: As many lists are probed as hold this share of the true neighbours of TRIALS rows within the sample, and LEAST_PROBES at least.
RECALL, TRIALS, LEAST_PROBES = 0.96, 256, 12
BLOCK, COLUMNS, STRIDE, CHUNK = 4096, 16, 512, 64
#: A list is dealt in parts of about twice the mean list's rows, within these bounds: at least this, at most 16 blocks.
LEAST_PART = 256
#: Width of the test: a candidate goes if its scaled partial distance is over (1 + EPSILON / sqrt(columns read)) times the bound.
EPSILON = 2.1
#: Room for float32 rounding in the test, as a share of the squared norms; without it copies of a query fail a bound of 0.
SLACK = 4e-6


@dataclass
class Index:
    centres: np.ndarray
    rotation: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray
    probes: int


def fit(ids: np.ndarray, vectors: np.ndarray, rows: int, seed: int = SEED) -> Index:
    """Centres and rotation from a sample of the rows."""
    rng = np.random.default_rng(seed)
    d = vectors.shape[1]
    lists = int(np.clip(round(math.sqrt(rows)), 1, max(1, len(vectors) // 8)))
    x = vectors.astype(np.float32)
    order = rng.permutation(len(x))
    order = order[np.sort(np.unique(x[order], axis=0, return_index=True)[1])]  # equal centres would part equal rows
    centres = x[order[:lists]].copy()
    lists = len(centres)
    for _ in range(ROUNDS):
        own = nearest(x, centres, 1)[:, 0]
        count = np.bincount(own, minlength=lists)
        total = np.zeros((lists, d))
        np.add.at(total, own, x)
        full = count > 0
        centres[full] = (total[full] / count[full, None]).astype(np.float32)
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.float32)
    some = slice(0, BOUND_SAMPLE)
    return Index(centres, rotation, x[some].astype(np.float64), ids[some], min(lists, max(LEAST_PROBES, probes_for(x, centres))))


def probes_for(x: np.ndarray, centres: np.ndarray, k: int = K) -> int:
    """Lists to probe so that RECALL of the true neighbours within x are in them (the full set's are nearer, so found more easily)."""
    own, tried = nearest(x, centres, 1)[:, 0], x[:TRIALS]
    order = nearest(tried, centres, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(tried), 0), 1)
    ranks = []
    for i in range(len(tried)):
        far = ((x - tried[i]) ** 2).sum(1)
        far[i] = np.inf
        ranks.append(place[i, own[np.argsort(far, kind="stable")[: min(k, len(x) - 1)]]])
    return int(np.quantile(np.concatenate(ranks), RECALL, method="higher")) + 1 if len(x) > 1 else 1


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Numbers of each row's k nearest centres, nearest first."""
    out = np.empty((len(x), min(k, len(centres))), np.int64)
    norm = (centres.astype(np.float64) ** 2).sum(1)
    for a in range(0, len(x), 1024):
        far = norm - 2 * (x[a : a + 1024] @ centres.T)
        if k == 1:
            out[a : a + 1024, 0] = far.argmin(1)
        else:
            part = np.argpartition(far, min(k, far.shape[1]) - 1, axis=1)[:, :k]
            out[a : a + 1024] = np.take_along_axis(part, np.argsort(np.take_along_axis(far, part, 1), axis=1, kind="stable"), 1)
    return out


def bounds(index: Index, ids: np.ndarray, x: np.ndarray, k: int = K) -> np.ndarray:
    """Upper bounds of each query's k-th distance, from the sample."""
    out = np.full(len(x), np.inf)
    for i in range(len(x)):
        far = np.sqrt(((index.sample - x[i]) ** 2).sum(1))[index.sample_ids != ids[i]]
        if len(far) >= k:
            out[i] = np.partition(far, k - 1)[k - 1]
    return out


def scan(block_ids: np.ndarray, original: np.ndarray, rotated: np.ndarray, query_id: int, query: np.ndarray, turned: np.ndarray, bound: float, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """vec_id and distance of the block's rows that may be among the k nearest; rotated is (dimensions, rows)."""
    d, n = rotated.shape
    best_far, best_id = np.empty(0), np.empty(0, np.int64)
    slack = SLACK * (float(query @ query) + np.einsum("ij,ij->j", rotated, rotated))
    for a in range(0, n, STRIDE):
        alive = np.arange(a, min(n, a + STRIDE))
        alive = alive[block_ids[alive] != query_id]
        partial = np.zeros(len(alive), np.float32)
        for c in range(0, d, COLUMNS):
            if not len(alive):
                break
            step = rotated[c : c + COLUMNS, alive] - turned[c : c + COLUMNS, None]
            partial = partial + np.einsum("ij,ij->j", step, step)
            read = min(d, c + COLUMNS)
            if read < d:
                stay = partial * (d / read) <= (bound * (1 + EPSILON / math.sqrt(read))) ** 2 + slack[alive] * (d / read)
                alive, partial = alive[stay], partial[stay]
        if not len(alive):
            continue
        exact = np.sqrt(((original[alive].astype(np.float64) - query) ** 2).sum(1))
        best_far, best_id = np.concatenate((best_far, exact)), np.concatenate((best_id, block_ids[alive]))
        order = np.lexsort((best_id, best_far))[:k]
        best_far, best_id = best_far[order], best_id[order]
        if len(best_far) == k:
            bound = min(bound, float(best_far[-1]))
    return best_id, best_far


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _assign(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                own = nearest(x.astype(np.float32), index.centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("vec_id"), batch.column("v")], names=["list", "vec_id", "v"])

    return run


def fewer(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Mask of the rows of one list that some query may find: of adjacent equal vectors (ids ascending) those of the first k + 1
    different ids, each at most k times. Whatever the query's own id, its k nearest of these copies are among them."""
    fresh = np.concatenate(([True], (x[1:] != x[:-1]).any(1)))
    other = fresh | np.concatenate(([True], ids[1:] != ids[:-1]))
    at = np.arange(len(ids))
    number = np.cumsum(other)  # of different ids
    begin = np.maximum.accumulate(np.where(fresh, number, 0))
    first = np.maximum.accumulate(np.where(other, at, 0))
    return (number - begin <= k) & (at - first < k)


def _block(index: Index, k: int):
    """Blocks of a list's part; rows come by list, part and vector, so copies that no query can find leave as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(at: tuple[int, int], i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            turned = np.ascontiguousarray((x.astype(np.float32) @ index.rotation).T)
            columns = [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([i.tobytes()]), pa.array([x.astype("<f8").tobytes()]), pa.array([turned.astype("<f4").tobytes()])]
            return pa.RecordBatch.from_arrays(columns, names=["list", "part", "ids", "original", "rotated"])

        now, ids, x = (-1, -1), np.empty(0, np.int64), np.empty((0, 0))
        for batch in batches:
            lists, parts, i, v = batch.column("list").to_numpy(), batch.column("part").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("v"))
            edge = [0, *(np.flatnonzero((lists[1:] != lists[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), len(lists)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                at = int(lists[a]), int(parts[a])
                if len(ids) and at != now:
                    yield out(now, ids, x)
                    ids, x = ids[:0], x[:0]
                if len(ids):
                    ids, x = np.concatenate((ids, i[a:b])), np.concatenate((x, v[a:b]))
                else:
                    ids, x = i[a:b], v[a:b]
                now, some = at, fewer(ids, x, k)
                ids, x = ids[some], x[some]
                while len(ids) > BLOCK:
                    yield out(now, ids[:BLOCK], x[:BLOCK])
                    ids, x = ids[BLOCK:], x[BLOCK:]
        if len(ids):
            yield out(now, ids, x)

    return run


def _probe(index: Index, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("v")).astype(np.float64)
            lists, bound = nearest(x.astype(np.float32), index.centres, index.probes), bounds(index, ids, x, k)
            n = lists.shape[1]
            vectors = pa.array([r.tobytes() for r in x], pa.binary()).take(pa.array(np.repeat(np.arange(len(x)), n)))
            yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), pa.array(np.repeat(ids, n)), vectors, pa.array(np.repeat(bound, n))], names=["list", "query_id", "vector", "bound"])

    return run


def _search(rotation: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(rotation)
        for batch in batches:
            who, found, far = [], [], []
            for ids, original, rotated, queries in zip(*(batch.column(c).to_pylist() for c in ("ids", "original", "rotated", "queries")), strict=True):
                i, x, r = np.frombuffer(ids, "<i8"), np.frombuffer(original, "<f8").reshape(-1, d), np.frombuffer(rotated, "<f4").reshape(d, -1)
                for q in queries:
                    vector = np.frombuffer(q["vector"], "<f8")
                    a, b = scan(i, x, r, q["query_id"], vector, vector.astype(np.float32) @ rotation, q["bound"], k)
                    who.append(np.full(len(a), q["query_id"]))
                    found.append(a)
                    far.append(b)
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who), pa.int64()), pa.array(np.concatenate(found), pa.int64()), pa.array(np.concatenate(far), pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id, v of the rows that take part, and their dimensions."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(fine)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return rows.limit(0), 0
    return rows.where(F.size("v") == sizes[0]), sizes[0]


def search(vectors: DataFrame, every: int = 100, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows, d = usable(vectors, id_col, vector_col)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    index = fit(some.column("vec_id").to_numpy(), np.array(some.column("v").to_pylist(), float), n)
    parts = shuffle_partitions(spark)
    listed = cut(mapped(rows, _assign(index), "list int, vec_id long, v array<double>"), "listed")
    part_rows = min(16 * BLOCK, max(LEAST_PART, 2 * n // len(index.centres)))
    sizes = listed.groupBy("list").count().withColumn("parts", F.ceil(F.col("count") / part_rows).cast("int")).drop("count").collect()  # a row a centre
    split = spark.createDataFrame(sizes, "list int, parts int")
    dealt = listed.join(F.broadcast(split), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    dealt = dealt.select("list", "part", "vec_id", "v", F.xxhash64("v").alias("same"))
    dealt = dealt.repartition(parts, "list", "part").sortWithinPartitions("list", "part", "same", "vec_id")
    blocks = cut(mapped(dealt, _block(index, k), "list int, part int, ids binary, original binary, rotated binary", rows=10_000), "blocks")
    discard(listed)
    probes = mapped(rows.where(F.pmod("vec_id", F.lit(every)) == 0), _probe(index, k), "list int, query_id long, vector binary, bound double")
    chunks = max(1, math.ceil(n / every * index.probes / len(index.centres) / CHUNK))
    probes = probes.join(F.broadcast(split), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = probes.groupBy("list", "part", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("query_id", "vector", "bound")).alias("queries"))
    units = blocks.join(asked, ["list", "part"]).select("ids", "original", "rotated", "queries")
    found = mapped(units, _search(index.rotation, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
