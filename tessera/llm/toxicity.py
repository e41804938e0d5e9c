"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-case words and the first PREFIX letters of its longer words, hashed into 2^BITS buckets. Buckets whose
document counts in the two classes differ by more than LEAST_Z standard errors are the features. The machine's score is a bias plus a
weight for each feature present plus the inner products of all pairs of their factors, so that two terms together can say more
(or less) than the sum of what each says. Fitted by Adagrad on logistic loss, then calibrated on a fifth of the sample that
the fit doesn't see.

Fitting takes at most MAX_TOXIC toxic and MAX_OTHER other labelled rows, those first by hash of doc_id, of the training fold only.
Scoring reads the text alone. Null or empty text: no features, the calibrated bias. Null doc_id: held_out null. Repeated rows
each get a row; a doc_id with several labels counts once for each. Without any labelled rows of both classes all scores are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, mapped

FOLDS, HELD_OUT, CUTOFF = 3, 1, 0.7
BITS, PREFIX, LEAST_Z, LEAST_DOCS, MOST_FEATURES = 20, 4, 4.0, 4, 8192
MAX_TOXIC, MAX_OTHER = 4000, 12000
RANK, EPOCHS, RATE, DECAY, BATCH, SEED = 8, 30, 0.1, 2e-4, 128, 7
RIDGE = 0.02
MEMORY = 500_000

#: ASCII letters and digits and all bytes beyond ASCII stay; the rest separates words.
WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode().translate(WORDS).split())


def buckets(word: bytes, bits: int = BITS) -> tuple[int, ...]:
    """Hash buckets of a word: itself, and its prefix if it has more letters."""
    mask = (1 << bits) - 1
    whole = zlib.crc32(word) & mask
    text = word.decode(errors="ignore")
    if len(text) <= PREFIX:
        return (whole,)
    return whole, zlib.crc32(text[:PREFIX].encode(), 1) & mask


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [sorted({b for w in words(x.as_py()) for b in buckets(w)}) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lists, pa.list_(pa.int32()))], names=["toxic", "doc_id", "terms"])


class Machine:
    """Features (bucket numbers, sorted), weights and factors, and the calibration."""

    def __init__(self, features: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray, slope: float, shift: float):
        self.features, self.bias, self.weights, self.factors, self.slope, self.shift = features, bias, weights, factors, slope, shift
        self.memory: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}}

    def of(self, word: bytes) -> tuple[int, ...]:
        found = self.memory.get(word)
        if found is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            b = np.array(buckets(word))
            at = np.searchsorted(self.features, b)
            hit = at < len(self.features)
            hit[hit] = self.features[at[hit]] == b[hit]
            found = self.memory[word] = tuple(at[hit].tolist())
        return found

    def raw(self, active: list[int]) -> float:
        if not active:
            return self.bias
        v = self.factors[active]
        total = v.sum(0)
        return self.bias + float(self.weights[active].sum()) + 0.5 * float(total @ total - (v * v).sum())

    def score(self, text: str | None) -> float:
        active: set[int] = set()
        for w in words(text):
            if found := self.of(w):
                active.update(found)
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.raw(sorted(active)) + self.shift, -40, 40))))


def fit(labels: np.ndarray, terms: list[np.ndarray], seed: int = SEED) -> Machine:
    """Fit on labelled lists of buckets."""
    rng = np.random.default_rng(seed)
    n, toxic = len(labels), int(labels.sum())
    if not toxic or toxic == n:  # nothing to tell apart: the base rate, smoothed; nothing is toxic where there is no label at all
        return Machine(np.empty(0, np.int64), float(np.log((toxic + 1) / (n - toxic + 1))) if n else -40.0, np.empty(0), np.empty((0, RANK)), 1.0, 0.0)
    held = np.zeros(n, bool)
    held[rng.permutation(n)[: n // 5]] = True
    flat = np.concatenate(terms).astype(np.int32)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in terms])
    train = ~held[row]
    in_toxic = np.bincount(flat[train & (labels[row] == 1)], minlength=1 << BITS)
    in_all = np.bincount(flat[train], minlength=1 << BITS)
    share = labels[~held].mean()
    z = (in_toxic - in_all * share) / np.sqrt(np.maximum(in_all * share * (1 - share), 1e-9))
    fine = np.flatnonzero((np.abs(z) >= LEAST_Z) & (in_all >= LEAST_DOCS))
    features = np.sort(fine[np.argsort(-np.abs(z[fine]), kind="stable")[:MOST_FEATURES]])
    at = np.minimum(np.searchsorted(features, flat), max(0, len(features) - 1))
    hit = features[at] == flat if len(features) else np.zeros(len(flat), bool)
    row, at = row[hit], at[hit]
    start = np.searchsorted(row, np.arange(n + 1))
    m = len(features)
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(m), rng.normal(0, 0.05, (m, RANK))
    gw, gv, gb = np.full(m, 1e-6), np.full((m, RANK), 1e-6), 1e-6
    rows = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(rows), max(1, len(rows) // BATCH)):
            parts = [at[start[i] : start[i + 1]] for i in some]
            size = np.array([len(p) for p in parts])
            feature = np.concatenate(parts)
            own = np.repeat(np.arange(len(some)), size)
            f = v[feature]
            total = np.zeros((len(some), RANK))
            np.add.at(total, own, f)
            raw = bias + np.bincount(own, w[feature], len(some)) + 0.5 * ((total**2).sum(1) - np.bincount(own, (f * f).sum(1), len(some)))
            error = 1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[some]
            gb += error.mean() ** 2
            bias -= RATE * error.mean() / np.sqrt(gb)
            used, back = np.unique(feature, return_inverse=True)
            dw = np.bincount(back, error[own], len(used)) / len(some) + DECAY * w[used]
            dv = np.zeros((len(used), RANK))
            np.add.at(dv, back, error[own, None] * (total[own] - f) / len(some))
            dv += DECAY * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
    machine = Machine(features, bias, w, v, 1.0, 0.0)
    raw = np.array([machine.raw(at[start[i] : start[i + 1]].tolist()) for i in np.flatnonzero(held)])
    machine.slope, machine.shift = _calibrate(raw, labels[held])
    return machine


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-out raw scores (Platt), with a weak pull towards a flat slope."""
    good, bad = y.sum(), (1 - y).sum()
    if not good or not bad:
        return 1.0, 0.0
    x = np.stack((raw, np.ones(len(raw))), 1)
    ab = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(2)
        step = np.clip(np.linalg.solve(h, x.T @ (p - y) + RIDGE * ab), -2, 2)
        ab = ab - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(ab[0], 1e-3)), float(ab[1])


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine from the labelled rows of the training fold: at most MAX_TOXIC + MAX_OTHER of them come to the driver."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").distinct()
    known = known.where(fold("doc_id", FOLDS) != HELD_OUT)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(MAX_TOXIC).unionAll(known.where("toxic = 0").orderBy(*order).limit(MAX_OTHER))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(chosen), "doc_id")
    got = mapped(texts.select("toxic", "text", "doc_id"), _terms, "toxic int, doc_id long, terms array<int>").toArrow()
    toxic, ids = got.column("toxic").to_numpy().astype(float), got.column("doc_id").to_numpy()
    terms = [x for c in got.column("terms").chunks for x in np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1]) if len(c)]
    del got
    order = np.lexsort((np.array([len(t) for t in terms]), toxic, ids))
    return fit(toxic[order], [terms[i] for i in order])


def _scorer(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([machine.score(x.as_py()) for x in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= CUTOFF).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    machine = train(docs, labels)
    scored = mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), _scorer(machine), "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
