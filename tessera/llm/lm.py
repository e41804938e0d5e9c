"""Scoring texts with a gated recurrent language model in numpy: class-factored softmax, state carried over whole documents.

1. Documents become blocks (one for each Arrow batch): token numbers and a dictionary of the batch's distinct words. Written once.
2. Each block's words, with their counts in training documents, go to buckets by hash and come back with the counts of all blocks:
   distinct words of blocks are shuffled, not tokens. This gives the exact base score, N and V, and the HEAD most frequent words.
   A block is written again as its tokens' input numbers (two bytes each) and the sums by document that no weights change.
3. P(word) = P(class | state) * P(word | class, state). Head words are binned by frequency into classes of WIDTH, with a softmax
   inside the class; the others fall into TAIL classes by a hash of their last letters, inside which a word has (c + 1) / (N_k + V_k + 1),
   which leaves one share for all words never seen. The gated unit reads the word before (a head word or a tail class).
4. Training passes once over all training documents, a part of PARTS a round. In a round each task goes on from the same weights by truncated
   backpropagation through windows of STEPS tokens, many documents side by side (lanes); the tasks' weights are averaged in two levels.
5. Scoring runs whole documents through lanes, the state carried from window to window and cleared only where a document begins.

Every text ends with one end token. Null or empty text: that token alone. Null doc_id: held_out null, not in training. Repeated rows
count and are scored each. Without training tokens base_score is 0. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, cut, discard, fold, fold_of, mapped, shuffle_partitions

FOLDS, HELD_OUT = 7, 2
HEAD, WIDTH, TAIL = 1536, 48, 48
EMBED, HIDDEN, STEPS, RATE, CLIP, SEED = 16, 24, 16, 0.008, 1.0, 5
#: Training documents fall into PARTS by hash of doc_id; round r trains on part r, so the rounds pass over all of them once.
ROUNDS = PARTS = 4
#: Rows of states whose outputs are held at once, so that they stay in a core's cache.
ROWS = 1024
#: Lanes side by side in training and scoring. A training document goes in stretches of SPAN tokens, each from a cleared state.
LANES, SCORE_LANES, SPAN = 256, 512, 256
END = b"\n"  # white space, so no word
LN10 = float(np.log(10.0))


# ---- blocks and counts


def _pack(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """The words' bytes one after the other, and their lengths."""
    if not len(words):
        return b"", np.zeros(0, "<u4")
    _, offsets, flat = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    return flat[int(at[0]) : int(at[-1])].to_pybytes() if flat else b"", np.diff(at).astype("<u4")


def _unpack(flat: bytes, sizes: bytes) -> pa.Array:
    at = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<u4")))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(flat)])


def _last(words: pa.Array) -> np.ndarray:
    """Number of each word's last letters (three at most): the letters' count, then the letters."""
    flat, sizes = _pack(words)
    flat, ends = np.frombuffer(flat, np.uint8), np.cumsum(sizes, dtype=np.int64)
    out = np.minimum(sizes, 3).astype(np.int64) << 24
    for k in range(3):
        some = np.flatnonzero(sizes > k)
        out[some] |= flat[ends[some] - 1 - k].astype(np.int64) << (8 * k)
    return out


def tail_classes(words: pa.Array) -> np.ndarray:
    """tail_class of each word."""
    each, at = np.unique(_last(words), return_inverse=True)
    return np.array([zlib.crc32((x & 0xFFFFFF).to_bytes(3, "big")[3 - (x >> 24) :]) % TAIL for x in each.tolist()], np.int64)[at]


def _spread(words: pa.Array) -> np.ndarray:
    """A hash of each word: of its length and its first and last 8 bytes."""
    flat, sizes = _pack(words)
    flat, ends = np.frombuffer(flat, np.uint8), np.cumsum(sizes, dtype=np.int64)
    out, first = sizes.astype(np.uint64), ends - sizes
    for k in range(8):
        some = np.flatnonzero(sizes > k)
        for at in (first[some] + k, ends[some] - 1 - k):
            out[some] = (out[some] ^ flat[at]) * np.uint64(0x9E3779B97F4A7C15)
            out[some] ^= out[some] >> np.uint64(29)
    return out >> np.uint64(16)


BLOCK = "block long, docs array<long>, sizes array<long>, tokens binary, flat binary, widths binary, seen binary"


def tokens_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (END first), the number of each token, tokens of each text (words, then END)."""
    words, *rest = _tokens_of(texts)
    return words.to_pylist(), *rest


def _tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # ascii_lower makes a fresh array of a slice
    words = lists.flatten().cast(pa.binary())
    real = np.asarray(pc.greater(pc.binary_length(words), 0))  # white space at an end gives an empty word
    before = np.concatenate(([0], np.cumsum(real)))[lists.offsets.to_numpy()]
    coded = words.filter(pa.array(real)).dictionary_encode()
    tokens = np.zeros(len(coded) + len(texts), "<u4")
    ends = before[1:] + np.arange(len(texts))
    own = np.ones(len(tokens), bool)
    own[ends] = False
    tokens[own] = coded.indices.to_numpy() + 1
    return pa.concat_arrays([pa.array([END], pa.binary()), coded.dictionary]), tokens, np.diff(before) + 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for i, batch in enumerate(batches):
        docs = batch.column(0).to_pylist()
        words, tokens, sizes = _tokens_of(batch.column(1))
        train = np.repeat([fold_of(doc, FOLDS) not in (None, HELD_OUT) for doc in docs], sizes)
        seen = np.bincount(tokens[train], minlength=len(words))
        flat, widths = _pack(words)
        row = [[part << 32 | i], [docs], [sizes], [tokens.tobytes()], [flat], [widths.tobytes()], [seen.astype("<u4").tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 4), strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])


def tail_class(word: bytes) -> int:
    """Class of a word outside the head, by its last letters."""
    return zlib.crc32(word[-3:]) % TAIL


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, flat, widths, seen in zip(*(batch.column(c).to_pylist() for c in ("block", "flat", "widths", "seen")), strict=True):
                words, seen = _unpack(flat, widths), np.frombuffer(seen, "<u4")
                own = (_spread(words) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(own.astype(np.uint16) if buckets <= 1 << 16 else own, kind="stable")
                edge = np.searchsorted(own[order], np.arange(buckets + 1)).tolist()
                flat, sizes = _pack(words.take(pa.array(order)))
                at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).tolist()
                seen, order = seen[order], order.astype("<u4")
                packed = [(b, block, order[i:j].tobytes(), flat[at[i] : at[j]], sizes[i:j].tobytes(), seen[i:j].tobytes()) for b, (i, j) in enumerate(zip(edge, edge[1:], strict=False)) if i < j]
                types = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packed, strict=True), types, strict=True)], names=["bucket", "block", "places", "flat", "widths", "seen"])

    return run


ANSWER = "block long, places binary, counts binary, class int, n long, v long, word binary, total long"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition's buckets: counts back to each block, sums by tail class, and the partition's HEAD most frequent words."""
    rows, words, seen = [], [], []
    for batch in batches:
        for block, places, flat, widths, own in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "flat", "widths", "seen")), strict=True):
            rows.append((block, places))
            words.append(_unpack(flat, widths))
            seen.append(np.frombuffer(own, "<u4"))
    coded = pa.chunked_array(words, pa.binary()).dictionary_encode()  # one dictionary for all chunks
    distinct = coded.chunk(coded.num_chunks - 1).dictionary if rows else pa.array([], pa.binary())
    total = np.zeros(len(distinct), np.int64)
    numbers = [c.indices.to_numpy() for c in coded.chunks]
    for c, own in zip(numbers, seen, strict=True):
        total[c] += own  # the words of a row are distinct
    names = [x.split()[0] for x in ANSWER.split(", ")]
    types = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())

    def out(**columns: list) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(k, [None] * n), t) for k, t in zip(names, types, strict=True)], names=names)

    for i in range(0, len(rows), 64):
        block, places = zip(*rows[i : i + 64], strict=True)
        yield out(block=block, places=places, counts=[total[c].astype("<i8").tobytes() for c in numbers[i : i + 64]])
    known, classes = np.flatnonzero(total), tail_classes(distinct)
    n_of, v_of = np.zeros(TAIL, np.int64), np.bincount(classes[known], minlength=TAIL)
    np.add.at(n_of, classes[known], total[known])
    yield out(**{"class": list(range(TAIL)), "n": n_of.tolist(), "v": v_of.tolist()})
    if len(known) > HEAD:
        known = known[total[known] >= np.partition(total[known], -HEAD)[-HEAD]]
    head = sorted(zip((-total[known]).tolist(), distinct.take(pa.array(known)).to_pylist(), strict=True))[:HEAD]
    if head:
        yield out(word=[w for _, w in head], total=[-n for n, _ in head])


# ---- the model


class Vocabulary:
    """Head words by rank, and what is left in the tail classes."""

    def __init__(self, head: list[tuple[bytes, int]], n_of: np.ndarray, v_of: np.ndarray):
        self.rank = {w: i for i, (w, _) in enumerate(head)}
        self.head_counts = np.array([n for _, n in head], np.int64)
        self.n_of, self.v_of = n_of.astype(np.int64).copy(), v_of.astype(np.int64).copy()
        self.train_tokens, self.distinct = int(n_of.sum()), int(v_of.sum())
        for w, n in head:
            self.n_of[tail_class(w)] -= n
            self.v_of[tail_class(w)] -= 1
        self.bins = -(-len(head) // WIDTH)
        self.classes = self.bins + TAIL
        self.inputs = len(head) + TAIL

    def number(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """Input number of each word: its rank in the head, or else the head's size plus its tail class."""
        words = pa.array(words, pa.binary())
        ranks = pc.fill_null(pc.index_in(words, value_set=pa.array(list(self.rank), pa.binary())), -1).to_numpy().astype(np.int64)
        return np.where(ranks < 0, len(self.rank) + tail_classes(words), ranks)

    def classes_of(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and place in the class (-1 in a tail class) of each input number."""
        n = len(self.rank)
        head = inputs < n
        return np.where(head, inputs // WIDTH, self.bins + inputs - n), np.where(head, inputs % WIDTH, -1)


def initial(vocabulary: Vocabulary, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights that give the unigram distribution whatever the state."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
    bins = np.zeros((max(1, vocabulary.bins), WIDTH))
    mass = np.full(bins.size, -1e4)
    mass[: len(vocabulary.head_counts)] = np.log(np.maximum(vocabulary.head_counts, 1))
    by_class = np.zeros(vocabulary.classes)
    head = np.zeros(bins.size)
    head[: len(vocabulary.head_counts)] = vocabulary.head_counts
    by_class[: vocabulary.bins] = head.reshape(bins.shape).sum(1)[: vocabulary.bins]
    by_class[vocabulary.bins :] = vocabulary.n_of + 1
    p = {
        "embed": draw(vocabulary.inputs, EMBED),
        "in": draw(EMBED, 3 * HIDDEN) * 3,
        "state": draw(HIDDEN, 3 * HIDDEN) * 2,
        "bias": np.zeros(3 * HIDDEN, np.float32),
        "class": draw(HIDDEN, vocabulary.classes) * 0.1,
        "class_bias": np.log(np.maximum(by_class, 1) / np.maximum(by_class, 1).max()).astype(np.float32),
        "word": draw(*bins.shape[:1], HIDDEN, WIDTH) * 0.1,
        "word_bias": (mass - mass.max()).reshape(bins.shape).astype(np.float32),
    }
    return views(flat_of(p), p)


def input_table(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """What each input adds to the gates, negated, and to the new state; the last row is for no input, where a text begins."""
    table = np.zeros((len(p["embed"]) + 1, 3 * HIDDEN), p["in"].dtype)
    np.matmul(p["embed"], p["in"], out=table[:-1])
    table += p["bias"]
    return -table[:, : 2 * HIDDEN], table[:, 2 * HIDDEN :].copy()


def _forward(p: dict, table: tuple[np.ndarray, np.ndarray], inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
    """States before each token of a window (steps, lanes, hidden). inputs[t] is the token before, -1 where a text begins (fresh)."""
    steps, lanes = inputs.shape
    states = np.empty((steps, lanes, HIDDEN), h.dtype)
    before, reset = (np.empty_like(states), np.empty_like(states)) if keep else (None, None)
    u, u2 = -p["state"][:, : 2 * HIDDEN], p["state"][:, 2 * HIDDEN :].copy()
    any_fresh = fresh.any(1).tolist()
    every_gate, every_c = (x.take(inputs, axis=0) for x in table)  # of all steps at once; the gates are kept negated up to their exp
    for t in range(steps):
        if any_fresh[t]:
            h = h.copy()
            h[fresh[t]] = 0
        gates, c = every_gate[t], every_c[t]
        gates += h @ u
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        rh = r * h
        c += rh @ u2
        np.tanh(c, out=c)
        new = states[t]
        np.subtract(c, h, out=new)
        new *= z
        new += h
        if keep:
            before[t], reset[t] = h, rh
        h = new
    return states, h, (before, every_gate[..., :HIDDEN], every_gate[..., HIDDEN:], reset, every_c)


def _large(p: dict) -> bool:
    """Whether exp of an output may overflow; states are within 1."""
    return any(float(np.abs(p[k]).sum(-2).max(initial=0) + p[k + "_bias"].max(initial=0)) > 80 for k in ("class", "word"))


def _with_bias(p: dict, name: str) -> np.ndarray:
    """Weights of a softmax with the bias as their last row; states get a last column of ones."""
    return np.concatenate((p[name], p[name + "_bias"][..., None, :]), -2)


def _with_one(states: np.ndarray) -> np.ndarray:
    return np.concatenate((states, np.ones((len(states), 1), states.dtype)), 1)


def _exp_sum(states: np.ndarray, weights: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray]:
    """exp(states @ weights) and its row sums."""
    x = states @ weights
    if large:
        np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _by_bin(classes: np.ndarray, bins: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows in order of their class, and (bin, first, end) of each bin of head words in that order."""
    order = np.argsort(classes.astype(np.uint16), kind="stable")
    edge = np.searchsorted(classes[order], np.arange(bins + 1)).tolist()
    return order, [(k, edge[k], edge[k + 1]) for k in range(bins) if edge[k] < edge[k + 1]]


def log_probabilities(p: dict, bins: int, states: np.ndarray, classes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Natural log of P(class) and, in the head, P(word | class), for each row of states."""
    out, large = np.empty(len(states)), _large(p)
    states, by_class, by_word = _with_one(states), _with_bias(p, "class"), _with_bias(p, "word")
    for a in range(0, len(states), ROWS):
        e, total = _exp_sum(states[a : a + ROWS], by_class, large)
        out[a : a + ROWS] = np.log(np.maximum(e[np.arange(len(e)), classes[a : a + ROWS]] / total, 1e-30))
    order, runs = _by_bin(classes, bins)
    order = order[: runs[-1][2] if runs else 0]
    rows, place, inside = states[order], places[order], np.empty(len(order), states.dtype)
    for k, first, end in runs:
        for a in range(first, end, ROWS):
            b = min(end, a + ROWS)
            e, total = _exp_sum(rows[a:b], by_word[k], large)
            inside[a:b] = e[np.arange(b - a), place[a:b]] / total
    out[order] += np.log(np.maximum(inside, 1e-30))
    return out


def _gradients(p: dict, bins: int, table: tuple[np.ndarray, np.ndarray], inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, classes: np.ndarray, places: np.ndarray, live: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean loss over the live tokens of one window, and the state after it."""
    steps, lanes = inputs.shape
    states, last, saved = _forward(p, table, inputs, fresh, h, True)
    flat, on = states.reshape(-1, HIDDEN), np.flatnonzero(live.ravel())
    rows, k, place = flat[on], classes.ravel()[on], places.ravel()[on]
    g = views(np.zeros(sum(v.size for v in p.values()), flat.dtype), p)
    scale = flat.dtype.type(1.0 / max(1, len(on)))
    large = _large(p)
    rows, by_class, by_word = _with_one(rows), _with_bias(p, "class"), _with_bias(p, "word")
    back, out = np.empty((len(rows), HIDDEN), flat.dtype), np.zeros_like(by_class)
    by_class_t = p["class"].T.copy()
    for i in range(0, len(rows), ROWS):
        own = rows[i : i + ROWS]
        d, total = _exp_sum(own, by_class, large)
        d *= (scale / total)[:, None]
        d[np.arange(len(d)), k[i : i + ROWS]] -= scale
        out += own.T @ d
        np.matmul(d, by_class_t, out=back[i : i + ROWS])
    g["class"][:], g["class_bias"][:] = out[:-1], out[-1]
    order, runs = _by_bin(k, bins)
    order = order[: runs[-1][2] if runs else 0]
    rows, place, inner = rows[order], place[order], np.empty((len(order), HIDDEN), flat.dtype)
    for b, i, j in runs:
        e, total = _exp_sum(rows[i:j], by_word[b], large)
        e *= (scale / total)[:, None]
        e[np.arange(j - i), place[i:j]] -= scale
        out = rows[i:j].T @ e
        g["word"][b], g["word_bias"][b] = out[:-1], out[-1]
        np.matmul(e, p["word"][b].T, out=inner[i:j])
    back[order] += inner
    dh_out = np.zeros_like(flat)
    dh_out[on] = back
    dh_out = dh_out.reshape(states.shape)
    dh = np.zeros((lanes, HIDDEN), flat.dtype)
    dx = np.empty((steps, lanes, 3 * HIDDEN), flat.dtype)
    ut, u2t = p["state"][:, : 2 * HIDDEN].T.copy(), p["state"][:, 2 * HIDDEN :].T.copy()
    before, z, r, rh, c = saved
    rest = 1 - z
    by_c, by_z, by_r = c * c, c - before, 1 - r
    np.subtract(1, by_c, out=by_c)
    by_c *= z
    by_z *= z
    by_z *= rest
    by_r *= r
    by_r *= before
    for t in reversed(range(steps)):
        dh += dh_out[t]
        dc, gates = dx[t, :, 2 * HIDDEN :], dx[t, :, : 2 * HIDDEN]
        np.multiply(dh, by_c[t], out=dc)
        drh = dc @ u2t
        np.multiply(dh, by_z[t], out=gates[:, :HIDDEN])
        np.multiply(drh, by_r[t], out=gates[:, HIDDEN:])
        dh *= rest[t]
        drh *= r[t]
        dh += drh
        dh += gates @ ut
        dh[fresh[t]] = 0
    flat_dx = dx.reshape(-1, 3 * HIDDEN)
    g["state"][:, : 2 * HIDDEN] = before.reshape(-1, HIDDEN).T @ flat_dx[:, : 2 * HIDDEN]
    g["state"][:, 2 * HIDDEN :] = rh.reshape(-1, HIDDEN).T @ flat_dx[:, 2 * HIDDEN :]
    g["bias"][:] = np.ones(len(flat_dx), flat_dx.dtype) @ flat_dx
    number = inputs.ravel()
    some = np.flatnonzero(number >= 0)
    order = some[np.argsort(number[some].astype(np.uint16), kind="stable")]  # at most HEAD + TAIL inputs
    number = number[order]
    edge = np.flatnonzero(np.concatenate((number[:1] >= 0, number[1:] != number[:-1])))
    if len(edge):  # sums by input first, as words come again and again in a window
        sums, number = np.add.reduceat(flat_dx.take(order, axis=0), edge, axis=0), number[edge]
        np.matmul(p["embed"][number].T, sums, out=g["in"])
        g["embed"][number] = sums @ p["in"].T
    return g, last


def views(flat: np.ndarray, like: dict) -> dict:
    """Arrays shaped as in `like` over one flat array, by name."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def flat_of(p: dict) -> np.ndarray:
    """The flat array under `views`."""
    return np.concatenate([p[k].ravel() for k in sorted(p)])


class Adam:
    """Steps over weights p that are views of one flat array."""

    def __init__(self, p: dict, rate: float = RATE):
        flat = next(iter(p.values())).base
        self.flat, self.m, self.v, self.t, self.rate = flat, np.zeros_like(flat), np.zeros_like(flat), 0, rate

    def step(self, g: dict) -> None:
        self.t += 1
        x = next(iter(g.values())).base
        x *= np.float32(min(1.0, CLIP / (float(np.sqrt(x @ x)) + 1e-9)))
        rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        self.m += np.float32(0.1) * (x - self.m)
        x *= x
        self.v += np.float32(0.001) * (x - self.v)
        np.sqrt(self.v, out=x)
        x += np.float32(1e-8)
        np.divide(self.m, x, out=x)
        x *= rate
        self.flat -= x


def lanes_of(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lane and first step of each stretch of text, one after the other in their lane, and each lane's length; longest lane first."""
    n = min(most, max(1, len(sizes)))
    lane, start, load = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), [(0, i) for i in range(n)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        at, k = heapq.heappop(load)
        lane[i], start[i] = k, at
        heapq.heappush(load, (at + int(sizes[i]), k))
    length = np.zeros(n, np.int64)
    for total, k in load:
        length[k] = total
    order = np.argsort(-length, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return place[lane], start, length[order]


def windows(first: np.ndarray, sizes: np.ndarray, most: int, inputs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(token positions or -1, starts, input before each token) of each window of STEPS, over the lanes that are not yet through.

    The stretches begin at the token positions `first`; state and input are cleared where one starts.
    """
    lane, start, length = lanes_of(sizes, most)
    steps = -(-int(length[0]) // STEPS) * STEPS
    order = np.lexsort((start, lane))
    first, sizes, lane, start = first[order], sizes[order], lane[order], start[order]
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    token = np.repeat(first, sizes) + inner  # by lane, then step
    begins = np.concatenate(([0], np.cumsum(length)[:-1]))
    fresh_flat = inner == 0
    for a in range(0, steps, STEPS):
        lanes = int(np.searchsorted(-length, -a, side="left"))  # those longer than a
        at = a + np.arange(STEPS)[:, None] + np.zeros(lanes, np.int64)
        live = at < length[:lanes]
        flat = np.where(live, at + begins[:lanes], 0)
        here = np.where(live, token[flat], -1)
        fresh = fresh_flat[flat] | ~live
        before = np.where(fresh, -1, inputs[np.maximum(here, 1) - 1])
        yield here, fresh, before


ENCODED = "docs array<long>, sizes array<long>, inputs binary, known array<long>, base array<double>, tail array<double>"


def _sums(vocabulary: Vocabulary, tokens: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What of each document's scores doesn't hang on the weights: n_known, base_score, and the natural log of its words' shares in tail classes."""
    classes, places = vocabulary.classes_of(numbers)
    base = np.log10((counts + 1) / (vocabulary.train_tokens + vocabulary.distinct + 1))
    inside = np.zeros(len(numbers))
    tail = places < 0
    k = classes[tail] - vocabulary.bins
    inside[tail] = np.log((counts[tail] + 1) / (vocabulary.n_of[k] + vocabulary.v_of[k] + 1))
    first = np.cumsum(sizes) - sizes
    return tuple(np.add.reduceat(x[tokens], first) for x in ((counts > 0).astype(np.int64), base, inside))


def _encoder(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _unpack(row["flat"], row["widths"])
                counts = np.zeros(len(words), "<i8")
                for a in row["answers"]:
                    counts[np.frombuffer(a["places"], "<u4")] = np.frombuffer(a["counts"], "<i8")
                tokens, sizes, numbers = np.frombuffer(row["tokens"], "<u4"), np.array(row["sizes"], np.int64), vocabulary.number(words)
                out = [[row["docs"]], [sizes], [numbers.astype("<u2")[tokens].tobytes()], *([x] for x in _sums(vocabulary, tokens, sizes, numbers, counts))]
                types = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[x.split()[0] for x in ENCODED.split(", ")])

    return run


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (numbers of the block's words), sizes of documents, input number of each word."""
    return np.frombuffer(row["tokens"], "<u4").astype(np.int64), np.array(row["sizes"], np.int64), np.frombuffer(row["inputs"], "<u2").astype(np.int64)


def train_block(p: dict, adam: Adam, vocabulary: Vocabulary, row: dict, part: int) -> int:
    """The same as `train`, of a block with its words' input numbers."""
    tokens, sizes, numbers = _arrays(row)
    return train(p, adam, vocabulary, row["docs"], sizes, numbers[tokens], part)


def train(p: dict, adam: Adam, vocabulary: Vocabulary, docs: list[int | None], sizes: np.ndarray, inputs: np.ndarray, part: int) -> int:
    """One pass of truncated backpropagation over a block's training documents of this part; returns its tokens."""
    chosen = np.array([fold_of(d, FOLDS) not in (None, HELD_OUT) and zlib.crc32(f"part {d}".encode()) % PARTS == part for d in docs], bool)
    if not chosen.any():
        return 0
    inputs = inputs[np.repeat(chosen, sizes)].astype(np.int64)
    sizes = sizes[chosen]
    classes, places = vocabulary.classes_of(inputs)
    begin = np.cumsum(sizes) - sizes
    cuts = -(-sizes // SPAN)
    inner = (np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * SPAN
    first = np.repeat(begin, cuts) + inner
    h = np.zeros((LANES, HIDDEN), np.float32)
    for here, start, before in windows(first, np.minimum(SPAN, np.repeat(sizes, cuts) - inner), LANES, inputs):
        live = here >= 0
        where = np.maximum(here, 0)
        h = h[: here.shape[1]]
        g, h = _gradients(p, vocabulary.bins, input_table(p), before, start, h, classes[where], places[where], live)
        adam.step(g)
    return len(inputs)


def _dump(p: dict) -> bytes:
    return flat_of(p).astype("<f4").tobytes()


def _load(raw: bytes, like: dict) -> dict:
    return views(np.frombuffer(raw, "<f4").copy(), like)


def _trainer(vocabulary: Vocabulary, weights: dict, part: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, n = views(flat_of(weights), weights), 0
        adam = Adam(p, rate)
        for batch in batches:
            for row in batch.to_pylist():
                n += train(p, adam, vocabulary, row["docs"], np.array(row["sizes"], np.int64), np.frombuffer(row["inputs"], "<u2"), part)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([_dump(p)])], names=["n", "weights"])

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        for m, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(raw.as_py(), "<f4").astype(np.float64) * m
            n, total = n + m, own if total is None else total + own
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / n).astype("<f4").tobytes()])], names=["n", "weights"])


RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score_block(p: dict, vocabulary: Vocabulary, row: dict) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each document of a block with its words' input numbers and counts."""
    tokens, sizes, numbers = _arrays(row)
    known, base, tail = _sums(vocabulary, tokens, sizes, numbers, np.frombuffer(row["counts"], "<i8"))
    return [sizes, known, base, (log_of_texts(p, vocabulary, sizes, numbers[tokens]) + tail) / LN10]


def log_of_texts(p: dict, vocabulary: Vocabulary, sizes: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    """Natural log of each document's probability, without its words' shares in tail classes."""
    inputs = inputs.astype(np.int64)
    classes, places = vocabulary.classes_of(inputs)
    log_p = np.zeros(len(inputs))
    first = np.cumsum(sizes) - sizes
    table = input_table(p)
    h = np.zeros((SCORE_LANES, HIDDEN), np.float32)
    held, where, size = [], [], 0

    def settle() -> None:
        nonlocal held, where, size
        w = np.concatenate(where)
        log_p[w] += log_probabilities(p, vocabulary.bins, np.concatenate(held), classes[w], places[w])
        held, where, size = [], [], 0

    for here, start, before in windows(first, sizes, SCORE_LANES, inputs):
        states, h, _ = _forward(p, table, before, start, h[: here.shape[1]], False)
        live = here >= 0
        held.append(states[live])
        where.append(here[live])
        size += len(where[-1])
        if size > 200_000:
            settle()
    if size:
        settle()
    return np.add.reduceat(log_p, first)


def _scorer(vocabulary: Vocabulary, weights: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                log_p = log_of_texts(weights, vocabulary, sizes, np.frombuffer(row["inputs"], "<u2"))
                columns = (sizes, row["known"], row["base"], (log_p + np.array(row["tail"])) / LN10)
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    spark = docs.sparkSession
    with batch_bytes(spark):
        n = shuffle_partitions(spark)
        blocks = cut(mapped(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), _blocks, BLOCK), "blocks")
        # from here on a row is a block
        asked = mapped(blocks.select("block", "flat", "widths", "seen"), _ask(n), "bucket int, block long, places binary, flat binary, widths binary, seen binary")
        answers = cut(mapped(asked.repartition(n, "bucket"), _answer, ANSWER), "answers")
        head = [(bytes(r[0]), r[1]) for r in answers.where("word is not null").select("word", "total").orderBy(F.desc("total"), "word").limit(HEAD).collect()]
        sums = {r[0]: (r[1], r[2]) for r in answers.where("class is not null").groupBy("class").agg(F.sum("n"), F.sum("v")).collect()}
        n_of, v_of = (np.array([sums.get(k, (0, 0))[i] for k in range(TAIL)], np.int64) for i in (0, 1))
        vocabulary = Vocabulary(head, n_of, v_of)
        back = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("places", "counts")).alias("answers"))
        encoded = cut(mapped(blocks.drop("seen").join(back, "block"), _encoder(vocabulary), ENCODED), "encoded")
        discard(blocks, answers)
        weights = initial(vocabulary)
        for part in range(ROUNDS if vocabulary.train_tokens else 0):
            own = mapped(encoded.select("docs", "sizes", "inputs"), _trainer(vocabulary, weights, part, RATE / (1 + part)), "n long, weights binary")
            few = list(mapped(own.repartition(8), _mean, "n long, weights binary").toLocalIterator())
            total = sum(r[0] for r in few)
            if total:
                mean = sum(np.frombuffer(bytes(r[1]), "<f4").astype(np.float64) * (r[0] / total) for r in few)
                weights = _load(mean.astype("<f4").tobytes(), weights)
    scored = mapped(encoded, _scorer(vocabulary, weights), RESULT)
    held = fold("doc_id", FOLDS) == HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
