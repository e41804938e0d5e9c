"""Packing token sequences: shortest-pack-first over the length histogram, patterns joined back to documents by rank.

1. Tokenize each text once and add the end id; cut every document into pieces of max_tokens and one shorter rest.
   A piece gets its rank among the pieces of its length in its partition; the pieces (not the ids) are written.
2. The histogram of piece lengths has at most max_tokens bins whatever the input, so it goes to the driver.
   Lengths are placed longest first, each into the open pattern with the most space left, many packs at a time by count.
3. A pattern that is used n times owns n sequence ids in a row, and each of its slots owns a range of n ranks of its length.
   Pieces find their slot by length and rank. The table of slots is bounded by the bins, not by the input.

Null or empty text: a single token, the end id. Repeated rows and repeated doc_ids are packed each for itself. A null doc_id
stays null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, mapped

TOKENIZER = "byte_bpe_50k"
END_ID = 1
MAX_TOKENS = 2048
#: Units whose ids a worker remembers; beyond it the memory is emptied and fills again.
MEMORY = 800_000

#: A text falls apart before a run of blanks and newlines: the vocabulary's pattern always has a token boundary there.
UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Other white space (or what Python calls so) and special tokens: such texts are encoded as a whole.
ODD = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SPECIAL = "<|endoftext|>"


class Units(dict):
    """Ids of a unit as little-endian 32-bit bytes, encoded when first met."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        ids = array("I", self.encode(unit)).tobytes()
        if len(unit) < 64:
            self[unit] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(tokenizer: str = TOKENIZER):
    """text -> ids as bytes; equal to tokenizers' encode(text, add_special_tokens=False).ids."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{tokenizer}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(tokenizer, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    units = Units(fast.encode_ordinary)
    whole: list = []

    def encode(text: str) -> bytes:
        if SPECIAL in text or ODD.search(text):
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(public_tokenizers.path(f"{tokenizer}.json")))
            return array("I", whole[0].encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([units[u] for u in UNIT.findall(text)])

    return encode


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, local_rank long"


def _cutter(tokenizer: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, end, ranks = TaskContext.get().partitionId(), array("I", [end_id]).tobytes(), [0] * (most + 1)
        for batch in batches:
            encode = encoder(tokenizer)
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + end)
                n = len(ids) // 4
                for a in range(0, n, most):
                    size = min(most, n - a)
                    rows.append((doc, a, size, zlib.crc32(ids[4 * a : 4 * (a + size)]), n, part, ranks[size]))
                    ranks[size] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def pack_histogram(counts: dict[int, int], most: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths longest first) and how often each is used; every length is used counts[length] times in all."""
    by_space: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        left = counts[length]
        while left:
            space = max((s for s, packs in by_space.items() if packs), default=0)
            if space < length:
                by_space.setdefault(most - length, []).append(((length,), left))
                # nothing open has room, so all that is left of this length opens packs; they may hold more of it
                room = most // length
                if room > 1:
                    packs = by_space[most - length].pop()
                    full, rest = divmod(packs[1], room)
                    if full:
                        by_space.setdefault(most - room * length, []).append(((length,) * room, full))
                    if rest:
                        by_space.setdefault(most - rest * length, []).append(((length,) * rest, 1))
                break
            pattern, n = by_space[space].pop()
            used = min(n, left)
            if n > used:
                by_space[space].append((pattern, n - used))
            by_space.setdefault(space - length, []).append(((*pattern, length), used))
            left -= used
    return [p for s in sorted(by_space) for p in by_space[s]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence id, offset) for each slot of each pattern."""
    out, taken, base = [], {}, 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            first = taken.get(length, 0)
            out.append((length, first, first + n - 1, base, offset))
            taken[length] = first + n
            offset += length
        base += n
    return out


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, most: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    pieces = cut(mapped(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), _cutter(tokenizer, end_id, most), PIECES), "pieces")
    counts = cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `most` rows
    places = spark.createDataFrame(slots(pack_histogram(histogram, most)), "length long, first long, last long, base long, offset long")
    before = counts.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    found = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & ranked["rank"].between(places["first"], places["last"]))
    return found.select("doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
