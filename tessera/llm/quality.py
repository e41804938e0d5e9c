"""Quality rules: word statistics plus zstandard compression bands over whole documents and fixed chunks.

Repetitive text compresses too well and random text too badly. What is normal depends on length (a short text has
little to refer back to), so each band has its own limits for its range of lengths, of whole texts and of chunks: CHUNK bytes each,
the last one what is left, if that is at least LEAST_CHUNK. A document is kept if it passes the base rules, its whole-text ratio lies
inside the band, and at most a share BAD_SHARE of its judged chunks' bytes lie in chunks outside theirs. So one bad chunk
rejects a document of up to nine, and a long one may hold a table or a listing, but no large part of junk.

Null or empty text: no words, base_failed true, ratios null. Null doc_id stays null. Repeated rows each get a row.
Extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import SPACES, mapped

SYMBOLS = b"#*$%&|<>"
LEVEL = 3
CHUNK = 4096


@dataclass(frozen=True)
class Band:
    """Limits of the ratio compressed / original bytes for texts of at least min_bytes."""

    min_bytes: int
    low: float
    high: float


#: By length of the whole text, ascending. Natural prose lies near 0.3 to 0.65 from a few hundred bytes on, base64 at 0.76.
WHOLE = (Band(0, 0.20, 1.30), Band(256, 0.25, 0.95), Band(1024, 0.20, 0.80), Band(4096, 0.18, 0.72), Band(32768, 0.15, 0.68))
#: By length of the chunk, ascending; the first is the shortest that is judged by itself.
CHUNKS = (Band(512, 0.22, 0.90), Band(1024, 0.21, 0.80), Band(2048, 0.20, 0.76), Band(CHUNK, 0.18, 0.72))
LEAST_CHUNK = CHUNKS[0].min_bytes
BAD_SHARE = 0.1

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " kept boolean, n_bytes long, ratio double, low double, high double, n_chunks long, n_bad_chunks long"
)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    v = len(seen)
    if v == n:
        return 0
    if v < 2_000_000:
        key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * v + ids[2:]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[back] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def band(n_bytes: int, bands: tuple[Band, ...] = WHOLE) -> Band:
    return next(b for b in reversed(bands) if n_bytes >= b.min_bytes)


def chunk_sizes(b: bytes, packer: zstandard.ZstdCompressor, chunks: tuple[Band, ...] = CHUNKS) -> tuple[list[int], list[int]]:
    """Bytes of each chunk that is judged, and of those outside their band."""
    judged, bad = [], []
    for i in range(0, len(b), CHUNK):
        chunk = b[i : i + CHUNK]
        if len(chunk) >= chunks[0].min_bytes:
            limits = band(len(chunk), chunks)
            judged.append(len(chunk))
            if not limits.low <= len(packer.compress(chunk)) / len(chunk) <= limits.high:
                bad.append(len(chunk))
    return judged, bad


def score(text: str | None, packer: zstandard.ZstdCompressor, whole: tuple[Band, ...] = WHOLE, chunks: tuple[Band, ...] = CHUNKS) -> tuple:
    """All columns but doc_id for one text."""
    b = (text or "").encode()
    words = b.split()
    n = len(words)
    word_chars = len(text or "") - (len(b) - len(b.translate(None, SPACES)))
    n_symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip()]
    n_repeat = repeat_words(words)
    failed = n < 50 or 100 * n_repeat > 50 * n
    ratio = len(packer.compress(b)) / len(b) if b else None
    limits = band(len(b), whole)
    judged, bad = chunk_sizes(b, packer, chunks)
    kept = not failed and ratio is not None and limits.low <= ratio <= limits.high and sum(bad) <= BAD_SHARE * sum(judged)
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), n_repeat, failed, kept, len(b), ratio, limits.low, limits.high, len(judged), len(bad)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    names = [x.strip().split()[0] for x in SCHEMA.split(",")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[x.strip().split()[1]] for x in SCHEMA.split(",")]
    for batch in batches:
        ids, rows = batch.column(0), [score(x.as_py(), packer) for x in batch.column(1)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(names) - 1)
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))], names=names)


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its statistics and verdict; a map over the rows, without a shuffle."""
    return mapped(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), _batches, SCHEMA)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        yield batch.filter(pa.array([score(x.as_py(), packer)[6] for x in batch.column("text")], pa.bool_()))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs (with all their columns) whose text passes; a map over the rows, without a join."""
    return mapped(docs, _kept, docs.schema)
