"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

White space stays as it is but for the blank, which becomes U+2581, and one is put in front of a text. The best segmentation has the
highest sum of piece scores. At each position the automaton gives all pieces that end there, longest first, by following output
links; each relaxes the best score of its end. Of equal sums the longer last piece stays. A character in no piece is spelled in byte
pieces, at FALLBACK below the worst piece for each character; so is U+2581 where the text itself has it, which keeps the round trip exact.

No piece has U+2581 behind another character, so segmentations fall apart before each run of blanks; these units are remembered. For
a model without that property a whole text is one unit.

Null or empty text: no ids; decoded: the empty text. Null doc_id stays null; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
FALLBACK = 10.0
#: Longer pieces at or below this score are never chosen in encoding, single characters count as the worst other piece; all can be decoded.
BARRED = -1e8
MEMORY = 500_000


class Pieces:
    """Encoder and decoder of one model. pieces: (text, score) of the ordinary pieces by id; byte_ids: the 256 byte pieces."""

    def __init__(self, pieces: dict[int, tuple[str, float]], byte_ids: list[int]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        worst = min((s for _, s in pieces.values() if s > BARRED), default=0.0)
        usable = {i: (p, s if s > BARRED else worst) for i, (p, s) in pieces.items() if s > BARRED or len(p) == 1}
        for i, (piece, score) in usable.items():
            self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.byte_ids = byte_ids
        self.unknown = worst - FALLBACK
        self.bytes_of = {i: p.replace(BLANK, " ").encode() for i, (p, _) in pieces.items()} | {b: bytes([n]) for n, b in enumerate(byte_ids)}
        self.score_of = {i: s for i, (_, s) in (pieces | usable).items()}
        parted = not any(BLANK in p.lstrip(BLANK) for p, _ in pieces.values())
        lines = not any("\n" in p for p, _ in pieces.values())
        self.unit = re.compile(rf"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n" if parted and lines else rf"{BLANK}*[^{BLANK}]+|{BLANK}+" if parted else r"(?s).+")
        self.memory: dict[str, bytes] = {}

    def viterbi(self, unit: str) -> list[int]:
        """Ids of the best segmentation of one unit."""
        n = len(unit)
        best = [0.0] + [float("-inf")] * n
        last: list[tuple[int, int]] = [(-1, 0)] * (n + 1)  # id (-1: bytes of a character) and where it begins
        done, unknown = 0, self.unknown

        def spell(to: int) -> None:  # positions up to `to` that only byte pieces may reach
            nonlocal done
            while done < to:
                done += 1
                if best[done - 1] + unknown > best[done]:
                    best[done] = best[done - 1] + unknown
                    last[done] = (-1, done - 1)

        for end, (i, size, score) in self.automaton.iter(unit):
            spell(end)
            at = end + 1
            total = best[at - size] + score
            if total > best[at]:
                best[at] = total
                last[at] = (i, at - size)
        spell(n)
        out: list[int] = []
        at = n
        while at:
            i, start = last[at]
            if i < 0:
                out.extend(self.byte_ids[b] for b in reversed(unit[start:at].encode()))
            else:
                out.append(i)
            at = start
        out.reverse()
        return out

    def _ids(self, unit: str) -> bytes:
        found = self.memory.get(unit)
        if found is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            found = array("I", self.viterbi(unit)).tobytes()
            if len(unit) < 64:
                self.memory[unit] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit bytes."""
        if not text:
            return b""
        own = array("I", [self.byte_ids[b] for b in BLANK.encode()]).tobytes()
        out = []
        for k, part in enumerate((" " + text).split(BLANK)):
            if k:
                out.append(own)
            out.extend([self._ids(u) for u in self.unit.findall(part.replace(" ", BLANK))])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in memoryview(ids).cast("I")])[1:].decode()

    def score(self, ids: bytes) -> tuple[float, int]:
        """Sum of the ordinary pieces' scores, and the number of byte pieces."""
        of, total, spelled = self.score_of, 0.0, 0
        for i in memoryview(ids).cast("I"):
            s = of.get(i)
            if s is None:
                spelled += 1
            else:
                total += s
        return total, spelled


@lru_cache(maxsize=2)
def load(model: str = MODEL) -> Pieces:
    """The model of that name; its path comes from the installed package of public tokenizers."""
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    ordinary = {i: (m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
    return Pieces(ordinary, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


def _encoder(model: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, rows = load(model), []
            for x in batch.column(1):
                text = x.as_py() or ""
                ids = pieces.encode(text)
                total, spelled = pieces.score(ids)
                rows.append((len(ids) // 4, spelled, total, zlib.crc32(ids), pieces.decode(ids) == text, np.frombuffer(ids, "<u4").astype(np.int32) if with_ids else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


RESULT = "doc_id long, n_ids long, n_byte_ids long, score double, ids_crc32 long, round_trip boolean, ids array<int>"


def encode(docs: DataFrame, model: str = MODEL, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of ids and of byte pieces among them, score, crc32 of the ids, whether decoding gives the text back, and ids."""
    out = mapped(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), _encoder(model, with_ids), RESULT)
    return out if with_ids else out.drop("ids")


def _decoder(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else load(model).decode(array("I", ids).tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    return mapped(encoded.select("doc_id", "ids"), _decoder(model), "doc_id long, text string")
