"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton finds every vocabulary piece in a text; dynamic programming over the end positions carries the
best score and, with it, the number of pieces. The tie rule is that of unigram tokenizers: pieces are added in order of
their start, and only a greater score replaces what is there, so of equals the earliest start (the longest last piece)
stays. A sign that is no piece is unknown at the least score less 10; adjacent unknown signs are one piece, or with byte
fallback a piece for each byte.

White space is written as U+2581, and one stands before the text. Where no piece holds a U+2581 after another sign, the
best division of a text is that of its parts, each of which begins with a run of U+2581; scores are whole numbers, or sums
are exact for another reason, so that parts can be counted once and remembered. Otherwise texts are counted whole.

Defined results: a null text counts as empty, of 0 pieces; texts of any length are counted whole; only the id and the text
are read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import each, text_of

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Parts that a worker remembers; cleared when full. Bounds memory only.
REMEMBERED = 300_000


class UnigramCounter:
    """``pieces``: (piece, score) in order of ids. ``unknown``: id of the unknown piece, which is no match by itself."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.longest = max(map(len, names), default=1)
        self.single = {p for p in names if len(p) == 1}
        self.unknown_score = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.parts_apart = all(SPACE not in p.lstrip(SPACE) for p in names) and all(float(s).is_integer() for _, s in pieces)
        self.part = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
        self.known: dict[str, int] = {}

    def count_part(self, text: str) -> int:
        """Pieces of the best division of ``text``, as it stands. Of the ends so far, only as many are kept as the longest piece
        reaches back."""
        m, single, least = self.longest + 1, self.single, self.unknown_score
        # of each end: best score, pieces, whether the last is unknown
        scores, counts, unknown = [0.0] * m, [0] * m, [False] * m
        matches = self.automaton.iter(text)  # by their ends, and of one end the longest first
        last, match = next(matches, (-1, None))
        for end, sign in enumerate(text, 1):
            best = None
            while last == end - 1:
                length, score = match
                before = (end - length) % m
                total = scores[before] + score
                if best is None or total > best:
                    best, n = total, counts[before] + 1
                last, match = next(matches, (-1, None))
            own = end % m
            unknown[own] = False
            if sign not in single:
                before = (end - 1) % m
                total = scores[before] + least
                if best is None or total > best:
                    best, unknown[own] = total, True
                    n = counts[before] + (len(sign.encode("utf-8", "replace")) if self.bytes else not unknown[before])
            scores[own], counts[own] = best, n
        return counts[len(text) % m]

    def count(self, text: str) -> int:
        """Pieces of a text, after a leading U+2581 and the replacement of spaces."""
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.parts_apart:
            return self.count_part(marked)
        known, total = self.known, 0
        for part in self.part.findall(marked):
            n = known.get(part)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[part] = self.count_part(part)
            total += n
        return total


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _message(data: bytes):
    """(field, value) of a protocol buffer message: numbers, or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece model file, whatever its kind, in order of ids."""
    import struct

    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _message(data):
        if number == 1:
            piece = dict(_message(value))
            out.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0))
    return out


@lru_cache(maxsize=2)
def _counter(digest: str, pieces: tuple, byte_fallback: bool) -> UnigramCounter:
    return UnigramCounter(list(pieces), byte_fallback)


def count_tokens(df: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text", byte_fallback: bool = True) -> DataFrame:
    """``id_col``, ``n_tokens`` and ``n_chars`` of every row."""
    key = hashlib.sha256(repr((pieces, byte_fallback)).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(tuple(pieces))
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), text_of(text_col).alias("__text"))

    def run(batches):
        counter = _counter(key, shared.value, byte_fallback)
        for batch in batches:
            counts = [(counter.count(t), len(t)) for t in each(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)]], names=[id_col, "n_tokens", "n_chars"])
        counter.known.clear()  # a worker outlives its tasks

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, n_chars long")
