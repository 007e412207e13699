"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut where no merge can cross, each piece between cuts is merged once per worker and
remembered, and only counts leave: initial symbols minus merges, plus the extra bytes of symbols
that the vocabulary lacks. No token identifiers are made.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts

SPACE = "▁"
#: Pieces that a worker remembers, and the longest of them. Beyond that they are merged anew.
REMEMBERED, LONGEST = 1_500_000, 40


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """A byte-pair model in the .model format, as far as counting needs it."""

    NORMAL, USER, UNUSED = 1, 4, 5
    PAIRS = 2

    def __init__(self, path: str) -> None:
        pieces, trained, normal = [], {}, {}
        with open(path, "rb") as file:
            for number, value in _fields(file.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, self.NORMAL)))
                elif number == 2:
                    trained = dict(_fields(value))
                elif number == 3:
                    normal = dict(_fields(value))
        if trained.get(3) != self.PAIRS or not trained.get(35):
            raise ValueError("only byte-pair models with byte fallback are supported")
        if any(kind == self.USER for _, _, kind in pieces) or normal.get(1) != b"identity" or normal.get(4, 1):
            raise ValueError("only models without user symbols and with the identity normaliser are supported")
        self.prefix = bool(normal.get(3, 1))
        #: Smaller is merged earlier; equal ones from the left.
        self.rank = {text: -score for text, score, kind in pieces if kind in (self.NORMAL, self.UNUSED)}
        inner = any(a != SPACE and b == SPACE for text in self.rank for a, b in zip(text, text[1:], strict=False))
        line = any("\n" in text for text in self.rank)
        stop = "" if line else "\n"
        self.line = not line
        self.cut = None if inner else re.compile(f"{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+")
        #: Nor does a piece of such a vocabulary go on after a letter with anything else.
        crossing = re.compile(r"[^\W\d_][\W\d_]")
        self.finer = None if any(map(crossing.search, self.rank)) else re.compile(r"(?<=[^\W\d_])(?=[\W\d_])")
        self.known: dict[str, int] = _Counts(self)

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = (SPACE + text if self.prefix else text).replace(" ", SPACE)
        if self.cut is None:
            return self.merged(marked)
        return sum(map(self.known.__getitem__, self.cut.findall(marked))) + (text.count("\n") if self.line else 0)

    def uncut(self, piece: str) -> int:
        """Tokens of a piece that is not known yet."""
        parts = self.finer.split(piece) if self.finer else [piece]
        return self.merged(piece) if len(parts) == 1 else sum(map(self.known.__getitem__, parts))

    def merged(self, text: str) -> int:
        """Tokens of a text that is merged as a whole."""
        rank, n = self.rank, len(text)
        symbols: list[str] = list(text)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[pair], i, i + 1, pair) for i in range(n - 1) if (pair := text[i : i + 2]) in rank]
        heapify(heap)
        count = n
        while heap:
            _, i, j, pair = heappop(heap)
            a, b = symbols[i], symbols[j]
            if not a or not b or len(a) + len(b) != len(pair):
                continue  # one of the two has since been merged
            symbols[i], symbols[j] = pair, ""
            count -= 1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                longer = pair + symbols[k]
                if longer in rank:
                    heappush(heap, (rank[longer], i, k, longer))
            k = left[i]
            if k >= 0:
                longer = symbols[k] + pair
                if longer in rank:
                    heappush(heap, (rank[longer], k, i, longer))
        return count + sum(len(s.encode()) - 1 for s in symbols if len(s) == 1 and s not in rank)


class _Counts(dict):
    """Counts of pieces that have been merged before."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model

    def __missing__(self, piece: str) -> int:
        count = self.model.uncut(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = count
        return count


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def token_counts(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of df: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    vocabulary: path of a byte-pair .model file, there on every executor. Special strings in a text are
    ordinary text; nothing is added or cut off. Null and empty texts have 0 bytes and 0 tokens; a text of
    any length is counted whole. Repeated rows and null ids give a row each; other columns are ignored;
    an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(vocabulary)
        for batch in batches:
            rows = texts(batch.column(1))
            tokens = [model.count(t) for t in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in rows], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(id_col, text_col).mapInArrow(counts, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
