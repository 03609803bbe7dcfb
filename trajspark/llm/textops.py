"""Whole-batch tokenising with numpy: word boundaries and 64-bit hashes of words for a column of Arrow strings.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D); A-Z is lower-cased, other letters are left as
they are. Nothing is cut: a batch is worked through in pieces of about a quarter of a megabyte that end at word boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
PIECE = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: everything in ASCII but letters and digits separates words; bytes of other characters belong to words
MARKS = np.ones(256, dtype=bool)
MARKS[128:] = False
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
BYTES = mix((np.arange(1, 257, dtype=U64)) * U64(0x9E3779B97F4A7C15))
POWER = np.full(PIECE + 1, _BASE, dtype=U64)
INVERSE = np.full(PIECE + 1, pow(_BASE, -1, 1 << 64), dtype=U64)
POWER[0] = INVERSE[0] = 1
np.multiply.accumulate(POWER, out=POWER)
np.multiply.accumulate(INVERSE, out=INVERSE)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in a row, and the n + 1 offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a batch: row of each (ascending), start and end byte in `bytes` (lower-cased)."""

    def __init__(self, column: pa.Array, blank: np.ndarray = SPACE):
        raw, self.offsets = string_bytes(column)
        self.rows = len(self.offsets) - 1
        self.raw, self.bytes = raw, LOWER[raw]
        space = blank[raw]
        first, last = ~space, ~space
        if len(raw):
            first[1:] &= space[:-1]
            last[:-1] &= space[1:]
            edges = self.offsets[(self.offsets < len(raw))]
            first[edges] |= ~space[edges]
            edges = self.offsets[self.offsets > 0] - 1
            last[edges] |= ~space[edges]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.count = np.bincount(self.row, minlength=self.rows)

    def pieces(self) -> Iterator[tuple[int, int]]:
        i, n = 0, len(self.start)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + PIECE, side="right")))
            yield i, j
            i = j

    def hashes(self, first: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first bytes (at most `first`)."""
        out = np.empty(len(self.start), dtype=U64)
        for i, j in self.pieces():
            base = self.start[i]
            s, e = self.start[i:j] - base, self.end[i:j] - base
            if first is not None:
                e = np.minimum(e, s + first)
            if e[-1] > PIECE:  # one word longer than a piece
                word = self.bytes[base : base + e[-1]].tobytes()
                out[i:j] = xxhash.xxh64_intdigest(word)
                continue
            part = self.bytes[base : base + e[-1]]
            with np.errstate(over="ignore"):
                total = np.zeros(len(part) + 1, dtype=U64)
                np.cumsum(BYTES[part] * POWER[: len(part)], out=total[1:])
                out[i:j] = mix((total[e] - total[s]) * INVERSE[s] + (e - s).astype(U64))
        return out


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word n-grams of every row, sorted by row and hash.

    A row with fewer words than `width`, but one at least, has its whole word sequence as its only shingle.
    """
    h = words.hashes()
    n = len(h)
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    if n >= width:
        same = words.row[: n - width + 1] == words.row[width - 1 :]
        at = np.flatnonzero(same)
        with np.errstate(over="ignore"):
            gram = np.full(len(at), width, dtype=U64)
            for k in range(width):
                gram = mix(gram * U64(0x2545F4914F6CDD1D) + h[at + k])
        row = words.row[at]
    else:
        gram, row = np.zeros(0, U64), np.zeros(0, np.int64)
    if len(short):
        first = np.searchsorted(words.row, short)
        extra = np.empty(len(short), dtype=U64)
        for i, (r, at) in enumerate(zip(short, first, strict=True)):
            with np.errstate(over="ignore"):
                x = np.full(1, int(words.count[r]), dtype=U64)
                for k in range(words.count[r]):
                    x = mix(x * U64(0x2545F4914F6CDD1D) + h[at + k : at + k + 1])
            extra[i] = x[0]
        gram, row = np.concatenate([gram, extra]), np.concatenate([row, short])
    order = np.lexsort((gram, row)) if len(gram) else np.zeros(0, np.int64)
    gram, row = gram[order], row[order]
    if len(gram):
        keep = np.ones(len(gram), dtype=bool)
        keep[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
        gram, row = gram[keep], row[keep]
    return row, gram


def batches(column: str, stream: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text (a single longer text makes its own)."""
    for batch in stream:
        if not batch.num_rows:
            continue
        _, at = string_bytes(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
