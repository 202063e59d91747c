"""Vectorised scanning of whole texts: word spans, word hashes and n-gram hashes over Arrow string columns.

Everything here works on the UTF-8 bytes of many documents at once. A *chunk* is a contiguous run of documents
of at most ``CHUNK_BYTES`` bytes (a longer document is a chunk of its own), so memory is bounded by the longest
document and not by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
U64 = np.uint64

_BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NGRAM = U64(0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}


def lut(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is True for the bytes in the inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Bytes of words that are separated by ASCII white space only.
SPACE_WORDS = ~lut((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words made of digits, lower-case letters and anything outside ASCII.
ALNUM_WORDS = ~lut((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _byte_values() -> np.ndarray:
    x = np.arange(1, 257, dtype=U64)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = _byte_values()


def powers(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << n.bit_length()
        grown = np.full(size, base, dtype=U64)
        grown[0] = 1
        np.multiply.accumulate(grown, out=grown)
        _powers[name] = have = grown
    return have[:n]


class Chunk:
    """A run of documents: ``data`` bytes, and where each document starts and ends in them."""

    def __init__(self, first: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.first, self.data, self.starts, self.ends = first, data, starts, ends
        self._prefix: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def lowered(self) -> Chunk:
        return Chunk(self.first, LOWER[self.data], self.starts, self.ends)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """The sum of a per-byte array over each document."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.ends] - total[self.starts]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of bytes for which ``inside`` holds, never crossing documents: starts and ends."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        before[self.starts[self.starts < n]] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        after[self.ends[self.ends > self.starts] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self, table: np.ndarray) -> Words:
        start, end = self.spans(table[self.data])
        return Words(self, start, end)

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans: a polynomial hash from prefix sums, finalised with the length."""
        if self._prefix is None:
            n = len(self.data)
            self._prefix = np.zeros(n + 1, dtype=U64)
            np.cumsum(BYTE_VALUES[self.data] * powers(_BASE, n, "base"), out=self._prefix[1:])
        inverse = powers(_BASE_INV, len(self.data) + 1, "inverse")
        return mix((self._prefix[end] - self._prefix[start]) * inverse[start] + (end - start).astype(U64))


class Words:
    """Word spans of a chunk, in order, with the document of each."""

    def __init__(self, chunk: Chunk, start: np.ndarray, end: np.ndarray):
        self.chunk, self.start, self.end = chunk, start, end
        self.doc = chunk.doc_of(start)
        self.first = np.searchsorted(start, chunk.starts)  # index of the first word of each document
        self.count = np.searchsorted(start, chunk.ends) - self.first

    def hashes(self) -> np.ndarray:
        return self.chunk.hash_spans(self.start, self.end)

    def ngram_ok(self, n: int) -> np.ndarray:
        """For each word, whether ``n`` words of its document start with it."""
        ok = np.zeros(len(self.doc), dtype=bool)
        if len(self.doc) >= n:
            ok[: len(self.doc) - n + 1] = self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1]
        return ok


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of every run of ``n`` hashes (len(h) - n + 1 of them, whatever documents they cross)."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, dtype=U64)
    for k in range(n):
        out = out * _NGRAM + h[k : len(h) - n + 1 + k]
    return mix(out)


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The documents of a string column, null as empty, in chunks."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield Chunk(i, raw[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i])
        i = j


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.ones(total, dtype=np.int64)
    at = np.cumsum(counts) - counts
    keep = counts > 0
    at, starts_k, counts_k = at[keep], starts[keep], counts[keep]
    step[at[0]] = starts_k[0]
    step[at[1:]] = starts_k[1:] - (starts_k[:-1] + counts_k[:-1] - 1)
    return np.cumsum(step)
