"""Token ids in binary form, packed by best fit decreasing.

Texts become ids of a public byte-level BPE vocabulary, each document ends with the end token, and pieces are packed
into rows of ``width`` ids: documents longer than a row are split into full rows and a rest (nothing is dropped), the
pieces are taken longest first, and each goes to the row with the least room that still holds it. Rows by room are
kept in a segment tree over capacities, so a piece costs O(log width).

Packing is done on blocks of at most ``block_tokens`` ids, which a task fills one after another while it streams its
documents: the plan is one narrow Arrow stage, a task holds one block, and a hot source or a very long document
changes nothing. Each block has at most one row that is less than half full more than the optimum needs, so with
blocks of a thousand rows the loss is under a tenth of a per cent.

A result row is a packed row: ``ids`` (little-endian ids of ``width`` slots, padded with the end token), ``n_ids``,
``doc_ids`` and ``offsets`` (which document, from which of its ids on, each segment holds), ``cu_seqlens``
(cumulative segment lengths, from 0) and ``resets`` (slots at which position ids start again at 0, with the start of
the padding if there is any).

Defined results: null and empty texts are the end token alone, so every document is in the output; repeated rows are
packed each; special token strings in a text are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pre-tokenisation pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
CACHE_UNITS = 400_000
_UNSAFE = re.compile(r" \s|\s ")

SCHEMA = "ids binary, n_ids int, doc_ids array<bigint>, offsets array<bigint>, cu_seqlens array<int>, resets array<int>"
_ARROW = pa.schema([("ids", pa.binary()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32()))])


class Encoder:
    """Text to ids. Units between single spaces are encoded once and remembered, at most ``CACHE_UNITS`` of them.

    The pre-tokeniser always cuts before a space that has no white space beside it, so a text without such runs is
    the concatenation of its units, each with its space; other texts are encoded in one piece.
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.n_vocab = max(ranks.values()) + 1
        self.cache: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        if len(self.cache) >= CACHE_UNITS:
            self.cache.clear()
        ids = np.array(self.bpe.encode_ordinary(" " + unit), dtype="<u4").tobytes()
        self.cache[unit] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        if _UNSAFE.search(text) or text[0] == " " or text[-1] == " ":
            return np.array(self.bpe.encode_ordinary(text), dtype="<u4")
        first, *rest = text.split(" ")
        head = np.array(self.bpe.encode_ordinary(first), dtype="<u4").tobytes()
        known = self.cache.get
        parts = [known(u) or self._unit(u) for u in rest]
        return np.frombuffer(head + b"".join(parts), dtype="<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class CapacityTree:
    """Which amounts of room have open rows: the smallest amount that is at least what is asked for."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.open = [0] * (2 * self.size)  # open rows under each node
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.open[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the tightest open row, no longer open."""
        at, open_ = need + self.size, self.open
        if not open_[at]:
            while at > 1 and (at & 1 or not open_[at + 1]):  # up until a right neighbour has rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if open_[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        while at:
            open_[at] -= 1
            at >>= 1
        return room, row


def best_fit_decreasing(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Rows of piece numbers, each of at most ``width`` in all."""
    tree, rows = CapacityTree(width), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[piece])
        found = tree.take(n)
        if found is None:
            rows.append([piece])
            room, row = width, len(rows) - 1
        else:
            room, row = found
            rows[row].append(piece)
        if room > n:
            tree.add(room - n, row)
    return rows


def pack_block(ids: list[np.ndarray], docs: list, width: int, end: int) -> pa.RecordBatch:
    """Packed rows of some documents' ids."""
    piece_doc, piece_at, lengths = [], [], []
    for d, x in enumerate(ids):
        for at in range(0, len(x), width):
            piece_doc.append(d)
            piece_at.append(at)
            lengths.append(min(width, len(x) - at))
    out: list[list] = [[] for _ in _ARROW]
    for row in best_fit_decreasing(np.array(lengths, dtype=np.int64), width):
        slots = np.full(width, end, dtype="<u4")
        sums = [0]
        for p in row:
            slots[sums[-1] : sums[-1] + lengths[p]] = ids[piece_doc[p]][piece_at[p] : piece_at[p] + lengths[p]]
            sums.append(sums[-1] + lengths[p])
        resets = sums[:-1] + ([sums[-1]] if sums[-1] < width else [])
        for column, value in zip(out, (slots.tobytes(), sums[-1], [docs[piece_doc[p]] for p in row], [piece_at[p] for p in row], sums, resets), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _ARROW, strict=True)], schema=_ARROW)


def _pack(batches: Iterator[pa.RecordBatch], width: int, vocabulary: str, end: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    code = encoder(vocabulary)
    ids, docs, n = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.append(code.encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
            if n and n + len(x) > block_tokens:
                yield pack_block(ids, docs, width, end)
                ids, docs, n = [], [], 0
            ids.append(x)
            docs.append(doc)
            n += len(x)
    if ids:
        yield pack_block(ids, docs, width, end)


def pack_documents(documents: DataFrame, *, width: int = 2048, vocabulary: str = VOCABULARY, end: int = END, block_tokens: int = 2 << 20) -> DataFrame:
    """Packed rows of all documents; see the module's text."""
    from pyspark.sql import functions as F

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda b: _pack(b, width, vocabulary, end, block_tokens), SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Parquet files of packed rows: fixed-width id rows beside their segment tables. ``matrix`` reads them."""
    packed.write.parquet(path)


def matrix(rows: pa.Table, width: int) -> np.ndarray:
    """The ids of some packed rows as one matrix of ``width`` columns."""
    held = rows.column("ids").combine_chunks()
    parts = held.chunks if isinstance(held, pa.ChunkedArray) else [held]
    flat = [np.frombuffer(x.as_buffer(), dtype="<u4") for part in parts for x in part]
    return np.stack(flat) if flat else np.zeros((0, width), "<u4")


def position_ids(resets: list[int], width: int) -> np.ndarray:
    """The position of every slot in its segment."""
    out = np.arange(width)
    starts = np.array(resets)
    return out - starts[np.searchsorted(starts, out, side="right") - 1]
