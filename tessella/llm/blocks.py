"""Counting keys over the whole corpus in blocks.

Rows are dealt to *blocks* of a few megabytes of text by a hash, so a hot source or a group of copies spreads out. A
block sends its distinct keys as sorted 64-bit arrays cut in *parts* by key range: one row with a binary payload (steps
between keys, compressed) for each block and part in which it has any, instead of one row per key. A part adds up what all blocks sent and answers each block in the
order of its keys. Hot keys cost one entry per block; a part holds a bounded share of a hash-uniform key space.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20


def count_blocks(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks the texts fill: one aggregation over the column."""
    total = documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / block_bytes))


def block_of(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def released(work, *inputs):
    """``work(*inputs)``, after which freed memory goes back to the system: workers live on between groups and stages, and
    would hold the most that any of them needed."""
    out = work(*inputs)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)
    return out


def pieces(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of sorted keys in ``parts`` equal ranges of the key space; only ranges that hold a key."""
    if len(keys):
        part = part_of(keys, parts)
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        yield from zip(part[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


_HEAD = struct.Struct("<QB")


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers, byte by byte of the width that the largest needs, compressed."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return _HEAD.pack(len(values), width) + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n, width = _HEAD.unpack_from(data)
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(data[_HEAD.size :], n * width), dtype=np.uint8).reshape(width, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def squeeze(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + pa.Codec("zstd", 1).compress(data, asbytes=True)


def expand(data: bytes) -> bytes:
    return pa.Codec("zstd", 1).decompress(data[8:], struct.unpack_from("<Q", data)[0], asbytes=True)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps."""
    return _pack(np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys)


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


pack_counts, unpack_counts = _pack, _unpack


def column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def single(table: pa.Table, name: str) -> pa.Array:
    """A column of a table as one array."""
    whole = table.column(name).combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], whole.type)


def add_up(payloads: list[bytes], counts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Packed sorted keys of several blocks and their counts: for each block's keys the total, and whether several blocks sent
    the key; and the totals of distinct keys."""
    keys = [unpack_keys(p) for p in payloads]
    flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    own = np.concatenate([unpack_counts(c) for c in counts]) if counts else np.zeros(0, np.uint64)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    del keys
    _, inverse, senders = np.unique(flat, return_inverse=True, return_counts=True)
    # Sums of whole numbers are exact in a double up to 2**53.
    totals = np.bincount(inverse, weights=own, minlength=0).astype(np.int64)
    return np.split(totals[inverse], ends), np.split(senders[inverse] > 1, ends), totals
