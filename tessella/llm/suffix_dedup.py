"""Removal of repeated byte strings over the whole corpus, by suffix arrays.

Every string of ``length`` bytes that also starts earlier (smaller doc_id, or earlier in the document) is removed;
strings are judged on the input. Which strings can repeat at all is narrowed first: the hash of a string's 32-byte piece
with the least hash, together with the piece beside it, is the string's *fingerprint*, equal wherever the string occurs,
and neighbouring strings mostly share it, so a document is a list of *runs* of strings with one fingerprint. Fingerprints
are counted over the corpus (see ``blocks``); runs whose fingerprint occurs once hold no repeated string and go no further.

The other runs meet by fingerprint. Equal runs are one *segment* with its earliest place; all other places of it are
repeats. Segments of a fingerprint that differ are cut down to strings all of whose 32-byte pieces occur again among
them; what is equal now is joined again, and what still differs is written one after another, their suffix array is built by linear
grouping construction (``suffix_array``), and strings that are equal are neighbours in it (an exact comparison of
neighbours follows); all but the earliest of each class are repeats. Repeats travel back to their documents as spans.

Documents are read through one exchange by block, which all three stages share. Hot passages cost one segment for
each different surrounding, not one per copy; as a fingerprint covers two pieces, surroundings that differ within 32 bytes
of a passage's edge go to different parts, and further ones don't reach into its strings' fingerprints at all.

Defined results: null and empty texts have 0 bytes and keep nothing; rows without doc_id stand before all others; rows
that repeat a doc_id are in the order of their texts' hashes, equal rows one after another; matches never cross
documents; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import blocks
from tessella.llm import textscan as ts
from tessella.llm.suffix_array import suffix_array

PIECE = 32
CHUNK = 1 << 18
BLOCK_BYTES = 4 << 20
PARTS_PER_BLOCK = 3
BATCH = 1 << 16  # bytes of segments in one suffix array; segments of one fingerprint stay together
REQUEST = "part bigint, block int, keys binary, counts binary"
ANSWER = "block int, part bigint, repeated binary"
_SEGMENT_COLUMNS = ("fingerprints", "lengths", "data", "segment", "doc_id", "doc_hash", "row", "start")
SEGMENTS = "part bigint, block int, " + ", ".join(f"{c} binary" for c in _SEGMENT_COLUMNS)
FLAGS = "block int, rows binary, starts binary, counts binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>"
_NEVER = np.iinfo(np.int64).min


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    m = 1
    while 2 * m <= width:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    rest = width - m
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(chunk: ts.Chunk, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one fingerprint: fingerprint, document of the chunk, first string's place in it, how many."""
    n = chunk.ends - chunk.starts
    fits = np.maximum(n - length + 1, 0)
    at = ts.ranges(chunk.starts, fits)
    if not len(at):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    h, base, m = ts.BYTE_VALUES[chunk.data], int(0x9E3779B97F4A7C15), 1
    while m < PIECE:
        h = h[:-m] * np.uint64(base) + h[m:]
        base, m = base * base % (1 << 64), 2 * m
    h = ts.mix(h)
    # The place in the low bits makes the leftmost least piece win, so a run has one piece and no string twice.
    bits = np.uint64(max(1, len(chunk.data).bit_length()))
    place = np.arange(len(h), dtype=np.uint64)
    least = sliding_min(h >> bits << bits | place, length - PIECE + 1)[at] & ((np.uint64(1) << bits) - np.uint64(1))
    doc, least = np.repeat(np.arange(len(chunk)), fits), least.astype(np.int64)
    # A piece of a common passage stands in strings with many different surroundings: what is before or after it in the
    # string, whichever is long enough, joins the fingerprint, so that these go different ways.
    offset = least - at
    side = np.where(offset >= PIECE, 0, np.where(offset <= length - 2 * PIECE, 1, 2))
    beside = least + np.array([-PIECE, PIECE, 0])[side]
    first = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (side[1:] != side[:-1])))
    key = ts.mix(h[least[first]] + ts.mix(h[beside[first]] + side[first].astype(np.uint64)))
    return key, doc[first], at[first] - chunk.starts[doc[first]], np.diff(np.append(first, len(at)))


def _all_runs(texts: pa.Array, length: int):
    for chunk in ts.chunks(texts, CHUNK):
        yield chunk, *runs(chunk, length)


def _ordered(docs: pa.Table) -> pa.Table:
    """Rows of a block in the order of documents, which is the same whenever it is asked for."""
    return docs.sort_by([("has_id", "ascending"), ("doc_id", "ascending"), ("doc_hash", "ascending")])


def _count(docs: pa.Table, length: int, parts: int) -> pa.Table:
    """The block's distinct fingerprints, and whether they occur once or more often."""
    found = [f for _, f, *_ in _all_runs(blocks.single(docs, "text"), length)]
    distinct, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    count = np.minimum(count, 2).astype(np.uint32)
    block, spans = docs.column("block")[0].as_py(), list(blocks.pieces(distinct, parts))
    return pa.table({"part": pa.array([p for p, _, _ in spans], pa.int64()), "block": pa.array([block] * len(spans), pa.int32()), "keys": pa.array([blocks.pack_keys(distinct[a:b]) for _, a, b in spans], pa.binary()), "counts": pa.array([blocks.pack_counts(count[a:b]) for _, a, b in spans], pa.binary())})


def _repeated(asked: pa.Table) -> pa.Table:
    answers, _, _ = blocks.add_up(blocks.column(asked, "keys"), blocks.column(asked, "counts"))
    return pa.table({"block": asked.column("block"), "part": asked.column("part"), "repeated": pa.array([np.packbits(a > 1).tobytes() for a in answers], pa.binary())})


def _segments(docs: pa.Table, answers: pa.Table, length: int, parts: int) -> pa.Table:
    """The block's runs with repeated fingerprints: distinct segments and their places, by part."""
    docs = _ordered(docs)
    ids = np.array([_NEVER if x is None else x for x in blocks.column(docs, "doc_id")], dtype=np.int64)
    hashes = np.array([0 if x is None else x for x in blocks.column(docs, "doc_hash")], dtype=np.int64)
    told = dict(zip(blocks.column(answers, "part"), blocks.column(answers, "repeated"), strict=True))
    texts = blocks.single(docs, "text")
    found = list(_all_runs(texts, length))
    distinct = np.unique(np.concatenate([f for _, f, *_ in found])) if found else np.zeros(0, np.uint64)
    again = [np.unpackbits(np.frombuffer(told[p], dtype=np.uint8), count=b - a).astype(bool) for p, a, b in blocks.pieces(distinct, parts)]
    repeated = distinct[np.concatenate(again)] if again else distinct
    known: dict[tuple[int, bytes], int] = {}
    segment, row, start = [], [], []
    for chunk, f, doc, at, n in found:
        where = np.searchsorted(repeated, f)
        where[where == len(repeated)] = 0
        keep = np.flatnonzero(repeated[where] == f) if len(repeated) else np.zeros(0, np.int64)
        data = chunk.data.tobytes()
        begin = chunk.starts[doc[keep]] + at[keep]
        for key, b, e in zip(f[keep].tolist(), begin.tolist(), (begin + n[keep] + length - 1).tolist(), strict=True):
            segment.append(known.setdefault((key, data[b:e]), len(known)))
        row.append(doc[keep] + chunk.first)
        start.append(at[keep])
    out: dict[str, list] = {"part": [], "block": [], **{c: [] for c in _SEGMENT_COLUMNS}}
    if known:
        fingerprint = np.array([k for k, _ in known], dtype=np.uint64)
        data = [d for _, d in known]
        order = np.argsort(fingerprint, kind="stable")
        spans = list(blocks.pieces(fingerprint[order], parts))
        new_number, piece_of = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        for k, (_, lo, hi) in enumerate(spans):
            piece_of[order[lo:hi]] = k
            new_number[order[lo:hi]] = np.arange(hi - lo)
        segment_, row_, start_ = np.array(segment), np.concatenate(row), np.concatenate(start)
        by_piece = np.argsort(piece_of[segment_], kind="stable")
        places = np.searchsorted(piece_of[segment_][by_piece], np.arange(len(spans) + 1))
        block = docs.column("block")[0].as_py()
        for k, (p, lo, hi) in enumerate(spans):
            own, at = order[lo:hi], by_piece[places[k] : places[k + 1]]
            values = (fingerprint[own], np.array([len(data[i]) for i in own], dtype=np.int32), b"".join(data[i] for i in own), new_number[segment_[at]].astype(np.int32), ids[row_[at]], hashes[row_[at]], row_[at].astype(np.int32), start_[at].astype(np.int32))
            for name, value in zip(out, (p, block, *(blocks.squeeze(v if isinstance(v, bytes) else v.tobytes()) for v in values)), strict=True):
                out[name].append(value)
    return pa.table(out, schema=pa.schema([("part", pa.int64()), ("block", pa.int32()), *((c, pa.binary()) for c in _SEGMENT_COLUMNS)]))


def repeats_among(segments: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of some segments that also start earlier in one of them: (segment, offset) pairs.

    ``docs`` numbers the documents of the segments in order, ``starts`` are the segments' places.
    """
    text = np.frombuffer(b"".join(x + b"\0" for x in segments), dtype=np.uint8).astype(np.int64) + 2
    sizes = np.array([len(x) + 1 for x in segments])
    ends = np.cumsum(sizes)
    text[ends - 1] = 1  # no byte of a segment
    order = suffix_array(text)
    owner = np.repeat(np.arange(len(segments)), sizes)
    fits = ends[owner] - 1 - np.arange(len(text)) >= length
    order = order[fits[order]]
    same = np.empty(len(order), dtype=bool)
    same[:1] = False
    view = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16), length)
    step = 1 << 14
    for at in range(1, len(order), step):
        hi = min(at + step, len(order))
        same[at:hi] = (view[order[at:hi]] == view[order[at - 1 : hi - 1]]).all(axis=1)
    classes = np.flatnonzero(~same)
    offset = order - (ends - sizes)[owner[order]]
    rank = (docs[owner[order]].astype(np.int64) << 32) + starts[owner[order]] + offset
    first = np.minimum.reduceat(rank, classes) if len(classes) else rank
    late = rank > np.repeat(first, np.diff(np.append(classes, len(order))))
    return owner[order[late]], offset[late]


def _spans(segment: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring offsets of each segment: segment, first offset, how many."""
    order = np.lexsort((offset, segment))
    segment, offset = segment[order], offset[order]
    first = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(segment) else np.zeros(0, np.int64)
    return segment[first], offset[first], np.diff(np.append(first, len(segment)))


def may_repeat(segments: list[bytes], group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of segments all of whose pieces occur again in their group, as runs: segment, first offset, how many.

    A string that occurs twice has pieces that do, so nothing is lost; strings across an edit or a unique surrounding
    go, and what is left of the copies of a passage is equal.
    """
    sizes = np.array([len(x) for x in segments])
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    h, base, m = ts.BYTE_VALUES[data], int(0x9E3779B97F4A7C15), 1
    while m < PIECE:
        h = h[:-m] * np.uint64(base) + h[m:]
        base, m = base * base % (1 << 64), 2 * m
    at = ts.ranges(begin, sizes - PIECE + 1)
    key = h[at] ^ np.repeat(ts.mix(group.astype(np.uint64) + np.uint64(1)), sizes - PIECE + 1)
    del h
    ordered = np.sort(key)
    often = ordered[1:][ordered[1:] == ordered[:-1]]
    del ordered
    often = often[np.append(True, often[1:] != often[:-1])] if len(often) else often
    place = np.searchsorted(often, key)
    place[place == len(often)] = 0
    twice = np.zeros(len(data), dtype=bool)
    if len(often):
        twice[at[often[place] == key]] = True
    del at, key, place
    fits = sizes - length + 1
    start = ts.ranges(begin, fits)
    good = np.ones(len(start), dtype=bool)
    for piece in (*range(0, length - PIECE, PIECE), length - PIECE):
        good &= twice[start + piece]
    which = np.repeat(np.arange(len(segments)), fits)
    return _spans(which[good], (start - begin[which])[good])


def _resolve(table: pa.Table, length: int) -> pa.Table:
    """A part's segments of all blocks: the repeated strings of each block, as (row, start, count)."""
    known: dict[tuple[int, bytes], int] = {}
    gathered: dict[str, list[np.ndarray]] = {c: [] for c in ("segment", "doc_id", "doc_hash", "row", "start", "from")}
    for k, r in enumerate(table.to_pylist()):
        r = {c: blocks.expand(r[c]) for c in _SEGMENT_COLUMNS}
        ends = np.cumsum(np.frombuffer(r["lengths"], dtype=np.int32)).tolist()
        number = np.array([known.setdefault((f, r["data"][b:e]), len(known)) for f, b, e in zip(np.frombuffer(r["fingerprints"], dtype=np.uint64).tolist(), [0, *ends[:-1]], ends, strict=True)], dtype=np.int64)
        gathered["segment"].append(number[np.frombuffer(r["segment"], dtype=np.int32)])
        for c, kind in (("doc_id", np.int64), ("doc_hash", np.int64), ("row", np.int32), ("start", np.int32)):
            gathered[c].append(np.frombuffer(r[c], dtype=kind).astype(np.int64))
        gathered["from"].append(np.full(len(gathered["row"][-1]), k))
    segment, doc_id, doc_hash, row, start, source = (np.concatenate(x) for x in gathered.values())
    order = np.lexsort((start, row, doc_hash, doc_id))
    segment, doc_id, doc_hash, row, start, source = (x[order] for x in (segment, doc_id, doc_hash, row, start, source))
    new_doc = np.append(False, (doc_id[1:] != doc_id[:-1]) | (doc_hash[1:] != doc_hash[:-1]) | (row[1:] != row[:-1]))
    doc = np.cumsum(new_doc)
    _, carrier = np.unique(segment, return_index=True)  # the first place of each segment in this order
    keys = list(known)
    count = np.array([len(d) for _, d in keys]) - length + 1
    later = np.ones(len(segment), dtype=bool)
    later[carrier] = False
    flagged = [(np.flatnonzero(later), np.zeros(int(later.sum()), np.int64), count[segment[later]])]  # place, offset, how many

    _, group, members = np.unique(np.array([f for f, _ in keys], dtype=np.uint64), return_inverse=True, return_counts=True)
    several = np.flatnonzero(members[group] > 1)
    if len(several):
        flagged += _among_groups([keys[i][1] for i in several.tolist()], group[several], carrier[several], doc, start, length)
    place, offset, n = (np.concatenate(x) for x in zip(*flagged, strict=True))
    block = np.array(blocks.column(table, "block"))
    out: dict[str, list] = {"block": [], "rows": [], "starts": [], "counts": []}
    for k in range(len(block)):
        own = source[place] == k
        for name, value in zip(out, (int(block[k]), row[place[own]].astype(np.int32).tobytes(), (start[place[own]] + offset[own]).astype(np.int32).tobytes(), n[own].astype(np.int32).tobytes()), strict=True):
            out[name].append(value)
    return pa.table(out, schema=pa.schema([("block", pa.int32()), ("rows", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary())]))


def _among_groups(data: list[bytes], group: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int):
    """Repeats among different segments of one fingerprint: (place, offset, how many).

    ``at`` is the first place of each segment, ``doc`` and ``start`` tell the order of places.
    """
    which, offset, n = may_repeat(data, group, length)
    rank = (doc[at[which]] << 32) + start[at[which]] + offset
    order = np.argsort(rank, kind="stable")
    which, offset, n = which[order], offset[order], n[order]
    # What is left may be equal now: the earliest stays.
    known: dict[tuple[int, bytes], int] = {}
    first: list[int] = []
    again: list[int] = []
    for k, (g, i, b, c) in enumerate(zip(group[which].tolist(), which.tolist(), offset.tolist(), n.tolist(), strict=True)):
        if known.setdefault((g, data[i][b : b + c + length - 1]), k) == k:
            first.append(k)
        else:
            again.append(k)
    yield at[which[again]], offset[again], n[again]

    first_ = np.array(first, dtype=np.int64)
    first_ = first_[np.argsort(group[which[first_]], kind="stable")]
    texts = {k: d for (_, d), k in known.items()}
    edges = np.flatnonzero(np.append(True, np.diff(group[which[first_]]) != 0)).tolist() + [len(first_)] if len(first_) else [0]
    batch: list[int] = []
    held = 0

    def repeats() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.array(batch)
        segment, inner = repeats_among([texts[k] for k in batch], doc[at[which[own]]], start[at[which[own]]] + offset[own], length)
        segment, inner, many = _spans(segment, inner)
        return at[which[own[segment]]], offset[own[segment]] + inner, many

    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        members = first_[lo:hi].tolist()
        if len(members) < 2:
            continue
        size = sum(len(texts[k]) for k in members)
        if batch and held + size > BATCH:
            yield repeats()
            batch, held = [], 0
        batch += members
        held += size
    if batch:
        yield repeats()


def _remove(docs: pa.Table, flags: pa.Table, length: int) -> pa.Table:
    docs = _ordered(docs)
    row, start, count = (np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, dtype=np.int32) for x in blocks.column(flags, c))]).astype(np.int64) for c in ("rows", "starts", "counts"))
    order = np.argsort(row, kind="stable")
    row, start, count = row[order], start[order], count[order]
    edge = np.searchsorted(row, np.arange(docs.num_rows + 1))
    out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")}
    for chunk in ts.chunks(blocks.single(docs, "text"), CHUNK):
        for d in range(len(chunk)):
            data = chunk.data[chunk.starts[d] : chunk.ends[d]]
            own = slice(edge[chunk.first + d], edge[chunk.first + d + 1])
            spans: list[dict] = []
            kept = data
            if own.stop > own.start:
                change = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(change, start[own], 1)
                np.add.at(change, start[own] + count[own] + length - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2)
                spans = [{"start": a, "end": b} for a, b in edges.tolist()]
                kept = data[~gone]
            for name, value in zip(out, (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept.tobytes()).hexdigest(), spans), strict=True):
                out[name].append(value)
    return pa.table({"doc_id": docs.column("doc_id"), **out}, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))


def remove_repeats(documents: DataFrame, *, length: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (bytes) of every document."""
    if length < 2 * PIECE:
        raise ValueError(f"length must be {2 * PIECE} at least")
    n = blocks.count_blocks(documents, block_bytes)
    parts = PARTS_PER_BLOCK * n
    docs = documents.select(blocks.block_of(n, "doc_id", "text").alias("block"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), F.xxhash64("text").alias("doc_hash"), "text")
    asked = docs.groupBy("block").applyInArrow(lambda t: blocks.released(_count, t, length, parts), REQUEST)
    told = asked.groupBy("part").applyInArrow(lambda t: blocks.released(_repeated, t), ANSWER)
    found = docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda d, a: blocks.released(_segments, d, a, length, parts), SEGMENTS)
    # As many partitions as parts: the work on a part is far more than its bytes tell.
    flags = found.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: blocks.released(_resolve, t, length), FLAGS)
    return docs.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(lambda d, f: blocks.released(_remove, d, f, length), RESULT)
