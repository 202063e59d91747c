"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` turns all documents into postings once: a row of the index is a *shard* of a few megabytes of text, with
the positions of every word by term, and is stored in the shared folder. The index is queried with the benchmark's
windows. How often each of their terms occurs in the whole corpus is added up over the shards first; a window's posting
lists are then intersected from its globally rarest term on, each list shifted by the term's offset in the window. With
``slop`` > 0 the same walk also yields proximity matches: there is a place in the document such that every term of the
window stands within ``slop`` words of where it would stand from there.

The benchmark is the stated query set. Its windows are packed on the driver in blocks of at most ``block_windows``
windows, in which a long item may be cut; each block is a separate pass over the index and passes are merged per document,
so what is sent to executors at once is bounded whatever the size of the benchmark or of an item. Neither texts nor
postings are shuffled. Words are told apart by 64-bit hashes, so an exact match of n words is n equal hashes in a row.

Defined results: a null or empty document has no words and is never hit; a null item is ignored; an item with
fewer words than ``width`` is one window; repeated items each count under their own item_id, repeated rows of the
same item_id count once; rows of documents are answered one by one, so repeated rows repeat; other columns of
either table are ignored.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tessella.llm import blocks
from tessella.llm import textscan as ts
from tessella.storage import files_for, materialize

INDEX = "shard bigint, doc_ids array<bigint>, n_words binary, terms binary, frequency binary, steps binary"
SPANS = "array<struct<start:bigint,end:bigint>>"
HITS = f"shard bigint, doc bigint, doc_id bigint, n_words bigint, n_hit bigint, hit_spans {SPANS}, items array<string>, near_items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
HITS_ARROW = pa.schema([("shard", pa.int64()), ("doc", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit_spans", _SPANS), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])


@dataclass
class Windows:
    """Distinct windows of some items: term numbers of each, the items that have it, and the sorted hashes of all terms."""

    terms: np.ndarray  # sorted distinct word hashes
    length: np.ndarray  # of each window, in words
    term: np.ndarray  # windows x width: term numbers, -1 beyond the length
    names: pa.Array  # item ids, sorted
    first: np.ndarray  # of each window, where its items begin in ``item``; one more for the end
    item: np.ndarray  # numbers of names
    order: np.ndarray | None = None  # windows x width: offsets, globally rarest term first

    def pairs(self, window: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, item) of matches, sorted."""
        many = np.diff(self.first)[window]
        found = np.unique(np.repeat(doc, many) * (len(self.names) + 1) + self.item[ts.ranges(self.first[window], many)])
        return found // (len(self.names) + 1), found % (len(self.names) + 1)


def _windows_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` hashes and the length: one row if there are fewer words."""
    if len(hashes) >= width:
        seen = np.lib.stride_tricks.sliding_window_view(hashes, width)
        return np.column_stack([seen, np.full(len(seen), width, np.uint64)])
    return np.concatenate([hashes, np.zeros(width - len(hashes), np.uint64), [np.uint64(len(hashes))]]).astype(np.uint64)[None]


def build_windows(rows: np.ndarray, names: list[str], of: np.ndarray) -> Windows:
    """Distinct windows from rows of hashes and lengths, each of the item ``names[of]``."""
    width = rows.shape[1] - 1
    known = sorted(set(names))
    place = {n: k for k, n in enumerate(known)}
    rank = np.array([place[n] for n in names], dtype=np.int64)
    distinct, number = np.unique(rows, axis=0, return_inverse=True)
    both = np.unique(number.reshape(-1) * len(known) + rank[of])
    length = distinct[:, width].astype(np.int64)
    inside = np.arange(width) < length[:, None]
    terms = np.unique(distinct[:, :width][inside])
    term = np.where(inside, np.searchsorted(terms, distinct[:, :width]), -1)
    return Windows(terms, length, term, pa.array(known, pa.string()), np.searchsorted(both // len(known), np.arange(len(distinct) + 1)), both % len(known))


class PositionalIndex:
    """Postings of some documents for the terms of a benchmark. Positions count all words of the documents."""

    def __init__(self, term: np.ndarray, positions: np.ndarray, n_terms: int, n_words: int):
        """Postings sorted by term, then position."""
        self.size = n_words + 1
        self.positions = positions
        self.keys = term * self.size + positions
        self.first = np.searchsorted(term, np.arange(n_terms + 1))
        self.frequency = np.diff(self.first)

    @classmethod
    def of_words(cls, words: ts.Words, terms: np.ndarray) -> PositionalIndex:
        h = words.hashes()
        at = np.searchsorted(terms, h)
        at[at == len(terms)] = 0
        where = np.flatnonzero(terms[at] == h) if len(terms) else np.zeros(0, np.int64)
        order = np.argsort(at[where], kind="stable")
        return cls(at[where][order], where[order], len(terms), len(h))

    @classmethod
    def of_shard(cls, shard: dict, n_words: int, terms: np.ndarray) -> PositionalIndex:
        """The postings of the asked terms among those that a shard stores."""
        number, begin, many = _asked(shard, terms)
        steps = np.cumsum(blocks.unpack_counts(shard["steps"]).astype(np.int64))  # each list starts anew
        at = ts.ranges(begin, many)
        positions = steps[at] - np.repeat(np.where(begin > 0, steps[begin - 1], 0), many) if len(at) else np.zeros(0, np.int64)
        return cls(np.repeat(number, many), positions, len(terms), n_words)

    def within(self, term: np.ndarray, position: np.ndarray, slop: int) -> np.ndarray:
        """Whether the term has a posting within ``slop`` of the position."""
        if not len(self.keys):
            return np.zeros(len(term), dtype=bool)
        lo = np.maximum(position - slop, 0)
        at = np.searchsorted(self.keys, term * self.size + lo)
        at_safe = np.minimum(at, len(self.keys) - 1)
        key = self.keys[at_safe]
        return (at < len(self.keys)) & (key <= term * self.size + np.minimum(position + slop, self.size - 1)) & (position + slop >= 0)

    def match(self, windows: Windows, doc: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start position, position of its rarest term) of every match. A start of a proximity match may lie outside of the document."""
        width = windows.term.shape[1]
        inside = windows.term >= 0
        order = rarest_first(windows, self.frequency) if windows.order is None else windows.order
        rare = order[:, 0]
        row = np.arange(len(windows.length))
        anchor = windows.term[row, rare]
        counts = self.frequency[anchor]
        window = np.repeat(row, counts)
        start = self.positions[ts.ranges(self.first[anchor], counts)] - np.repeat(rare, counts)
        n = len(doc)
        own = start + rare[window]
        if slop:  # the rarest term itself may be off its place
            shifts = np.arange(-slop, slop + 1)
            window, own, start = np.repeat(window, len(shifts)), np.repeat(own, len(shifts)), (start[:, None] + shifts).reshape(-1)
        if not slop:
            end = start + windows.length[window] - 1
            keep = (start >= 0) & (end < n)
            keep[keep] = doc[start[keep]] == doc[end[keep]]
            window, start, own = window[keep], start[keep], own[keep]
        for k in range(1, width):
            if not len(window):
                break
            offset = order[window, k]
            used = inside[window, offset]
            ok = ~used
            term, place = windows.term[window[used], offset[used]], (start + offset)[used]
            ok[used] = self.within(term, place, slop)
            if slop:  # a posting in a neighbouring document is no match
                ok[used] &= self._same_document(term, place, own[used], doc, slop)
            window, start, own = window[ok], start[ok], own[ok]
        return window, start, own

    def _same_document(self, term: np.ndarray, place: np.ndarray, own: np.ndarray, doc: np.ndarray, slop: int) -> np.ndarray:
        found = np.zeros(len(term), dtype=bool)
        for d in range(-slop, slop + 1):
            p = place + d
            legal = (p >= 0) & (p < len(doc))
            legal[legal] = doc[p[legal]] == doc[own[legal]]
            legal[legal] = self.within(term[legal], p[legal], 0)
            found |= legal
        return found


def rarest_first(windows: Windows, frequency: np.ndarray) -> np.ndarray:
    often = np.where(windows.term >= 0, frequency[np.maximum(windows.term, 0)] if len(frequency) else 0, np.iinfo(np.int64).max)
    return np.argsort(often, axis=1, kind="stable")


def _asked(shard: dict, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the asked terms that a shard has, and where their postings begin and how many they are."""
    own, many = blocks.unpack_keys(shard["terms"]), blocks.unpack_counts(shard["frequency"]).astype(np.int64)
    at = np.searchsorted(own, terms)
    at[at == len(own)] = 0
    number = np.flatnonzero(own[at] == terms) if len(own) else np.zeros(0, np.int64)
    begin = np.cumsum(many) - many
    return number, begin[at[number]], many[at[number]]


# The index


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 32
    schema = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("n_words", "terms", "frequency", "steps"))])
    for batch in batches:
        for chunk in ts.chunks(batch.column(1)):
            words = chunk.lowered().words(ts.ALNUM_WORDS)
            h = words.hashes()
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, np.int64)
            steps = np.diff(order, prepend=0)
            steps[first] = order[first]
            ids = pa.array([batch.column(0).slice(chunk.first, len(chunk)).cast(pa.int64()).to_pylist()], pa.list_(pa.int64()))
            packed = (blocks.pack_counts(words.count), blocks.pack_keys(h[order][first]), blocks.pack_counts(np.diff(np.append(first, len(h)))), blocks.pack_counts(steps))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), ids, *(pa.array([x], pa.binary()) for x in packed)], schema=schema)
            shard += 1


def build_index(documents: DataFrame) -> DataFrame:
    """The stored index of all documents: a row per shard."""
    return materialize(documents.select("doc_id", "text").mapInArrow(_post, INDEX), "postings", files_for(documents))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(j)[k].as_py() if name in ("shard", "doc_ids") else batch.column(j)[k].as_buffer().to_pybytes() for j, name in enumerate(batch.schema.names)}


def term_frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of some terms occurs in the whole corpus; ``terms`` are those of one block of windows."""
    held = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), dtype=np.int64)
        for shard in _shards(batches):
            number, _, many = _asked(shard, held.value)
            total[number] += many
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["term", "n"])

    out = np.zeros(len(terms), dtype=np.int64)
    sums = index.select("terms", "frequency").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return out


# Queries


def _lists(doc: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """A list per document from values sorted by document."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), values)


def _query(batches: Iterator[pa.RecordBatch], windows: Windows, slop: int, every: bool) -> Iterator[pa.RecordBatch]:
    """HITS of each document of each shard; of documents without a hit only if ``every``."""
    for shard in _shards(batches):
        count = blocks.unpack_counts(shard["n_words"]).astype(np.int64)
        n, first = len(count), np.cumsum(count) - count
        doc = np.repeat(np.arange(n), count)
        index = PositionalIndex.of_shard(shard, len(doc), windows.terms)
        window, start, own = index.match(windows, doc, 0) if len(index.positions) else [np.zeros(0, np.int64)] * 3
        delta = np.zeros(len(doc) + 1, dtype=np.int64)
        np.add.at(delta, start, 1)
        np.add.at(delta, start + windows.length[window], -1)
        hit = np.cumsum(delta[:-1]) > 0
        new = hit & np.concatenate(([True], ~hit[:-1] | (doc[1:] != doc[:-1]))) if len(hit) else hit
        last = hit & np.concatenate((~hit[1:] | (doc[1:] != doc[:-1]), [True])) if len(hit) else hit
        begin, end = np.flatnonzero(new), np.flatnonzero(last) + 1
        spans = pa.StructArray.from_arrays([pa.array(begin - first[doc[begin]], pa.int64()), pa.array(end - first[doc[begin]], pa.int64())], names=["start", "end"])
        in_doc, item = windows.pairs(window, doc[start])
        near_doc, near = in_doc, item
        if slop and len(index.positions):
            window, _, own = index.match(windows, doc, slop)  # exact matches are among those of any slop
            near_doc, near = windows.pairs(window, doc[own])
        columns = [pa.array(np.full(n, shard["shard"]), pa.int64()), pa.array(np.arange(n), pa.int64()), pa.array(shard["doc_ids"], pa.int64()), pa.array(count, pa.int64()), pa.array(np.bincount(doc[hit], minlength=n), pa.int64()), _lists(doc[begin], spans, n), _lists(in_doc, windows.names.take(pa.array(item)), n), _lists(near_doc, windows.names.take(pa.array(near)), n)]
        out = pa.RecordBatch.from_arrays(columns, schema=HITS_ARROW)
        yield out if every else out.take(pa.array(np.unique(np.concatenate([in_doc, near_doc]))))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several passes joined, and n_hit counted anew."""
    for batch in batches:
        lists = batch.column(5)
        doc = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()).astype(np.int64))
        flat = lists.flatten()
        start, end = (np.asarray(flat.field(k)).astype(np.int64) for k in range(2))
        order = np.lexsort((end, start, doc))
        doc, start, end = doc[order], start[order], end[order]
        far = int(end.max()) + 2 if len(end) else 1
        reach = np.maximum.accumulate(end + doc * far) if len(end) else end
        new = np.append(True, start[1:] + doc[1:] * far > reach[:-1]) if len(end) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        stop = reach[np.append(begin[1:], len(end)) - 1] - doc[begin] * far if len(end) else end
        spans = pa.StructArray.from_arrays([pa.array(start[begin], pa.int64()), pa.array(stop, pa.int64())], names=["start", "end"])
        n_hit = np.bincount(doc[begin], weights=stop - start[begin], minlength=batch.num_rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n_hit, pa.int64()), _lists(doc[begin], spans, batch.num_rows), *batch.columns[6:]], schema=HITS_ARROW)


def benchmark_blocks(benchmark: DataFrame, width: int, block_windows: int) -> Iterator[Windows]:
    """The benchmark's windows, a block at a time. Items stream through the driver; one block is held."""
    rows, names, of, n = [], [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").toLocalIterator():
        (chunk,) = ts.chunks(pa.array([row.text]))
        hashes = chunk.lowered().words(ts.ALNUM_WORDS).hashes()
        if not len(hashes):
            continue
        own, at = _windows_of(hashes, width), 0
        while at < len(own):
            piece = own[at : at + block_windows - n]
            rows.append(piece)
            of.append(np.full(len(piece), len(names)))
            names.append(row.item_id)
            at, n = at + len(piece), n + len(piece)
            if n >= block_windows:
                yield build_windows(np.concatenate(rows), names, np.concatenate(of))
                rows, names, of, n = [], [], [], 0
    if rows:
        yield build_windows(np.concatenate(rows), names, np.concatenate(of))


def query_index(index: DataFrame, benchmark: DataFrame, *, width: int = 8, slop: int = 0, block_windows: int = 2_000_000) -> DataFrame:
    """HITS for every document of an index."""
    shared, passes = index.sparkSession.sparkContext, []
    empty = Windows(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.full((0, width), -1), pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.int64))
    for k, block in enumerate(itertools.chain(benchmark_blocks(benchmark, width, block_windows), [None])):
        if block is None and passes:
            break
        block = block or empty
        if len(block.terms):
            block.order = rarest_first(block, term_frequencies(index, block.terms))
        held = shared.broadcast(pickle.dumps(block))  # at most block_windows windows
        passes.append(index.mapInArrow(lambda batches, held=held, first=k == 0: _query(batches, pickle.loads(held.value), slop, first), HITS))
    if len(passes) == 1:
        return passes[0]
    joined = passes[0]
    for one in passes[1:]:
        joined = joined.unionByName(one)
    same = [F.first(c).alias(c) for c in ("doc_id", "n_words", "n_hit")]
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("hit_spans", "items", "near_items")]
    sets = [F.array_sort(F.array_distinct(c)).alias(c) for c in ("items", "near_items")]
    return joined.groupBy("shard", "doc").agg(*same, *lists).select("shard", "doc", "doc_id", "n_words", "n_hit", "hit_spans", *sets).mapInArrow(_merged, HITS)


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, width: int = 8, slop: int = 0, min_items: int = 2, block_windows: int = 2_000_000) -> DataFrame:
    """For each document: n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (word intervals), items, near_items.

    ``contaminated`` means that windows of ``min_items`` items or more occur. ``near_items`` has the items that
    match exactly or within ``slop``.
    """
    hits = query_index(build_index(documents), benchmark, width=width, slop=slop, block_windows=block_windows)
    n_items = F.size("items").cast("bigint")
    return hits.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "hit_spans", "items", "near_items", (n_items >= min_items).alias("contaminated"))


def _filter(batches: Iterator[pa.RecordBatch], windows: Windows, slop: int, min_items: int, single: int | None, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows that are not contaminated by this block and those before; the last column, items found so far, goes after the last block."""
    for batch in batches:
        before = batch.column(batch.num_columns - 1).to_pylist()
        keep, items, at = [], [], 0
        for chunk in ts.chunks(batch.column(batch.schema.get_field_index("text"))):
            words = chunk.lowered().words(ts.ALNUM_WORDS)
            index = PositionalIndex.of_words(words, windows.terms)
            found, alone = [set(x or ()) for x in before[at : at + len(chunk)]], np.zeros(len(chunk), dtype=bool)
            at += len(chunk)
            if len(index.positions):
                window, _, own = index.match(windows, words.doc, slop)  # exact matches are among those of any slop
                for d, k in zip(*(x.tolist() for x in windows.pairs(window, words.doc[own])), strict=True):
                    found[d].add(windows.names[k].as_py())
                if single is not None:
                    alone[words.doc[own[windows.length[window] >= single]]] = True
            keep += [not one and len(x) < min_items for x, one in zip(found, alone.tolist(), strict=True)]
            items += [sorted(x) for x in found]
        columns, names = batch.columns[:-1], batch.schema.names[:-1]
        if not last:
            columns, names = [*columns, pa.array(items, pa.list_(pa.string()))], batch.schema.names
        yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, width: int = 8, slop: int = 0, min_items: int = 2, single: int | None = None, block_windows: int = 2_000_000) -> DataFrame:
    """Documents without the contaminated ones; columns as they are.

    A document is contaminated by windows of ``min_items`` items or more, or by one window of ``single`` words or more,
    each exactly or within ``slop``.
    The postings of a few megabytes of text are built, asked and dropped where the text is, so that no row moves.
    Each block of windows is one more narrow filter, and a row carries the items that it has met: rows are judged one by one.
    """
    shared = documents.sparkSession.sparkContext
    passes = [shared.broadcast(pickle.dumps(block)) for block in benchmark_blocks(benchmark, width, block_windows) if len(block.length)]
    if not passes:
        return documents
    met = next(name for k in itertools.count() if (name := f"met_{k}") not in documents.columns)
    plain = documents.schema
    out = documents.withColumn(met, F.array().cast("array<string>"))
    carried = StructType([*plain.fields, StructField(met, ArrayType(StringType()))])
    for k, held in enumerate(passes, 1):
        last = k == len(passes)
        out = out.mapInArrow(lambda batches, held=held, last=last: _filter(batches, pickle.loads(held.value), slop, min_items, single, last), plain if last else carried)
    return out
