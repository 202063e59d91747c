"""Language-model scores by a weighted backoff automaton.

Training counts of n-grams (order 3 by default) are smoothed toward the next lower order with a Dirichlet prior of
weight ``prior``: p(w | context) = (n(context w) + prior p(w | shorter context)) / (n(context) + prior), down to an
add-0.1 unigram model with one unknown word, so the probabilities of all words after any context sum to one. In
backoff form every n-gram that was seen in training is a state (its words are the context), reached by an arc of weight
log p(w | context); a state's failure arc, of weight log(prior / (n(context) + prior)), leads to the context without its
first word, and the empty context has an arc for every word.

The automaton of the whole corpus is never in one place. Each block of documents (see ``blocks``) asks for the counts of
the n-grams that it holds, which cover all training documents, and builds the states, arcs and failure arcs that its
texts can reach (``BackoffAutomaton``). Its texts are then read from left to right once, all of them in step: a text
carries its state, follows failure arcs until the state has an arc for the token, adds up the weights, and goes where the
arc leads.

What is exchanged is linear in the corpus at any size: a block sends a sorted array of keys and counts to each part of the
key space in which it has any, so there are never more rows than keys. From the third order on it only asks for n-grams
whose two shorter parts other blocks have as well: of all others it has every occurrence itself. Texts travel compressed.
Words and n-grams are told apart by 64-bit hashes.

Tokens are words (ASCII lower-cased, cut at ASCII white space) and one end token per document. Training documents are
those whose crc32(doc_id as text) mod 10 is not 0; a missing doc_id counts as empty text. Defined results: null and
empty texts are the end token alone; repeated rows count and are scored each; without any training document all
counts are 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import blocks
from tessella.llm import textscan as ts

START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
ADD = 0.1
REQUEST = "part bigint, level int, block int, keys binary, counts binary"
ANSWER = "block int, level int, part bigint, totals binary, shared binary"
DEALT = "block int, doc_ids array<bigint>, held array<boolean>, lengths array<bigint>, data binary"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
NONE = -1
SEGMENT = 512
BLOCK_BYTES = 6 << 20


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all documents one after another, and how many each has."""
    tokens, counts = [], []
    for chunk in ts.chunks(texts):
        words = chunk.lowered().words(ts.SPACE_WORDS)
        n = words.count + 1
        out = np.full(int(n.sum()), END, dtype=np.uint64)
        out[np.arange(len(words.doc)) + words.doc] = words.hashes()  # one end token before, per earlier document
        tokens.append(out)
        counts.append(n)
    return (np.concatenate(tokens), np.concatenate(counts)) if tokens else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def gram_key(before: np.ndarray, gram: np.ndarray, level: int) -> np.ndarray:
    """Hashes of n-grams of the level, from the token in front and the hashes of the rest."""
    return ts.mix(ts.mix(before + np.uint64(level)) ^ gram * np.uint64(0x9E3779B97F4A7C15))


def grams(tokens: np.ndarray, counts: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For each order from 1, the hash of the n-gram that ends at each token; documents start with start tokens."""
    first = np.cumsum(counts) - counts
    place = np.arange(len(tokens)) - np.repeat(first, counts)
    key = tokens
    yield key
    for k in range(2, order + 1):
        before = np.full(len(tokens), START, dtype=np.uint64)  # the token k - 1 places back
        inside = place >= k - 1
        before[inside] = tokens[np.flatnonzero(inside) - (k - 1)]
        key = gram_key(before, key, k)
        yield key


class Arcs:
    """Arcs by (state, token): a sorted array of hashes, entered at the place that the leading bits tell."""

    def __init__(self, keys: list[np.ndarray], weights: list[np.ndarray], to: list[np.ndarray]):
        key = np.concatenate(keys)
        order = np.argsort(key)
        self.key = key[order]
        del key
        self.weight, self.to = np.concatenate(weights)[order], np.concatenate(to)[order]
        bits = max(1, len(self.key).bit_length())
        self.shift = np.uint64(64 - bits)
        self.enter = np.searchsorted(self.key, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    @staticmethod
    def key_of(state: np.ndarray, token: np.ndarray) -> np.ndarray:
        return ts.mix(state.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ ts.mix(token))

    def find(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Places of arcs, NONE where there is none."""
        out = np.full(len(state), NONE, dtype=np.int64)
        key = self.key_of(state, token)
        at, left = self.enter[key >> self.shift], np.arange(len(key))
        while len(left):
            inside = at < len(self.key)
            at, left, key = at[inside], left[inside], key[inside]
            here = self.key[at]
            hit, more = here == key, here < key
            out[left[hit]] = at[hit]
            at, left, key = at[more] + 1, left[more], key[more]
        return out


class BackoffAutomaton:
    """States, arcs and failure arcs over the n-grams of some documents.

    The empty context is state 0, the context of start tokens alone the next ``order - 1``; every other state is a seen
    n-gram under the highest order. Arcs are rows of a table sorted by (state, token): weight and next state.
    """

    def __init__(self, order: int, train_tokens: int, vocabulary: int, prior: float, starts: int):
        """``starts``: training documents, each of which has every context of start tokens once."""
        self.order, self.prior = order, prior
        self.unknown = -np.log10((train_tokens + ADD * (vocabulary + 1)) / ADD)
        self.total = train_tokens + ADD * (vocabulary + 1)
        self.failure_to = [NONE, *range(order - 1)]
        self.context_count = [train_tokens, *[starts] * (order - 1)]
        self.arcs: list[tuple[np.ndarray, ...]] = []  # of each level: state, token, count, next, fallback
        self.new_states: list[int] = []  # the first state that each level adds

    def add_level(self, state: np.ndarray, token: np.ndarray, count: np.ndarray, fallback: np.ndarray) -> np.ndarray:
        """Arcs of seen n-grams of one level: from a state of one word less, with their training counts. Unless the level is
        the highest, each leads to a new state, which fails to ``fallback``; else to ``fallback``. Returns where they lead."""
        highest = len(self.arcs) + 1 == self.order
        to = fallback if highest else np.arange(len(self.failure_to), len(self.failure_to) + len(state))
        self.new_states.append(len(self.failure_to))
        if not highest:
            self.failure_to = np.concatenate([self.failure_to, fallback])
            self.context_count = np.concatenate([self.context_count, count])
        self.arcs.append((state, token, count, to, fallback))
        return to

    def finish(self) -> None:
        """Weights of all arcs, level by level, and the table of arcs."""
        self.failure_to = np.asarray(self.failure_to, dtype=np.int64)
        context = np.asarray(self.context_count, dtype=np.float64)
        self.failure = np.log10(self.prior / (context + self.prior))
        keys, weights, to, p = [], [], [], None
        for level in range(len(self.arcs)):
            state, token, count, next_, fallback = self.arcs[level]
            self.arcs[level] = None  # a block's arcs are not held twice
            if level == 0:
                p = (count + ADD) / self.total
            else:
                # The n-gram without its first word is seen too: its arc is the one that led to the state to fall back to.
                p = (count + self.prior * p[fallback - self.new_states[level - 1]]) / (context[state] + self.prior)
            keys.append(Arcs.key_of(state, token))
            weights.append(np.log10(p))
            to.append(next_.astype(np.int32))
        self.table = Arcs(keys, weights, to)

    def _step(self, table: Arcs, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read a token in each of some states: total weight, and the next state."""
        weight, to = np.zeros(len(state)), np.zeros(len(state), np.int64)
        reading, at = np.arange(len(state)), state.copy()
        while len(reading):
            place = table.find(at, token[reading])
            found = place >= 0
            weight[reading[found]] += table.weight[place[found]]
            to[reading[found]] = table.to[place[found]]
            lost = ~found & (at == 0)  # a word that training never had
            weight[reading[lost]] += self.unknown
            left = ~found & ~lost
            weight[reading[left]] += self.failure[at[left]]
            reading, at = reading[left], self.failure_to[at[left]]
        return weight, to

    def read(self, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each document, from left to right with a state carried along.

        Documents are read in step. A long one is entered again every ``SEGMENT`` tokens, so that it doesn't read on alone:
        the state there depends on the ``order - 1`` tokens before, which are read first for no score.
        """
        pieces = -(-counts // SEGMENT)
        doc = np.repeat(np.arange(len(counts)), pieces)
        first = (np.cumsum(counts) - counts)[doc]
        scored = first + ts.ranges(np.zeros(len(counts), np.int64), pieces) * SEGMENT
        begin = np.maximum(scored - (self.order - 1), first)
        length = np.minimum(scored + SEGMENT, first + counts[doc]) - begin
        order = np.argsort(-length, kind="stable")
        begin, scored, length = begin[order], scored[order], length[order]
        state = np.where(begin == first[order], self.order - 1, 0)
        score = np.zeros(len(order))
        for step in range(int(length[0]) if len(length) else 0):
            alive = int(np.searchsorted(-length, -step, side="left"))  # longer than ``step``
            weight, state[:alive] = self._step(self.table, state[:alive], tokens[begin[:alive] + step])
            score[:alive] += np.where(begin[:alive] + step >= scored[:alive], weight, 0.0)
        return np.bincount(doc[order], weights=score, minlength=len(counts))


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc_id, held_out, text) to one row per block in a batch, with the texts compressed."""
    schema = pa.schema([("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])
    codec = pa.Codec("zstd", 3)
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by("block")
        block = rows.column(0).to_numpy()
        begin = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(block)], strict=True):
            own = rows.slice(lo, hi - lo)
            texts = blocks.single(own, "text").cast(pa.large_binary()).fill_null(b"")
            data = b"".join(texts.to_pylist())
            lengths = pa.compute.binary_length(texts)
            yield pa.RecordBatch.from_pylist([{"block": int(block[lo]), "doc_ids": own.column(1).to_pylist(), "held": own.column(2).to_pylist(), "lengths": lengths.to_pylist(), "data": codec.compress(data, asbytes=True)}], schema=schema)


class Texts:
    """The documents of a block: ids, whether each is held out, token hashes and how many tokens each has."""

    def __init__(self, dealt: pa.Table):
        codec, tokens, counts = pa.Codec("zstd", 3), [], []
        self.block = dealt.column("block")[0].as_py()
        self.doc_ids = [x for row in dealt.column("doc_ids").to_pylist() for x in row]
        self.held = np.array([x for row in dealt.column("held").to_pylist() for x in row], dtype=bool)
        for lengths, data in zip(dealt.column("lengths").to_pylist(), dealt.column("data"), strict=True):
            ends = np.cumsum([0, *lengths], dtype=np.int64)
            raw = codec.decompress(data.as_buffer(), int(ends[-1])) if ends[-1] else pa.py_buffer(b"")
            t, n = tokens_of(pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), raw]))
            tokens.append(t)
            counts.append(n)
        self.tokens, self.counts = np.concatenate(tokens), np.concatenate(counts)


class Level:
    """The n-grams of one order in a block: the distinct keys, which of them ends at each token, their counts in the block's
    training documents, and which of them the block asks for."""

    def __init__(self, key: np.ndarray, train: np.ndarray, asked: np.ndarray | None):
        """``asked``: of each token's n-gram; None for all."""
        order = np.argsort(key)
        ordered = key[order]
        new = np.append(True, ordered[1:] != ordered[:-1]) if len(key) else np.zeros(0, bool)
        self.distinct, self.example = ordered[new], order[new]  # any token at which it ends is an example
        del ordered
        self.inverse = np.empty(len(key), dtype=np.int32)  # a block has fewer tokens
        self.inverse[order] = np.cumsum(new) - 1
        self.own = np.bincount(self.inverse, weights=train, minlength=len(self.distinct)).astype(np.int64)
        self.asked = np.ones(len(self.distinct), dtype=bool) if asked is None else asked[self.example]

    def requests(self, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
        keys, counts = self.distinct[self.asked], self.own[self.asked]
        return ((p, blocks.pack_keys(keys[lo:hi]), blocks.pack_counts(counts[lo:hi])) for p, lo, hi in blocks.pieces(keys, parts))

    def answered(self, told: dict[int, tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Totals of the distinct n-grams, and whether other blocks have them too."""
        total, shared = self.own.copy(), np.zeros(len(self.own), dtype=bool)
        if told:
            total[self.asked] = np.concatenate([blocks.unpack_counts(told[p][0]) for p in sorted(told)]).astype(np.int64)
            shared[self.asked] = np.concatenate([np.unpackbits(np.frombuffer(told[p][1], dtype=np.uint8), count=len(blocks.unpack_counts(told[p][0]))) for p in sorted(told)]).astype(bool)
        return total, shared


def levels(texts: Texts, order: int, told: dict[int, dict[int, tuple[bytes, bytes]]]) -> Iterator[tuple[Level, np.ndarray, np.ndarray]]:
    """(Level, totals, shared) from order 1 on; what a level asks follows from the answers of the one before."""
    train = np.repeat(~texts.held, texts.counts)
    first = np.cumsum(texts.counts) - texts.counts
    asked = None
    for number, key in enumerate(grams(texts.tokens, texts.counts, order), 1):
        level = Level(key, train, asked)
        total, shared = level.answered(told.get(number, {}))
        yield level, total, shared
        if number > 1:
            ends = shared[level.inverse]
            begins = np.append(True, ends[:-1])
            begins[first] = True  # start tokens stand before every document
            asked = ends & begins


def _told(answers: pa.Table) -> dict[int, dict[int, tuple[bytes, bytes]]]:
    out: dict[int, dict[int, tuple[bytes, bytes]]] = {}
    for level, part, totals, shared in zip(*(blocks.column(answers, c) for c in ("level", "part", "totals", "shared")), strict=True):
        out.setdefault(level, {})[part] = totals, shared
    return out


def _request(dealt: pa.Table, answers: pa.Table | None, wanted: range, parts: int) -> pa.Table:
    """What a block asks for the orders ``wanted``, given the answers of all before."""
    out: dict[str, list] = {"part": [], "level": [], "block": [], "keys": [], "counts": []}
    if dealt.num_rows:
        texts = Texts(dealt)
        for number, (level, _, _) in enumerate(levels(texts, wanted.stop - 1, _told(answers) if answers is not None else {}), 1):
            for p, keys, counts in level.requests(parts) if number in wanted else ():
                for name, value in zip(out, (p, number, texts.block, keys, counts), strict=True):
                    out[name].append(value)
    return pa.table(out, schema=pa.schema([("part", pa.int64()), ("level", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))


def _answer(table: pa.Table) -> pa.Table:
    totals, shared, _ = blocks.add_up(blocks.column(table, "keys"), blocks.column(table, "counts"))
    return pa.table({"block": table.column("block"), "level": table.column("level"), "part": table.column("part"), "totals": pa.array([blocks.pack_counts(a) for a in totals], pa.binary()), "shared": pa.array([np.packbits(a).tobytes() for a in shared], pa.binary())})


def build(known: Iterator[tuple[Level, np.ndarray, np.ndarray]], tokens: np.ndarray, n: np.ndarray, order: int, prior: float, train_tokens: int, vocabulary: int, train_docs: int) -> tuple[BackoffAutomaton, np.ndarray]:
    """The automaton of some documents, and the training count of each token, from the levels with their totals."""
    model = BackoffAutomaton(order, train_tokens, vocabulary, prior, train_docs)
    first, state_before, unigrams = np.cumsum(n) - n, np.zeros(len(tokens), np.int64), None
    # Where each (n-1)-gram that ends at a token has its state, NONE if training never had it; for level 1 the empty context.
    ends_in = np.zeros(len(tokens), np.int64)
    for number, (level, total, _) in enumerate(known, 1):
        if unigrams is None:
            unigrams = total[level.inverse]
        if number > 1:  # the context of the n-gram at a token ends one token earlier
            state_before = np.append(0, ends_in[:-1])
            state_before[first] = number - 1  # so many start tokens
        seen = np.flatnonzero(total > 0)
        at = level.example[seen]  # a token at which each seen n-gram ends
        fallback = np.zeros(len(seen), np.int64) if number == 1 else ends_in[at]
        to = model.add_level(state_before[at], tokens[at], total[seen], fallback)
        leads = np.full(len(total), NONE, dtype=np.int64)
        leads[seen] = to
        ends_in = leads[level.inverse]
        del level
    model.finish()
    return model, unigrams


def _score(dealt: pa.Table, answers: pa.Table, order: int, prior: float, train_tokens: int, vocabulary: int, train_docs: int) -> pa.Table:
    texts = Texts(dealt)
    tokens, n = texts.tokens, texts.counts
    model, known = build(levels(texts, order, _told(answers)), tokens, n, order, prior, train_tokens, vocabulary, train_docs)
    first = np.cumsum(n) - n
    add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)  # noqa: E731  every document has a token
    base = np.log10((known + ADD) / (train_tokens + ADD * (vocabulary + 1)))
    return pa.table({"doc_id": pa.array(texts.doc_ids, pa.int64()), "held_out": pa.array(texts.held), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(add((known > 0).astype(np.int64)).astype(np.int64)), "base_score": pa.array(add(base).astype(np.float64)), "score": pa.array(model.read(tokens, n))})


def _vocabulary_request(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Distinct training tokens with counts, for each few batches of documents as they are scanned."""
    schema = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        distinct, count = np.unique(np.concatenate(held), return_counts=True)
        spans = list(blocks.pieces(distinct, parts))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in spans], pa.int64()), pa.array([blocks.pack_keys(distinct[a:b]) for _, a, b in spans], pa.binary()), pa.array([blocks.pack_counts(count[a:b]) for _, a, b in spans], pa.binary())], schema=schema)

    for batch in batches:
        tokens, _ = tokens_of(batch.column(0))
        held.append(tokens)
        size += len(tokens)
        if size > 4 << 20:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _vocabulary(table: pa.Table) -> pa.Table:
    _, _, totals = blocks.add_up(blocks.column(table, "keys"), blocks.column(table, "counts"))
    return pa.table({"tokens": [int(totals.sum())], "distinct": [len(totals)]})


def score_documents(documents: DataFrame, *, order: int = 3, prior: float = 50.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    n_blocks = blocks.count_blocks(documents, block_bytes)
    docs = documents.select(blocks.block_of(n_blocks, "doc_id", "text").alias("block"), F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), "text")
    train = docs.where(~F.col("held_out"))
    sums = train.select("text").mapInArrow(lambda b: _vocabulary_request(b, n_blocks), "part bigint, keys binary, counts binary").groupBy("part").applyInArrow(_vocabulary, "tokens bigint, distinct bigint")
    seen = sums.agg(F.sum("tokens"), F.sum("distinct")).first()
    train_tokens, vocabulary, train_docs = int(seen[0] or 0), int(seen[1] or 0), train.count()
    dealt = docs.mapInArrow(_deal, DEALT)
    asked = dealt.groupBy("block").applyInArrow(lambda t: blocks.released(_request, t, None, range(1, min(order, 2) + 1), n_blocks), REQUEST)
    told = asked.groupBy("part", "level").applyInArrow(lambda t: blocks.released(_answer, t), ANSWER)
    ask = lambda level: lambda d, a: blocks.released(_request, d, a, range(level, level + 1), n_blocks)
    for level in range(3, order + 1):
        more = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask(level), REQUEST)
        told = told.unionByName(more.groupBy("part", "level").applyInArrow(lambda t: blocks.released(_answer, t), ANSWER))
    scored = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda d, a: blocks.released(_score, d, a, order, prior, train_tokens, vocabulary, train_docs), SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
