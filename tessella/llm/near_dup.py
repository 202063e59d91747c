"""Near duplicates: BagMinHash signatures of word shingles, banding, and exact verification of multiset overlap.

A document is the multiset of its runs of five words (a shorter one is one shingle). Its weight discretises a shingle's
count to unit levels, grouped in a hierarchy of ranges (0,1], (1,2], (2,4], (4,8], ... Each range of each shingle has a
Poisson process over time whose rate is the number of its levels and whose seed depends on shingle and range only; a
point falls on a random level of the range and a random slot of the signature, counts if the level is within the
shingle's count, and the earliest point of each slot is the signature. Two signatures agree in a slot with the
probability of the multiset Jaccard similarity. Processes are advanced together and dropped once their time exceeds
the latest slot of their document.

Signatures are cut in bands. Identical texts are one node from the start (grouped by hash, so copies never meet).
Documents that share a band are compared without forming all pairs of a band's bucket:

1. every member with the bucket's least node, then the members of other groups with a leader drawn from the bucket's
   least group; what links to one leader is a *group* (part of a class, as far as leaders tell);
2. documents whose buckets still hold several groups get a second signature with longer bands (120 of 9: sharing none
   has probability 3e-8 at similarity 0.8). Groups that share a longer band, directly or over others, are a *cluster*;
   the documents of a cluster are cut in blocks of bounded size and compared block with block over an inverted index,
   but for blocks of one group. Only links that join groups become rows, at most one per group and pair of blocks.

So every pair of different classes that shares bands is proven under the threshold; a large group of copies costs a few
comparisons per member. What lies just under the threshold of each other without being linked costs time with the square
of its number, but no rows. At similarity 0.8 a pair shares no band with probability 3e-6 (32 bands of 5 slots).
Classes and clusters come from ``components``; only counts reach the driver.

Defined results: texts without words (null, empty, white space) are in no class but their own; a doc_id stands for one
document, so rows that repeat it share its class; rows without doc_id take the class of their text, named by a
negative number if all copies of it lack a doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textscan as ts
from tessella.llm.components import connected_components
from tessella.storage import Scratch, files_for

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
FINER = (120, 9)  # bands and rows of the last round
BLOCK = 1 << 19  # shingles of the documents of a cluster that are compared with so many others at once
CHUNK = 1 << 20  # bytes of text that are signed together
_SALT = np.uint64(0x8CB92BA72F3D8DD7)
MASK = (1 << 64) - 1


def shingles(chunk: ts.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with counts: doc, shingle hash, count; and the number of shingles per document."""
    words = chunk.words(ts.SPACE_WORDS)
    h = words.hashes()
    at = np.flatnonzero(words.ngram_ok(SHINGLE))
    doc, key = [words.doc[at]], [ts.ngrams(h, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(words.count == n)
        if len(short):
            doc.append(short)
            key.append(ts.mix(ts.ngrams(h, n)[words.first[short]] + np.uint64(n)))
    doc, key = np.concatenate(doc), np.concatenate(key)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(doc)))
    return doc[start], key[start], count, np.bincount(doc, minlength=len(chunk))


def bag_minhash(doc: np.ndarray, key: np.ndarray, count: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """n_docs x slots arrival times; infinite for documents without shingles."""
    sig = np.full(n_docs * slots, np.inf)
    parts = [(doc, key, np.ones(len(doc)), np.zeros(len(doc), np.int64), count)]
    k = 1
    while True:  # range (2**(k-1), 2**k] of shingles that reach into it
        low = 1 << (k - 1)
        reach = count > low
        if not reach.any():
            break
        n = int(reach.sum())
        parts.append((doc[reach], ts.mix(key[reach] ^ (np.uint64(k * int(_SALT) & MASK))), np.full(n, float(low)), np.full(n, low, np.int64), count[reach]))
        k += 1
    doc, state, rate, low, most = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(doc, kind="stable")
    doc, state, rate, low, most = doc[order], state[order], rate[order], low[order], most[order]
    time = np.zeros(len(doc))
    while len(doc):
        state = ts.mix(state + _SALT)
        u = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(u) / rate
        draw = ts.mix(state ^ _SALT)
        slot = ((draw >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        level = low + ((draw & np.uint64(0xFFFFFFFF)) * rate.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        hit = level < most
        np.minimum.at(sig, doc[hit] * slots + slot[hit], time[hit])
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        rows = doc[first]
        latest = sig.reshape(n_docs, slots)[rows].max(axis=1)
        keep = time < np.repeat(latest, np.diff(np.append(first, len(doc))))
        doc, state, rate, low, most, time = doc[keep], state[keep], rate[keep], low[keep], most[keep], time[keep]
    return sig.reshape(n_docs, slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per document and band."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    out = np.full((len(sig), bands), _SALT, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        out = ts.mix(out ^ bits[:, :, r]) + np.uint64(r)
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in ts.chunks(batch.column(2), CHUNK):
            doc, key, count, n = shingles(chunk)
            keys = band_keys(bag_minhash(doc, key, count, len(chunk), bands * rows), bands, rows)
            offsets = np.arange(len(chunk) + 1, dtype=np.int32) * bands
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)), mask=pa.array(n == 0))
            own = np.arange(chunk.first, chunk.first + len(chunk))
            digest = batch.column(1).take(pa.array(own, mask=n == 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), digest, pa.array(n, pa.int64()), listed], names=["doc_id", "digest", "n_shingles", "bands"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, units): one 64-bit number for each shingle and occurrence."""
    for batch in batches:
        for chunk in ts.chunks(batch.column(1), CHUNK):
            doc, key, count, n = shingles(chunk)
            unit = ts.mix(np.repeat(key, count) + ts.ranges(np.zeros(len(count), np.int64), count).astype(np.uint64) * _SALT).view(np.int64)
            offsets = np.zeros(len(chunk) + 1, dtype=np.int32)
            np.cumsum(n, out=offsets[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit))], names=["node", "units"])


def _sign_units(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(node, part, units) to a row (part, key) per band: the units of a document are a set, so all counts are 1."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            piece = batch.slice(at, 64)
            sizes = np.asarray(piece.column(2).value_lengths())
            doc = np.repeat(np.arange(piece.num_rows), sizes)
            key = ts.mix(np.asarray(piece.column(2).flatten()).astype(np.int64).view(np.uint64) + _SALT)
            keys = band_keys(bag_minhash(doc, key, np.ones(len(doc), np.int64), piece.num_rows, bands * rows), bands, rows)
            of = pa.array(np.repeat(np.arange(piece.num_rows), bands))
            yield pa.RecordBatch.from_arrays([piece.column(1).take(of), pa.array(keys.reshape(-1))], names=["part", "key"])


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """part and number of units of each document, and all units."""
    lists = pa.concat_arrays(table.column("units").chunks) if table.num_rows else pa.array([], pa.list_(pa.int64()))
    return np.asarray(table.column("part")).astype(np.int64), np.asarray(lists.value_lengths()).astype(np.int64), np.asarray(lists.flatten())


def joins(asking: pa.Table, members: pa.Table, threshold: float) -> pa.Table:
    """Links (a, b) between the parts of two blocks of documents (part, units): a spanning forest of all links there are.

    The overlap of an asking document with all members is one count over an inverted index of the members' units. A
    document of whose units under the threshold's share are in the index at all links to nothing there.
    """
    own_part, own_sizes, asked = _block(asking)
    part, sizes, units = _block(members)
    parts, at = np.unique(np.concatenate([own_part, part]), return_inverse=True)
    own_at, at = at[: len(own_part)], at[len(own_part) :]
    root = np.arange(len(parts))
    owner = np.repeat(np.arange(len(part)), sizes)
    order = np.argsort(units, kind="stable")
    units, owner = units[order], owner[order]
    a, b = [], []
    ends = np.cumsum(own_sizes)
    for k, (end, n) in enumerate(zip(ends.tolist(), own_sizes.tolist(), strict=True)):
        own = asked[end - n : end]
        lo, hi = np.searchsorted(units, own), np.searchsorted(units, own, side="right")
        if int((hi > lo).sum()) < threshold * n:
            continue
        both = np.bincount(owner[ts.ranges(lo, hi - lo)], minlength=len(part))
        for other in np.unique(root[at[both >= threshold * (n + sizes - both)]]).tolist():
            if other != root[own_at[k]]:
                a.append(int(parts[own_at[k]]))
                b.append(int(parts[other]))
                root[root == other] = root[own_at[k]]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _compare(documents: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join the parts of a cluster, from (cluster, part, units), by exact overlap.

    Parts of more than a block have blocks of their own, the others share some. Every block meets every other block of
    its cluster and, unless it is of one part, itself: no pair of documents is a row, and no task holds a cluster.
    """
    amounts = documents.groupBy("cluster", "part").agg(F.sum(F.size("units")).alias("amount"))
    home = F.when(F.col("amount") > BLOCK, F.col("part"))
    amounts = amounts.withColumn("home", home)
    shapes = amounts.groupBy("cluster", "home").agg(F.ceil(F.sum("amount") / BLOCK).cast("int").alias("blocks"))
    numbered = shapes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = lambda: F.concat_ws(":", "cluster", F.coalesce(F.col("home").cast("string"), F.lit("-")), "block")
    named = numbered.select("cluster", "home", name().alias("name"))
    left, right = (named.select("cluster", F.col("home").alias(f"{side}_home"), F.col("name").alias(side)) for side in ("x", "y"))
    meet = left.join(right, "cluster").where((F.col("x") <= F.col("y")) & (F.col("x_home").isNull() | ~F.col("x_home").eqNullSafe(F.col("y_home")))).select("x", "y")
    placed = amounts.select("cluster", "part", "home").join(shapes.withColumnRenamed("home", "own").withColumnRenamed("cluster", "of"), (F.col("cluster") == F.col("of")) & F.col("home").eqNullSafe(F.col("own"))).select("part", "home", "blocks")
    blocked = documents.join(placed, "part").withColumn("block", F.pmod(F.when(F.col("home").isNull(), F.xxhash64("part")).otherwise(F.xxhash64("node")), F.col("blocks")).cast("int")).select("part", "units", name().alias("name"))
    sides = [blocked.join(meet, F.col("name") == F.col(side)).select("x", "y", "part", "units").toDF("x", "y", "part", "units") for side in ("x", "y")]
    return sides[0].groupBy("x", "y").cogroup(sides[1].groupBy("x", "y")).applyInArrow(lambda one, other: joins(one, other, threshold), "a bigint, b bigint")


def verify(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(a, b, ...) with their jaccard by exact multiset overlap."""
    left = units.select(F.col("node").alias("a"), F.col("units").alias("ua"))
    right = units.select(F.col("node").alias("b"), F.col("units").alias("ub"))
    both = F.size(F.array_intersect("ua", "ub"))
    return pairs.join(left, "a").join(right, "b").select(*pairs.columns, (both / (F.size("ua") + F.size("ub") - both)).alias("jaccard"))


def _mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members (key, node) of buckets that hold several parts, with their part and the bucket's least one (``home``)."""
    named = members.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    several = named.groupBy("key").agg(F.min("part").alias("home"), F.max("part").alias("last")).where("home <> last").select("key", "home")
    return named.join(several, "key")


def _least(links: DataFrame) -> DataFrame:
    """(node, part) from links (a, b) with a < b: the least a of each b, and the one that a has itself."""
    first = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("part"))
    then = first.select(F.col("node").alias("part"), F.col("part").alias("next"))
    return first.join(then, "part", "left").select("node", F.coalesce("next", "part").alias("part"))


def find_classes(documents: DataFrame, *, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, n_shingles for every row: class_id is the least doc_id of the documents connected by near duplicates."""
    run = Scratch(documents.sparkSession, "near-dup", files_for(documents))
    digest = F.md5("text")
    signed = run.table(documents.select(F.col("doc_id").cast("bigint"), digest.alias("digest"), "text").mapInArrow(lambda b: _sign(b, bands, rows), "doc_id bigint, digest string, n_shingles bigint, bands array<bigint>"), "signed")
    lone = -F.abs(F.shiftright(F.xxhash64("digest"), 1)) - 2
    nodes = run.table(signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")).withColumn("node", F.coalesce("first_id", lone)), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select("key", "leader")
    members = run.table(banded.join(buckets, "key"), "members")

    involved = members.select("node").distinct().join(nodes, "node").select("node", F.col("digest").alias("own_digest"), "first_id")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest.alias("digest"), "text")
    # Rows that repeat doc_id and text are one node.
    texts = texts.join(involved, (F.col("digest") == F.col("own_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text")
    units = run.table(texts.mapInArrow(_units, "node bigint, units array<bigint>").dropDuplicates(["node"]), "units")

    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    linked = verify(pairs, units).where(F.col("jaccard") >= threshold).select("a", "b")
    parts = run.table(_least(linked), "parts")

    # The bucket's least part gives one more leader. XOR with a number orders nodes anew, in all buckets alike, so the
    # members of a part get few leaders between them; XOR again gives the node back.
    order = F.xxhash64(F.lit(0))
    mixed = run.table(_mixed(members.select("key", "node"), parts), "mixed")
    drawn = mixed.where("part = home").groupBy("key").agg(F.min(F.col("node").bitwiseXOR(order)).alias("least"))
    leads = mixed.where("part <> home").join(drawn, "key").select(F.col("least").bitwiseXOR(order).alias("a"), F.col("node").alias("b"), "home", "part").distinct()
    found = run.table(verify(leads, units).where(F.col("jaccard") >= threshold).select(F.col("home").alias("a"), F.col("part").alias("b")).distinct(), "found")

    # What is still apart: its parts are clustered along longer bands, and clusters compared block by block.
    merged = _least(found).select(F.col("node").alias("part"), F.col("part").alias("next"))
    known = run.table(mixed.join(merged, "part", "left").select("key", "node", F.coalesce("next", "part").alias("part")), "known")
    several = known.groupBy("key").agg(F.min("part").alias("home"), F.max("part").alias("last")).where("home <> last").select("key")
    rest = run.table(known.join(several, "key").select("node", "part").distinct().join(units, "node").select("node", "part", "units"), "rest")
    finer = run.table(rest.mapInArrow(lambda b: _sign_units(b, *FINER), "part bigint, key bigint").distinct(), "finer")
    least = finer.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("last")).where("least <> last").select("key", "least")
    clusters = connected_components(finer.join(least, "key").where("part <> least").select(F.col("part").alias("u"), F.col("least").alias("v")), run, "clusters")
    clustered = rest.join(clusters.select(F.col("node").alias("part"), F.col("component").alias("cluster")), "part")
    also = run.table(_compare(clustered, threshold), "also")

    edge = lambda df, u, v: df.select(F.col(u).alias("u"), F.col(v).alias("v"))
    classes = connected_components(edge(parts, "node", "part").unionByName(edge(found, "a", "b")).unionByName(edge(also, "a", "b")), run, "classes")
    run.drop("members", "units", "parts", "mixed", "found", "known", "rest", "finer", "also", *(t for t in run.paths if t.startswith("clusters")))
    named = nodes.join(classes, "node", "left").select(F.col("digest").alias("own_digest"), F.coalesce("component", "node").alias("class_id"))
    return signed.join(named, signed["digest"] == named["own_digest"], "left").select("doc_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_shingles")


def drop_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """One document of each class (the one with the least doc_id); rows without a doc_id stay."""
    kept = find_classes(documents, **options).where("doc_id = class_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = documents.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    one = rows.join(kept, rows["doc_id"] == kept["kept_id"]).dropDuplicates(["doc_id"])
    return one.select("row.*").unionByName(documents.where("doc_id is null"))
