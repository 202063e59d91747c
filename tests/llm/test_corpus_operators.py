"""Near duplicates, mixing and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tessella.llm import blocks, components, decontaminate, mixing, near_dup, packing, quality
from tessella.llm import textscan as ts

from .conftest import SCHEMA, alnum, words


def shingles(text):
    w = words(text)
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    """class of each doc_id, and of each text without one."""
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, text)
    bags = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in texts if bags[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if find(a) != find(b) and jaccard(bags[a], bags[b]) >= near_dup.THRESHOLD:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in texts}


def test_classes_equal_brute_force(edge, edge_rows):
    want = brute_classes([r[:2] for r in edge_rows])
    got = near_dup.find_classes(edge).collect()
    assert len(got) == len(edge_rows)
    assert {(r.doc_id, r.class_id) for r in got} == set(want.items())
    assert len(set(want.values())) < len(want)


def group(rng, size, words_, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words_)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words_)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_a_large_group_of_near_copies_and_a_common_passage(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = group(rng, 150, 120, 5) + [f"{' '.join(f'q{rng.randrange(10**6)}' for _ in range(60))} {passage}" for _ in range(60)] + ["same text for all of us here"] * 30
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = near_dup.find_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


def test_rows_without_ids_and_nothing(spark, empty):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "g h i j k l"), (None, "g h i j k l"), (6, None), (7, None)]
    got = Counter((r.doc_id, r.class_id) for r in near_dup.find_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    alone = {c for (i, c) in got if i is None and c != 5}
    assert got[5, 5] == 1 and got[None, 5] == 1 and got[6, 6] == 1 and got[7, 7] == 1
    assert len(alone) == 1 and min(alone) < 0 and sum(got.values()) == 6
    assert near_dup.find_classes(empty).count() == 0


def test_one_of_each_class_stays(edge, edge_rows):
    kept = near_dup.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    want = brute_classes([r[:2] for r in edge_rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_signatures_are_unbiased():
    rng = random.Random(2)
    base = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(400)]
    texts = []
    for k in (0, 5, 20, 60):
        own = list(base)
        for _ in range(k):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += ["a b c d e " * 200, "a b c d e " * 120, ""]
    (chunk,) = ts.chunks(pa.array(texts))
    doc, key, count, n = near_dup.shingles(chunk)
    sig = near_dup.bag_minhash(doc, key, count, len(texts), 4000)
    for a, b in ((0, 1), (0, 2), (0, 3), (1, 3), (4, 5)):
        assert abs((sig[a] == sig[b]).mean() - jaccard(shingles(texts[a]), shingles(texts[b]))) < 0.04
    assert np.isinf(sig[6]).all() and n[6] == 0


def test_components_equal_brute_force(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(500, 500 + k) for k in range(1, 40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert {x: got.get(x, x) for x in parent} == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_blocks_add_up():
    rng = np.random.default_rng(1)
    keys = [np.unique(rng.integers(0, 50, 20, dtype=np.uint64)) for _ in range(3)]
    counts = [rng.integers(0, 9, len(k)).astype(np.uint32) for k in keys]
    want = Counter()
    for k, c in zip(keys, counts, strict=True):
        for x, n in zip(k.tolist(), c.tolist(), strict=True):
            want[x] += n
    got, several, totals = blocks.add_up([blocks.pack_keys(k) for k in keys], [blocks.pack_counts(c) for c in counts])
    assert all([want[x] for x in k.tolist()] == g.tolist() for k, g in zip(keys, got, strict=True))
    assert totals.sum() == sum(want.values()) and len(totals) == len(want)
    senders = Counter(x for k in keys for x in k.tolist())
    assert all([senders[x] > 1 for x in k.tolist()] == m.tolist() for k, m in zip(keys, several, strict=True))


# Mixing


def brute_targets(sizes):
    """Resharing by weight until nobody is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def brute_mix(rows):
    """(doc_id, size, source size, target, taken) of rows (doc_id, text, source)."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    targets, out = brute_targets(sizes), []
    for source, total in sizes.items():
        name = lambda i, t: f"17:{i}" if i is not None else f"17::{hashlib.md5((t or '').encode()).hexdigest()}"
        own = sorted(((hashlib.md5(name(i, t).encode()).hexdigest(), -1 if i is None else i, len(words(t))) for i, t, s in rows if s == source))
        at, quota = 0, int(targets[source] + 1e-9)
        for _, i, n in own:
            whole = quota // total if total else 0
            out.append((i, n, total, round(targets[source], 6), whole * n + min(max(quota - whole * total - at, 0), n)))
            at += n
    return Counter(out)


@pytest.mark.parametrize("digits", [1, 3])
def test_mix_equals_brute_force(edge, edge_rows, digits):
    got = mixing.mix_sources(edge, digits=digits).collect()
    want = brute_mix([(r[0], r[1], r[3]) for r in edge_rows])
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == want


def test_budgets_are_met_exactly(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), f"s{rng.randrange(7) if i % 3 else 0}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = {r.source: (r.t, r.q) for r in mixing.mix_sources(df).groupBy("source").agg({"taken": "sum", "target": "max"}).toDF("source", "t", "q").collect()}
    assert all(t == int(q + 1e-9) for t, q in taken.values())
    mixed = mixing.apply_mix(df).collect()
    longest = max(len(words(t)) for _, t, _ in rows)
    for s, (_, target) in taken.items():
        assert abs(sum(len(words(r.text)) for r in mixed if r.source == s) - target) <= longest
    assert Counter(r.doc_id for r in mixed) == Counter(r.doc_id for r in mixing.apply_mix(df.repartition(5)).collect())


def test_repeated_rows_share_their_copies(spark):
    rows = [(7, "a b c d e f g", "s")] * 3 + [(8, "x " * 6, "t")] + [(None, "u v w", "s")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    target = {r.source: r.target for r in mixing.mix_sources(df).collect()}
    taken = Counter()
    for r in mixing.apply_mix(df.repartition(3)).collect():
        taken[r.source] += len(words(r.text))
    assert all(abs(taken[s] - target[s]) <= 4 for s in target)
    placed = mixing.mix_sources(df).where("doc_id = 7").collect()
    assert len({r.taken for r in placed}) > 1 and all(r.taken <= 2 * r["size"] for r in placed)


def test_rows_without_ids_spread_over_ranges(spark):
    df = spark.createDataFrame([(None, f"t {k}", "s") for k in range(200)], "doc_id bigint, text string, source string")
    assert mixing._sized(df, None, 3, 17).select("range").distinct().count() > 150


def test_mix_of_nothing(spark, empty):
    assert mixing.mix_sources(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mixing.mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2


# Pipeline


def test_pipeline_equals_brute_force(spark, edge, edge_rows, tmp_path):
    bench = [(1, " ".join((edge_rows[16][1] or "").split()[45:60])), (2, " ".join((edge_rows[16][1] or "").split()[50:70]))]
    spark.createDataFrame(edge_rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mix_sources", "pack_tokens"]
    verdict = {r.doc_id: r.kept for r in quality.score_outliers(edge).collect()}
    rows = {r[0]: r for r in edge_rows if verdict[r[0]]}
    classes = brute_classes([r[:2] for r in edge_rows if verdict[r[0]]])
    rows = {i: r for i, r in rows.items() if classes[i] == i}
    found = {r.doc_id for r in decontaminate.find_contamination(spark.createDataFrame(list(rows.values()), SCHEMA), spark.createDataFrame(bench, "item_id bigint, text string")).where("contaminated").collect()}
    windows = [set(tuple(alnum(t)[k : k + 8]) for k in range(len(alnum(t)) - 7)) for _, t in bench]
    for i, r in rows.items():
        own = {tuple(alnum(r[1])[k : k + 8]) for k in range(len(alnum(r[1])) - 7)}
        assert (i in found) == (sum(bool(own & w) for w in windows) >= 2)
    rows = {i: r for i, r in rows.items() if i not in found}
    copies = Counter()
    for i, n, total, target, taken in brute_mix([(i, r[1], r[3]) for i, r in rows.items()]):
        whole = int(target + 1e-6) // total
        copies[i] = whole + (2 * (taken - whole * n) >= n)
    code, got = packing.Encoder(packing.VOCABULARY), Counter()
    for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect():
        for doc, a, b in zip(r.doc_ids, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            got[doc] += b - a
    assert got == Counter({i: k * (len(code.encode(rows[i][1])) + 1) for i, k in copies.items() if k})
