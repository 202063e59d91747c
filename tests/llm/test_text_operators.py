"""Operators on texts against brute force: null, empty and very long texts, ties and repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tessella.llm import blocks, decontaminate, html_text, language_model, license_rules, licenses, packing, quality, queries, secrets, suffix_dedup
from tessella.llm import textscan as ts
from tessella.llm.suffix_array import suffix_array

from .conftest import PAGES, alnum, words


def by_row(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# Suffix arrays and repeats


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_array_is_the_order_of_suffixes(letters):
    rng = random.Random(letters)
    for _ in range(400):
        s = [rng.randint(1, letters) for _ in range(rng.randint(0, 60))]
        assert suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [1 << 24, 20_000])
def test_repeats_equal_brute_force(edge, edge_rows, block_bytes):
    got = suffix_dedup.remove_repeats(edge, block_bytes=block_bytes)
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats([r[:2] for r in edge_rows])


def test_a_common_passage_goes_many_ways():
    """400 documents share a passage in different surroundings: what stands across its edges spreads over all parts."""
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    passage = prose(90)
    texts = [prose(200) + passage + prose(200) for _ in range(400)] + [passage * 2] * 5
    docs = pa.table({"block": pa.array([0] * 405, pa.int32()), "doc_id": pa.array(range(405), pa.int64()), "has_id": [True] * 405, "doc_hash": pa.array([0] * 405, pa.int64()), "text": texts})
    found = [key for _, key, *_ in suffix_dedup._all_runs(blocks.single(docs, "text"), 100)]
    keys, times = np.unique(np.concatenate(found), return_counts=True)
    assert len(keys) > 4000 and times.max() <= 410  # about once in a document
    assert (times > 50).sum() <= 6  # what lies inside of it stays together
    share = np.bincount(blocks.part_of(np.sort(np.repeat(keys, np.where(times > 50, 0, times))), 64), minlength=64)
    assert share.max() < 2 * share.mean()


def test_repeats_of_nothing(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


# Decontamination

BENCH = "item_id bigint, text string, doc_id int, n_hit int"


@pytest.fixture(scope="module")
def bench(spark, edge_rows):
    texts = {i: r[1] for i, r in enumerate(edge_rows)}
    long = texts[16].split()
    rows = [(1, " ".join(long[45:60])), (2, " ".join(long[50:70]).upper()), (3, None), (4, ""), (5, "two words"), (5, "two words"), (6, "nowhere to be found at all in any of these"), (10, " ".join(long[41:49]))]
    return spark.createDataFrame([(*r, 0, 0) for r in rows], BENCH)


def brute_contamination(rows, items, width=8):
    windows = {}
    for item, text in items:
        w = alnum(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = alnum(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return Counter(out)


@pytest.mark.parametrize("block_windows", [1 << 20, 1])
def test_contamination_equals_brute_force(edge, edge_rows, bench, block_windows):
    got = decontaminate.find_contamination(edge, bench, block_windows=block_windows)
    want = brute_contamination([r[:2] for r in edge_rows], [tuple(r)[:2] for r in bench.collect()])
    assert by_row(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    clean = decontaminate.drop_contaminated(edge, bench, block_windows=block_windows)
    assert clean.columns == edge.columns
    assert by_row(clean, "doc_id") == Counter({(k[0],): n for k, n in want.items() if not k[5]})


def test_proximity_equals_brute_force(spark):
    rng, names = random.Random(4), list("abcdefgh")
    docs = [(i, " ".join(rng.choice(names) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    items = [(k, " ".join(rng.choice(names) for _ in range(6))) for k in range(12)]
    slop = 1

    def near(w, q):
        places = {t: [i for i, x in enumerate(w) if x == t] for t in q}
        return any(all(any(abs(p - s - k) <= slop for p in places[t]) for k, t in enumerate(q)) for s in range(-slop, len(w) + slop))

    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), width=6, slop=slop)
    found = {r.doc_id: r.near_items for r in got.collect()}
    assert any(found.values())
    for i, text in docs:
        assert found[i] == sorted(str(k) for k, q in items if near(text.split(), q.split()))


@pytest.mark.parametrize("block_windows", [1 << 20, 1])
def test_one_verbatim_item_is_enough_for_the_pipeline(spark, tmp_path, block_windows, monkeypatch):
    items = [(1, "a b c d e f g h i j k"), (2, "l m n o p q r s"), (3, "two words")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    texts = ["x y A, b c d e f g h z", "x a b c d e f g x x x x x x h", "say two words", "l m n o p q r s", None, "l m n o p q r and two words", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    drop = decontaminate.drop_contaminated
    monkeypatch.setattr(decontaminate, "drop_contaminated", lambda *a, **k: drop(*a, **k, block_windows=block_windows))
    assert sorted(r.doc_id for r in corpus_pipeline.decontamination(spark, docs, f"file://{tmp_path}").collect()) == [1, 2, 4, 5, 6]


@pytest.mark.parametrize("block_windows", [1 << 20, 1])
def test_rows_are_judged_one_by_one_at_any_size(spark, block_windows):
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (2, "m n o p q r s t")], "item_id bigint, text string")
    bad = "a b c d e f g h m n o p q r s t"
    docs = spark.createDataFrame([(None, bad), (1, bad), (1, "clean"), (None, "clean too"), (2, None)], "doc_id bigint, text string")
    left = decontaminate.drop_contaminated(docs, bench, block_windows=block_windows).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter([(1, "clean"), (None, "clean too"), (2, None)])


def test_query_and_pipeline_find_proximity(spark, tmp_path):
    items = [(1, "a b c d e f g h i j k l"), (2, "m n o p q r s t u v")]
    texts = ["x a b c d x e f g h i x j k l z", "b a d c f e h g j i l k", "m n o p q x y z w v r s t u v", "plain words only and none else here", None]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_benchmark_decontamination(spark, f"file://{tmp_path}").collect()}
    assert [got[i].n_near_items for i in range(5)] == [1, 1, 0, 0, 0]
    assert [got[i].n_items for i in range(5)] == [0, 0, 0, 0, 0] and not any(r.contaminated for r in got.values())
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.decontamination(spark, docs, f"file://{tmp_path}").collect()) == [2, 3, 4]


def test_contamination_of_and_by_nothing(edge, empty, bench, spark):
    none = spark.createDataFrame([], BENCH)
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(edge, none).where("n_items > 0 or contaminated").count() == 0
    assert decontaminate.drop_contaminated(edge, none).count() == edge.count()


# Quality


def counts(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    often = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {i for k in range(len(w) - 7) if often[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(edge, edge_rows):
    got = quality.score_outliers(edge)
    want = Counter((r[0], *(c := counts(r[1])), c[0] < 20 or 100 * c[4] > 30 * c[0]) for r in edge_rows)
    assert by_row(got, "doc_id", *quality.COUNTS, "base_failed") == want
    assert got.where("kept and base_failed").count() == 0


def test_counts_across_chunks():
    texts = pa.array(["a b\na b\n", None, "", "c " * 30, "#x"] * 50)
    whole = [quality.count_chunk(c) for c in ts.chunks(texts)]
    small = [quality.count_chunk(c) for c in ts.chunks(texts, 40)]
    assert [np.concatenate(x).tolist() for x in zip(*whole, strict=True)] == [np.concatenate(x).tolist() for x in zip(*small, strict=True)]


def moments(x, share):
    return x.mean(axis=0), np.cov(x.T, bias=True) * quality.consistency(share, 5) + np.diag(np.square(quality.FLOORS))


def brute_mcd(x, share=0.75):
    """Least log determinant over all subsets, and location and inverse scatter after reweighting."""
    h = math.ceil(share * len(x))
    least, rows = min((np.linalg.slogdet(moments(x[list(c)], share)[1])[1], c) for c in itertools.combinations(range(len(x)), h))
    center, scatter = moments(x[list(rows)], share)
    d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(scatter), x - center)
    center, scatter = moments(x[d <= quality.NEAR], 0.975)
    return least, center, np.linalg.inv(scatter)


@pytest.mark.parametrize(("seed", "few"), [(1, 0), (2, 20_000), (3, 20_000), (4, 20_000)])
def test_determinant_is_the_least_of_all_subsets(spark, seed, few, monkeypatch):
    monkeypatch.setattr(quality, "FEW", few)
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(15, 5)) * [0.5, 0.3, 0.05, 0.02, 0.1] + [5, 1.5, 0.1, 0.2, 0.3]
    x[:3] += [3, 2, 0.5, 0.4, 0.5]  # as many outliers as the subset leaves out
    least, center, inverse = brute_mcd(x)
    rows = spark.createDataFrame([(["[]"], *map(float, r)) for r in x], ["levels", *quality.FEATURES])
    got = quality.fit_mcd(rows).first()
    flat = rows.select(quality.F.lit(0).alias("salt"), quality.F.explode("levels").alias("level"), *quality.FEATURES)
    found = quality.least_determinant(flat.withColumn("salt", quality.F.lit(0)), quality.Scratch(spark, "test"), 0.75, 1, 2, 20)[0].first()
    assert found.log_det <= least + 1e-6
    assert np.allclose(got.center, center, rtol=1e-6) and np.allclose(got.inverse, inverse[np.triu_indices(5)], rtol=1e-5, atol=1e-6)


def test_determinants_never_rise(spark, edge):
    rows = quality._counted(edge, ("lang", "source")).select(quality.F.lit(0).alias("salt"), quality.F.explode("levels").alias("level"), *quality.FEATURES)
    run, was = quality.Scratch(spark, "test"), {}
    params = run.table(quality.first_estimates(rows, 3), "first")
    for k in range(4):
        params = run.table(quality.concentrate(rows, params, 0.75), f"step-{k}")
        now = {(r.level, r.start): r.log_det for r in params.collect()}
        assert now and all(now[key] <= was.get(key, math.inf) + 0.02 for key in now)  # a subset ends with its bin
        was = now


def test_outliers_go_and_the_clean_stay(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("etaoins") for _ in range(rng.randint(2, 8))) for _ in range(n))
    clean = [prose(rng.randint(25, 600)) for _ in range(300)]
    junk = [" ".join(w + rng.choice(["%%%", "&&&", "***"]) for w in prose(80).split()) for _ in range(15)]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + junk)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: (r.kept, r.distance) for r in quality.score_outliers(df).collect()}
    assert all(got[i][0] for i in range(300)) and not any(got[i][0] for i in range(300, 315))
    again = {r.doc_id: r.distance for r in quality.score_outliers(df.repartition(7)).collect()}
    assert all(math.isclose(again[i], got[i][1], rel_tol=1e-7) for i in got)


def test_words_far_from_their_group_are_outliers(spark):
    rng = random.Random(8)
    prose = lambda n, by=1: " ".join("".join(rng.choice("etaoins") for _ in range(rng.randint(2, 8))) * by for _ in range(n))
    texts = [prose(rng.randint(60, 600)) for _ in range(300)] + [prose(n, 3) for n in (60, 200, 600)] + [prose(200).replace(" ", " | ", 12)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    kept = {r.doc_id: r.kept for r in quality.score_outliers(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 303)) and kept[303]


def test_quality_of_nothing(empty, edge):
    assert quality.score_outliers(empty).count() == 0
    assert quality.keep_good(empty).count() == 0
    assert quality.keep_good(edge).columns == edge.columns


# Secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


TRAPS = ["token=secret: abcdefgh1 password=abcdefgh", "token=x password = 'longenough1'", "API_KEY:\t'abcdefghij'", "éé secret==\"abcd=efgh\"", "AKIA123 AKIA12345678901 AKIA123456789012", "f" * 31 + " " + "e" * 40, "tokens: aaaaaaaa PASSWD='a.b-c_d+e/f='"]


def test_base_secrets_equal_brute_force(spark, edge, edge_rows):
    for df, rows in ((edge, edge_rows), (spark.createDataFrame(list(enumerate(TRAPS)), "doc_id bigint, text string"), list(enumerate(TRAPS)))):
        got = secrets.scan_secrets(df)
        want = Counter((r[0], *(sum(s[3] == k for s in base_spans(r[1])) for k in ("assign", "access", "hex")), digest(base_spans(r[1]))) for r in rows)
        assert by_row(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want


def test_battery_finds_random_keys_and_leaves_words(spark):
    rng = random.Random(9)
    keys = ["".join(rng.choice(secrets.BASE64) for _ in range(n)) for n in (32, 40, 48, 64, 88) for _ in range(4)]
    keys += ["".join(rng.choice(secrets.HEXES) for _ in range(28)) for _ in range(6)]
    natural = ["internationalization2024report", "page_12_of_the_annual_summary", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "2024-01-01/2024-12-31/2025-01-01", "chapter1section2paragraph3", "abcabcabcabcabcabcabc123123123123"]
    rows = [(i, f"see {t} there") for i, t in enumerate(keys + natural)]
    found = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(found[i].n_random for i in range(len(keys))) >= 0.9 * len(keys)
    assert not any(found[i].n_random for i in range(len(keys), len(rows)))
    spans = found[0].spans.split(":")
    assert rows[0][1][int(spans[1]) : int(spans[2])] == keys[0]


def test_battery_finds_keys_over_narrow_alphabets_and_leaves_words(spark):
    rng = random.Random(12)
    low, digits = secrets.LETTERS, "0123456789"
    keys = ["".join(rng.choice(a) for _ in range(n)) for a in (low + digits, low.upper() + digits, low, low.upper(), low + low.upper(), secrets.BASE58) for n in (40, 64, 128) for _ in range(8)]
    natural = ["donaudampfschifffahrtsgesellschaft", "internationalization", "getUserAccountInformationFromDatabase", "some/path/to/a/library/file", "well-known-and-often-used-words", "ELECTROENCEPHALOGRAPHICALLY", "abcdefghijklmnopqrstuvwxyz", "a" * 40, "anticonstitutionnellement", "-" * 30 + "a", "XMLHttpRequestEventTargetListener"]
    rows = [(i, f"see {t} there") for i, t in enumerate(keys + natural)]
    found = {r.doc_id: r.n_random for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k in range(0, len(keys), 24):
        assert sum(found[i] for i in range(k, k + 24)) >= 20
    assert not any(found[i] for i in range(len(keys), len(rows)))


def brute_random(text):
    """Spans of the battery, by its formulas in plain Python."""
    tokens = [(m.start(), m.end(), m[0].rstrip("=").translate(str.maketrans("-_", "+/"))) for m in re.finditer(secrets.TOKEN, text) if re.search("[A-Za-z]", m[0]) and len(m[0].rstrip("=")) >= secrets.MIN_LENGTH]
    tail = lambda z: math.erfc(abs(z) / math.sqrt(2))
    rated = []
    for a, b, t in tokens:
        alphabet = next((x for p, x in secrets.ENCODINGS if re.match(p, t)), secrets.BASE64)
        k, n, at = len(alphabet), len(t), [alphabet.find(c) for c in t]
        chi = (k / n * sum(v * v for v in Counter(at).values()) - n - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n))
        high = [2 * x >= k for x in at]
        n1, runs = sum(high), 1 + sum(x != y for x, y in itertools.pairwise(high))
        n2 = n - n1
        spread = 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
        z_runs = (runs - 1 - 2 * n1 * n2 / n) / math.sqrt(spread) if spread > 0 else 99.0
        off = [x - sum(at) / n for x in at]
        energy = sum(x * x for x in off)
        z_serial = sum(x * y for x, y in itertools.pairwise(off)) / energy * math.sqrt(n) if energy > 0 else 99.0
        p = min(1.0, 3 * min(tail(chi) if chi > 0 else 1.0, tail(z_runs), tail(z_serial)))
        kind = lambda c: "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "+"
        switches = sum(kind(x) != kind(y) for x, y in itertools.pairwise(t))
        natural = n * secrets.NATURAL
        if t.isalpha():
            vowel = [c in secrets.VOWELS for c in t.lower()]
            share = {v: sum(f for c, f in secrets.FREQUENCY.items() if (c in secrets.VOWELS) == v) for v in (True, False)}
            natural = sum(-math.log(secrets.FREQUENCY[c] / share[c in secrets.VOWELS]) for c in t.lower())
            natural += sum(secrets.FOLLOWS["CV"[y] + "CV"[x]] for x, y in itertools.pairwise(vowel))
        rated.append((a, b, n, p, min(0.0, n * math.log(k) - natural - switches * secrets.SWITCH)))
    mean = sum(r[2] for r in rated) / len(rated) if rated else 0
    scored = [(a, b, p, q + math.log(mean) - math.log(n)) for a, b, n, p, q in rated]
    limit = max((q for i, q in enumerate(sorted(s[3] for s in scored), 1) if q <= math.log(i * secrets.FDR / len(scored))), default=-math.inf)
    return [(a, b) for a, b, p, q in scored if q <= limit and p >= secrets.REJECT and not any(x < b and a < y for x, _, y, _ in base_spans(text))]


def test_random_spans_equal_brute_force(spark, edge_rows):
    rng, low = random.Random(21), secrets.LETTERS
    alphabets = (secrets.HEXES, secrets.HEXES.upper(), low, low.upper(), secrets.BASE32, low + "0123456789", low + low.upper(), secrets.BASE58, secrets.BASE64, secrets.BASE64[:-2] + "-_", "ab", "aeiou")
    key = lambda: "".join(rng.choice(a) for a in [rng.choice(alphabets)] for _ in range(rng.randint(18, 90))) + "=" * rng.choice((0, 0, 1, 2))
    word = lambda: rng.choice(("the", "internationalization", "some/path/to/a/library/file.txt", "token=abcd1234efgh5678ijkl", "0123456789abcdef" * 2, "donaudampfschifffahrtsgesellschaft", "x" * 30))
    rows = [(i, " ".join(key() if rng.random() < share else word() for _ in range(rng.randint(1, 12)))) for i, share in enumerate([0.1, 0.4, 0.8] * 60)] + [(1000 + k, r[1] or "") for k, r in enumerate(edge_rows)]
    got = {r.doc_id: [(s.start, s.stop) for s in r.span_list if s.kind == "random"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {i: brute_random(t) for i, t in rows}
    assert got == want and sum(map(len, want.values())) > 100


def test_work_is_linear_in_the_matches_of_a_text(spark):
    """40,000 secrets or notices in one text; when each match copied those before, this took minutes."""
    text = " ".join(f"{k * 7919 + 10**30:032x}" for k in range(40_000))
    began = time.monotonic()
    row = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row.n_hex == 40_000 and row.n_random == 0
    row = licenses.scan_licenses(spark.createDataFrame([(1, "cc by all rights reserved mit license apache 2 0 " * 10_000)], "doc_id bigint, text string")).first()
    assert len(row.spans) == 40_000 and row.n_base == 20_000
    assert time.monotonic() - began < 60


def test_long_tokens(spark):
    rng = random.Random(2)
    text = "".join(rng.choice(secrets.BASE64) for _ in range(200_000))
    row = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row.spans == "random:0:200000"


def test_secrets_of_nothing(empty):
    assert secrets.scan_secrets(empty).count() == 0


# Licenses


def test_rules_are_many_and_gated():
    every = license_rules.rules()
    assert len(every) >= 300
    for r in every:  # any match has the gate word and the needle
        fixed = re.sub(r"\(\?:[^()]*\)\??|\((?:\?:)?(?:[^()]|\([^()]*\))*\)\?", "|", r.pattern)
        assert f" {r.gate} " in fixed and r.needle in r.pattern, r


def test_base_phrases_equal_brute_force(edge, edge_rows):
    def base(text):
        w, at, labels = alnum(text), [], set()
        for phrase, label in licenses.BASE.items():
            q = phrase.split()
            for k in range(len(w) - len(q) + 1):
                if w[k : k + len(q)] == q:
                    at.append(k)
                    labels.add(label)
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))

    got = licenses.scan_licenses(edge)
    assert by_row(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter((r[0], *base(r[1])) for r in edge_rows)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("This is the GNU Lesser General Public License version 2.1.", "gpl,lgpl-2.1"),
        ("released under the MIT License", "mit"),
        ("Creative Commons Attribution-ShareAlike", "cc-by-sa"),
        ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"),
        ("the committed apache helicopter", ""),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("cc by cc by cc by", "cc-by"),
    ],
)
def test_labels(spark, text, labels):
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row.labels == labels and 0 <= row.score <= 1 and (row.score > 0) == bool(labels)


def test_short_identifiers(spark):
    spdx = {"MIT": "mit", "Apache-2.0": "apache-2.0", "ISC": "isc", "MPL-2.0": "mpl-2.0", "EPL-2.0": "epl-2.0", "Zlib": "zlib", "GPL-2.0-or-later": "gpl-2.0", "LGPL-2.1-only": "lgpl-2.1", "AGPL-3.0-only": "agpl-3.0", "BSD-2-Clause": "bsd-2-clause", "0BSD": "0bsd", "MIT-0": "mit-0", "BSL-1.0": "boost-1.0", "Unlicense": "unlicense", "PHP-3.01": "php-3.01", "MIT OR Apache-2.0": "apache-2.0,mit", "Apache-2.0 OR MIT": "apache-2.0,mit"}
    want = {f"// SPDX-License-Identifier: {k}\nint x;": v for k, v in spdx.items()}
    want |= {"Licensed under MIT": "mit", "the code is MIT licensed": "mit", "Licensed under Apache 2.0.": "apache-2.0", "released under the terms of the GPL": "gpl", "Apache-2.0 licensed": "apache-2.0", "Licensed under the BSD 3-Clause": "bsd-3-clause"}
    want |= {"wir kommen mit dem Zug": "", "licensed drivers with ruby rings and python": "", "version 2 0 and ruby": "", "mit 0 Fehlern": ""}
    texts = list(want)
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == want


def test_licenses_of_nothing(empty):
    assert licenses.scan_licenses(empty).count() == 0


# Language model


def brute_scores(rows, order=3, prior=50.0):
    tokens = [[w.translate({i: i + 32 for i in range(65, 91)}) for w in words(t)] + ["\0end"] for _, t, *_ in rows]
    held = [zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 10 == 0 for r in rows]
    seen, context = Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        for i, w in enumerate(t if not h else []):
            past = (["\0start"] * (order - 1) + t)[i : i + order - 1]
            for k in range(order):
                seen[*past[order - 1 - k :], w] += 1
                context[tuple(past[order - 1 - k :])] += 1
    total, known = context[()], sum(len(k) == 1 for k in seen)

    def p(w, past):
        if not past:
            return (seen[w,] + 0.1) / (total + 0.1 * (known + 1))
        return (seen[*past, w] + prior * p(w, past[1:])) / (context[tuple(past)] + prior)

    out = []
    for r, t, h in zip(rows, tokens, held, strict=True):
        score = sum(math.log10(p(w, (["\0start"] * (order - 1) + t)[i : i + order - 1])) for i, w in enumerate(t))
        out.append((r[0], h, len(t), sum(seen[w,] > 0 for w in t), total, round(sum(math.log10(p(w, [])) for w in t), 5), round(score, 5)))
    return Counter(out)


@pytest.mark.parametrize(("block_bytes", "order"), [(1 << 24, 3), (15_000, 3), (15_000, 1), (15_000, 4)])
def test_scores_equal_brute_force(edge, edge_rows, block_bytes, order):
    got = language_model.score_documents(edge, block_bytes=block_bytes, order=order).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == brute_scores(edge_rows, order)


def dealt(texts, held=()):
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts), pa.int32()), pa.array(range(len(texts)), pa.int64()), pa.array([k in held for k in range(len(texts))]), pa.array(texts, pa.string())], names=["block", "doc_id", "held_out", "text"])
    return pa.Table.from_batches(list(language_model._deal(iter([batch]))))


def automaton(texts, order):
    own = language_model.Texts(dealt(texts))
    known = language_model.levels(own, order, {})  # a block that nobody else shares anything with
    return language_model.build(known, own.tokens, own.counts, order, 50.0, len(own.tokens), len(np.unique(own.tokens)), len(texts))[0], own.tokens, own.counts


def test_probabilities_of_every_state_sum_to_one():
    model, tokens, _ = automaton(["a b a c", "b a", "a", "a b a b a c c"], 3)
    words_ = np.append(np.unique(tokens), np.uint64(12345))
    going_on = [s for s in range(len(model.failure_to)) if (model.table.find(np.full(len(words_), s), words_) >= 0).any()]  # nothing follows an end
    assert len(going_on) > 8
    for state in going_on:
        weight, _ = model._step(model.table, np.full(len(words_), state), words_)
        assert math.isclose(np.power(10.0, weight).sum(), 1.0, rel_tol=1e-9)


def test_long_texts_are_read_alike_in_segments(monkeypatch):
    rng = random.Random(3)
    model, tokens, n = automaton([" ".join(rng.choice("abcdef") for _ in range(k)) for k in (0, 1, 5, 40, 700)], 3)
    whole = model.read(tokens, n)
    monkeypatch.setattr(language_model, "SEGMENT", 3)
    assert np.allclose(model.read(tokens, n), whole)


def test_exchange_grows_with_the_corpus():
    """Rows that a block sends: never more than keys, whatever the number of parts."""
    texts = dealt(["a b c d e f", "g h i", None, ""])
    own = language_model.Texts(texts)
    keys = sum(len(np.unique(k)) for k in language_model.grams(own.tokens, own.counts, 2))
    rows = [language_model._request(texts, None, range(1, 3), parts).num_rows for parts in (1, 10**3, 10**6, 10**9)]
    assert rows == sorted(rows) and rows[0] == 2 and rows[-1] <= keys and own.counts.tolist() == [7, 4, 1, 1]


def test_only_shared_parts_are_asked_for():
    texts, other = dealt(["a b c d"]), dealt(["x b c y", "c d"], held={1})
    ask = lambda t, told, wanted: language_model._request(t, told, wanted, 1)
    both = [ask(t, None, range(1, 3)) for t in (texts, other)]
    answers = [language_model._answer(pa.concat_tables([x.filter(pa.compute.equal(x["level"], level)) for x in both])) for level in (1, 2)]
    told = pa.concat_tables([a.slice(0, 1) for a in answers])
    sent = ask(texts, told, range(3, 4))
    # Shared pairs are "b c", "c d" and "d end"; so "b c d" and "c d end" are asked for, "a b c" and "start a b" are not.
    assert len(blocks.unpack_keys(sent["keys"][0].as_py())) == 2


def test_counts_beyond_32_bits():
    keys, many = np.array([1, 2**63], dtype=np.uint64), np.array([2**32 + 5, 3], dtype=np.uint64)
    (a, b), (several, _), totals = blocks.add_up([blocks.pack_keys(keys), blocks.pack_keys(keys[:1])], [blocks.pack_counts(many), blocks.pack_counts(many[:1])])
    assert several.tolist() == [True, False]
    assert a.tolist() == [2 * (2**32 + 5), 3] and b.tolist() == [2 * (2**32 + 5)] and totals.sum() == a.sum()
    assert blocks.unpack_counts(blocks.pack_counts(a)).tolist() == a.tolist() and len(blocks.unpack_keys(blocks.pack_keys(keys[:0]))) == 0


def test_scores_of_nothing(empty):
    assert language_model.score_documents(empty).count() == 0


def test_higher_orders_fit_better(edge):
    two = language_model.score_documents(edge, order=2).agg({"score": "sum"}).first()[0]
    three = language_model.score_documents(edge, order=3).agg({"score": "sum"}).first()[0]
    assert three > two


# Packing


@pytest.mark.parametrize("block_tokens", [1 << 21, 3000])
def test_packing_loses_nothing(edge, edge_rows, block_tokens):
    width = 128
    rows = packing.pack_documents(edge, width=width, block_tokens=block_tokens).collect()
    parts = {}
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == width and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids <= width
        places = packing.position_ids(r.resets, width)
        for k, (doc, at, a, b) in enumerate(zip(r.doc_ids, r.offsets, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True)):
            parts.setdefault(doc, []).append((at, ids[a:b].tolist()))
            assert places[a:b].tolist() == list(range(b - a)) and r.resets[k] == a
    code = packing.Encoder(packing.VOCABULARY)
    for r in edge_rows:
        own = sorted(parts[r[0]])
        copies = sum(x[0] == r[0] for x in edge_rows)
        whole = code.bpe.encode_ordinary(r[1] or "") + [packing.END]
        got = [t for at, ids in own for t in ids]
        assert len(got) == copies * len(whole)
        if copies == 1:
            assert got == whole and code.bpe.decode(got[:-1]) == (r[1] or "")


def test_packed_rows_are_written_and_read(edge, tmp_path):
    packed = packing.pack_documents(edge, width=64)
    packing.write_packed(packed, f"file://{tmp_path}/packed")
    held = pq.read_table(tmp_path / "packed")
    ids = packing.matrix(held, 64)
    assert ids.shape == (packed.count(), 64)
    assert Counter(map(bytes, ids)) == Counter(bytes(r.ids) for r in packed.collect())
    assert packing.matrix(held.slice(0, 0), 64).shape == (0, 64)


def test_best_fit_decreasing_equals_brute_force():
    rng = np.random.default_rng(2)
    for width in (1, 7, 64, 100):
        lengths = rng.integers(1, width + 1, 300)
        rooms, want = [], 0
        for n in sorted(lengths.tolist(), reverse=True):
            fit = [i for i, room in enumerate(rooms) if room >= n]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(width - n)
                want += 1
        rows = packing.best_fit_decreasing(lengths, width)
        assert len(rows) == want and sorted(i for r in rows for i in r) == list(range(300)) and max(lengths[r].sum() for r in rows) <= width


def test_units_encode_like_whole_texts():
    code, rng = packing.Encoder(packing.VOCABULARY), random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(" ab'1.\n\t é,sd漢 ") for _ in range(rng.randint(0, 14)))
        assert code.encode(text).tolist() == code.bpe.encode_ordinary(text)


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty).count() == 0


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<p>b", "a\n\nb"),
        ("a <b> b</b>c\n d", "a bc d"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>x", "- a\n- b\n  3. c\n  4. d\n- e\n\nx"),
        ("<table><tr><td>one<td>2<tr><td>three four<td>5</table>", "one         2\nthree four  5"),
        ("<table><tr><th colspan=2>wide<th>z<tr><td>a<td>b<td>c</table>", "wide  z\na  b  c"),
        ("<pre>\n a  b\n c</pre>", " a  b\n c"),
        ("<div hidden>no</div><p style='Display : none'>no</p><script>no</script><style>no</style><!-- no -->yes<template>no</template>", "yes"),
        ("<head><title>no</title><meta x>body text", "body text"),
        ("x&nbsp;&amp;&#x41;&lt;", "x &A<"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<a title='>'>x</a><img alt=no>y", "xy"),
        ("<script>if (a<b) '</p>'</script>t", "t"),
        ("<h1>a</h1>b<blockquote>q<p>r</blockquote>", "a\n\nb\n\n  q\n\n  r"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
        ("a < b and <3", "a < b and <3"),
        ("<p>open <b>never closed", "open never closed"),
        ("</p></div>x", "x"),
        ("", ""),
    ],
)
def test_pages(page, text):
    assert html_text.extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>If <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1 tex</annotation></semantics></math> then", "If x=1 then"),
        ("<p>a<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><path d='M0'/><text>Sales</text><text>2024</text></svg>b", "a Sales 2024 b"),
        ("<svg><defs/><g><text>x</text></g></svg><p>after", "x\n\nafter"),
        ("<svg><foreignObject><p>in</p></foreignObject></svg>", "in"),
        ("<desc>shown</desc>", "shown"),
    ],
)
def test_formulas_and_drawings(page, text):
    assert html_text.extract(page) == text


class Page:
    """Random pages with the text that they must give, told from the tree that is written and not from one that is parsed."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def word(self):
        return "".join(self.rng.choice("abcdexyz") for _ in range(self.rng.randint(1, 6)))

    def inline(self):
        """(html, words): some in inline elements, some hidden, white space of all kinds between."""
        html, seen = [], []
        for _ in range(self.rng.randint(1, 6)):
            w, kind = self.word(), self.rng.randrange(9)
            shown = kind > 2
            html.append((f"<span hidden>{w}</span>", f"<i style='display:none'>{w}</i>", f"<!-- {w} -->", f"<b>{w}</b>", f"<em class=none>{w}</em>", f"<span style='visibility:hidden'><b style='visibility:visible'>{w}</b></span>", *[w] * 3)[kind])
            seen += [w] if shown else []
        return self.rng.choice((" ", "\n", " \t ")).join(html), " ".join(seen)

    def blocks(self, depth):
        """(html, items): an item is a line, or the number of empty lines that are due."""
        html, items = [], []
        for _ in range(self.rng.randint(1, 3)):
            h, i = self.rng.choice((self.paragraph, self.div, self.list, self.table, self.preformatted, self.unseen))(depth)
            html.append(h)
            items += i
        return "\n".join(html), items

    def paragraph(self, depth):
        h, text = self.inline()
        return f"<p>{h}" + self.rng.choice(("", "</p>")), [1, text, 1] if text else [1]

    def div(self, depth):
        if depth > 2:
            return self.paragraph(depth)
        h, items = self.blocks(depth + 1)
        return f"<div>{h}</div>", [0, *items, 0]

    def list(self, depth, inner=False):
        tag, start = self.rng.choice(("ul", "ol")), self.rng.randint(1, 12)
        html, items = [], []
        for k in range(self.rng.randint(1, 4)):
            h, text = self.inline()
            own, mark = [text or "x"], "- " if tag == "ul" else f"{start + k}. "
            h = h if text else h + " x"
            if not inner and self.rng.random() < 0.3:
                more, lines = self.list(depth, True)
                h, own = h + more, own + [x for x in lines if isinstance(x, str)]
            html.append(f"<li>{h}" + self.rng.choice(("", "</li>")))
            items += [(mark if n == 0 else " " * len(mark)) + x for n, x in enumerate(own)]
        return f"<{tag}{f' start={start}' if tag == 'ol' else ''}>{''.join(html)}</{tag}>", [0 if inner else 1, *items, 0 if inner else 1]

    def table(self, depth):
        columns, rows = self.rng.randint(1, 4), self.rng.randint(1, 4)
        grid = [[None] * columns for _ in range(rows)]
        html = []
        for r in range(rows):
            row, c = [], 0
            while c < columns:
                if grid[r][c] is not None:
                    c += 1
                    continue
                wide = self.rng.randint(1, 2) if c + 1 < columns and grid[r][c + 1] is None else 1
                tall = self.rng.randint(1, 2) if r + 1 < rows else 1
                text = self.word()
                for i in range(tall):
                    for j in range(wide):
                        grid[r + i][c + j] = (text if i == j == 0 else "", wide if i == 0 and j == 0 else 0)
                row.append(f"<td{f' colspan={wide}' if wide > 1 else ''}{f' rowspan={tall}' if tall > 1 else ''}>{text}" + self.rng.choice(("", "</td>")))
                c += wide
            html.append("<tr>" + "".join(row) + self.rng.choice(("", "</tr>")))
        width = [max([len(grid[r][c][0]) for r in range(rows) if grid[r][c][1] == 1], default=0) for c in range(columns)]
        lines = []
        for r in range(rows):
            line, c = [], 0
            while c < columns:
                text, wide = grid[r][c]
                wide = max(wide, 1)
                line.append(text.ljust(sum(width[c : c + wide]) + 2 * (wide - 1)))
                c += wide
            if any(x.strip() for x in line):
                lines.append("  ".join(line).rstrip())
        return f"<table>{''.join(html)}</table>", [1, *lines, 1]

    def preformatted(self, depth):
        lines = [self.word() + " " * self.rng.randint(1, 4) + self.word() for _ in range(self.rng.randint(1, 3))]
        return "<pre>" + "\n".join(lines) + "</pre>", [1, *lines, 1]

    def unseen(self, depth):
        w = self.word()
        return self.rng.choice((f"<script>if (a<b) '{w}'</script>", f"<div class=gone>{w}</div>", f"<template><p>{w}</template>", f"<p id=gone>{w}</p>", f"<section hidden><table><tr><td>{w}</table></section>")), []

    def page(self):
        html, items = self.blocks(0)
        out, gap = [], 0
        for x in items:
            if isinstance(x, str):
                out += [""] * gap if out else []
                out.append(x)
                gap = 0
            else:
                gap = max(gap, x)
        return "<style>.gone, p#gone { display: none } .none { color: red } @media print { b { display: none } }</style>" + html, "\n".join(out)


def test_random_pages_equal_brute_force():
    for seed in range(400):
        page, text = Page(seed).page()
        got = html_text.extract(page)
        # A hidden block still ends a line, and a hidden paragraph an open one.
        assert got == text, (seed, page)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td>" * 1500 + "x", "x"),
        (f'<table><tr><td colspan="{"9" * 5000}">a<td rowspan={"9" * 5000}>b<tr><td>c</table>', None),
        (f"a&#{'1' * 5000};b&#x{'0' * 5000}41;", "a\ufffdbA"),
        ("<div style='visibility:hidden'>a<p style='visibility:visible'>b</p></div>", "b"),
        ("<style>.x{display:none}</style><p class='a x'>no<p>yes", "yes"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<b>" * 100_000 + "<li>" * 100_000 + "x", None),
        ("<p>" * 100_000 + "</div>" * 100_000 + "x", "x"),
        ("<style>" + "{" * 5000 + "@media" * 500 + "</style>x", "x"),
    ],
)
def test_hostile_pages(page, text):
    got = html_text.extract(page)
    assert text is None or got == text


def test_deep_and_long_pages():
    assert html_text.extract("<div>" * 20_000 + "x") == "x"
    assert html_text.extract('<a href="' * 2000 + "x") is not None
    assert len(html_text.extract("word " * 200_000)) == 999_999


def test_pages_query(spark):
    rows = [(1, None, "t", "u"), (2, "", "t", "u"), (3, "<p>a</p>", "t", "u"), (3, "<p>a</p>", "t", "u"), (None, "b&#xD800;", "t", "u")]
    got = html_text.extract_pages(spark.createDataFrame(rows, PAGES))
    assert by_row(got, "page_id", "n_chars", "n_lines") == Counter({(1, 0, 0): 1, (2, 0, 0): 1, (3, 1, 1): 2, (None, 2, 1): 1})
    assert html_text.extract_pages(spark.createDataFrame([], PAGES)).count() == 0
