"""Document quality: counted rules, then robust multivariate outliers.

``text_statistics`` counts per document in one vectorised pass. ``score_outliers`` transforms the counts to a
vector of five statistics and estimates location and scatter per language and source by the minimum covariance
determinant: several starts, concentration steps until the determinant no longer falls, the start with the least
determinant, and reweighting (``fit_mcd``). A document is rejected if its squared Mahalanobis distance exceeds ``cutoff``.

All estimates cover all documents: a concentration step is two aggregations (counts of binned distances, then the
moments of the closest documents) that combine before they are shuffled, so a hot source is never gathered. Groups
with under ``min_group`` documents use the estimate of their language, and failing that of all documents. Only
parameter rows (one per group and start, about 400 bytes) travel between steps. Counts decide what is in a subset and
parameters are rounded, so reruns agree.

Defined results: null and empty texts have no words and fail the counted rules; null language or source is a group
of its own; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessella.llm import textscan as ts
from tessella.storage import Scratch, files_for, materialize

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_share", "repeat_share")
#: Regularisation of each feature's scatter, as a standard deviation. The first two lie at or under what groups have themselves (about 0.75
#: and 0.04), so their scatter sets the distance. The shares are 0 in most texts, where the closest part has no scatter, and are judged on these scales.
FLOORS = (0.3, 0.04, 0.03, 0.12, 0.12)
SALTS = 64
FEW = 20_000  # rows of parameters (about 8 MB) that are broadcast
TOLERANCE = 1e-3  # of the logarithm of a determinant
BINS = 128  # of distances, for each doubling
ALL = "[]"  # the level of all documents
PARAMS = "level string, start int, total bigint, center array<double>, inverse array<double>, log_det double"
#: The 0.975 quantile of chi-squared with five degrees of freedom.
NEAR = 12.833
#: The 0.9999 quantile of chi-squared with five degrees of freedom.
CUTOFF = 25.745


def count_chunk(chunk: ts.Chunk) -> list[np.ndarray]:
    """The five counts for each document of a chunk."""
    data = chunk.data
    word = ts.SPACE_WORDS[data]
    words = ts.Words(chunk, *chunk.spans(word))
    word_chars = chunk.per_doc(word & ((data & 0xC0) != 0x80))
    symbols = chunk.per_doc(SYMBOLS[data])

    start, end = chunk.spans(data != 0x0A)
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[has_word], end[has_word]
    doc = chunk.doc_of(start)
    lines = np.unique(np.stack([doc.astype(np.uint64), chunk.hash_spans(start, end)], axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.uint64)
    n = len(chunk)
    dup_lines = np.bincount(doc, minlength=n) - np.bincount(lines[:, 0].astype(np.int64), minlength=n)

    ok = words.ngram_ok(8)
    at = np.flatnonzero(ok)
    key = ts.ngrams(words.hashes(), 8)[at] if len(at) else np.zeros(0, np.uint64)
    key = ts.mix(key ^ ts.mix(words.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    delta = np.zeros(len(words.doc) + 1, dtype=np.int64)
    np.add.at(delta, at[twice], 1)
    np.add.at(delta, at[twice] + 8, -1)
    covered = np.zeros(len(words.doc) + 1, dtype=np.int64)
    np.cumsum(np.cumsum(delta[:-1]) > 0, out=covered[1:])
    repeats = covered[words.first + words.count] - covered[words.first]
    return [words.count, word_chars, symbols, dup_lines, repeats]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text column (the first) is replaced by the counts; the other columns pass through."""
    for batch in batches:
        parts = [count_chunk(c) for c in ts.chunks(batch.column(0))]
        counted = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in counted), *batch.columns[1:]], names=[*COUNTS, *batch.schema.names[1:]])


def text_statistics(documents: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The counts of every document beside the ``keep`` columns."""
    some = documents.select("text", *keep)
    fields = [f"{k} bigint" for k in COUNTS] + [f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields[1:]]
    return some.mapInArrow(_counts, ", ".join(fields))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n).alias("log_words"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("word_length"),
        F.sqrt(F.least(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), F.lit(1.0))).alias("symbol_share"),
        F.sqrt(F.least(F.col("n_dup_lines") / n, F.lit(1.0))).alias("dup_share"),
        F.sqrt(F.col("n_repeat_words") / n).alias("repeat_share"),
    ]


def _levels() -> Column:
    """Keys of the three estimates that a document belongs to: its language and source, its language, everything."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return F.array(F.to_json(F.array(part("lang"), part("source"))), F.to_json(F.array(part("lang"))), F.lit(ALL))


def _distance() -> Column:
    """Squared Mahalanobis distance of the features to ``center`` under the symmetric ``inverse`` (upper triangle, row by row)."""
    d = [F.col(f) - F.col("center")[i] for i, f in enumerate(FEATURES)]
    total, k = F.lit(0.0), 0
    for i in range(len(FEATURES)):
        for j in range(i, len(FEATURES)):
            total = total + d[i] * d[j] * F.col("inverse")[k] * (1.0 if i == j else 2.0)
            k += 1
    return total


def _bin() -> Column:
    """Distances in steps of about 0.5 %, as whole numbers: counts of them are the same in whatever order they are added."""
    return F.floor(F.log2(F.greatest(F.col("distance"), F.lit(1e-9))) * BINS).cast("int")


def _fit(frames: Iterator[pd.DataFrame], widen: float) -> Iterator[pd.DataFrame]:
    """Location, inverse scatter and the logarithm of its determinant from the moments of each subset."""
    p = len(FEATURES)
    floor = np.diag(np.square(FLOORS))
    for rows in frames:
        out = []
        for r in rows.itertuples(index=False):
            n = max(float(r.n), 1.0)
            mean = np.array(r.sums) / n
            second = np.zeros((p, p))
            second[np.triu_indices(p)] = np.array(r.products) / n
            scatter = np.triu(second) + np.triu(second, 1).T - np.outer(mean, mean)
            # The closest part of a Gaussian group underestimates its scatter; the floor keeps the matrix regular.
            scatter = scatter * widen + floor
            inverse = np.linalg.inv(scatter)[np.triu_indices(p)]
            # Sums of floats depend on their order in the last digits.
            out.append((r.level, r.start, r.total, [float(f"{x:.10g}") for x in mean], [float(f"{x:.10g}") for x in inverse], float(np.linalg.slogdet(scatter)[1])))
        yield pd.DataFrame(out, columns=["level", "start", "total", "center", "inverse", "log_det"])


def _meet(rows: DataFrame, params: DataFrame, few: bool, *also: str) -> DataFrame:
    """Rows with the parameters of their level. A few of these (by count) are broadcast; more are met by level and salt, as a
    level may hold a third of all rows, and one holds them all."""
    if few:
        return rows.join(F.broadcast(params), ["level", *also])
    return rows.join(params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["level", "salt", *also])


def _moments(inner: DataFrame, widen: float) -> DataFrame:
    sums = [F.sum(f) for f in FEATURES]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    moments = inner.groupBy("level", "start").agg(F.first("total").alias("total"), F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums"), F.array(*products).alias("products"))
    return moments.mapInPandas(lambda frames: _fit(frames, widen), PARAMS)


def _measured(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    return _meet(rows, params, few).select("level", "salt", "start", "total", *FEATURES, _distance().alias("distance"))


def concentrate(rows: DataFrame, params: DataFrame, share: float, few: bool = True) -> DataFrame:
    """One concentration step: the estimates of the closest ``share`` of each group's rows, for each of its starts.

    The subset ends with the bin of distances in which it is complete.
    """
    measured = _measured(rows, params, few).withColumn("bin", _bin())
    counts = measured.groupBy("level", "start", "total", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("level", "start").orderBy("bin")  # a bounded number of bins
    cuts = counts.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") >= F.ceil(share * F.col("total"))).groupBy("level", "start").agg(F.min("bin").alias("cut"))
    inner = _meet(measured, cuts, few, "start").where("bin <= cut")
    return _moments(inner, consistency(share, len(FEATURES)))


def first_estimates(rows: DataFrame, min_group: int) -> DataFrame:
    """Starts of every level of ``min_group`` rows or more (and of all rows): the point of medians, of lower and of upper
    quartiles, with quartile ranges as scales. Quartiles are exact to 1/256, from counts of whole numbers."""
    exploded = rows.select("level", F.posexplode(F.array(*FEATURES)).alias("feature", "x"))
    counts = exploded.groupBy("level", "feature", F.floor(F.col("x") * 256).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("level", "feature")
    placed = counts.withColumn("upto", F.sum("n").over(of.orderBy("bin"))).withColumn("total", F.sum("n").over(of))
    placed = placed.where((F.col("total") >= min_group) | (F.col("level") == ALL))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(q * F.col("total")), (F.col("bin") + 0.5) / 256))
    quart = placed.groupBy("level", "feature").agg(F.first("total").alias("total"), F.array(at(0.25), at(0.5), at(0.75)).alias("q"))
    wide = quart.groupBy("level").agg(F.first("total").alias("total"), *[F.first(F.when(F.col("feature") == i, F.col("q")), ignorenulls=True).alias(f) for i, f in enumerate(FEATURES)])
    spread = [F.lit(1.0) / (F.pow((F.col(f)[2] - F.col(f)[0]) / 1.349, F.lit(2.0)) + floor * floor) for f, floor in zip(FEATURES, FLOORS, strict=True)]
    diagonal = F.array(*[spread[i] if i == j else F.lit(0.0) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))])
    starts = [F.struct(F.lit(k).alias("start"), F.array(*[F.col(f)[q] for f in FEATURES]).alias("center")) for k, q in enumerate((1, 0, 2))]
    return wide.select("level", F.explode(F.array(*starts)).alias("s"), "total", diagonal.alias("inverse")).select("level", "s.start", "total", "s.center", "inverse", F.lit(float("inf")).alias("log_det"))


def least_determinant(rows: DataFrame, run: Scratch, share: float, min_group: int, trial_steps: int, most_steps: int) -> tuple[DataFrame, bool]:
    """The estimate (PARAMS) of each level's closest ``share`` of rows with the least determinant that was found, and whether
    these are few."""
    params = run.table(first_estimates(rows, min_group), "first")
    few = params.count() <= FEW
    for k in range(trial_steps):
        params = run.table(concentrate(rows, params, share, few), f"trial-{k}")
    best = params.groupBy("level").agg(F.min_by(F.struct("start", "total", "center", "inverse", "log_det"), F.struct("log_det", "start")).alias("p"))
    state = run.table(best.select("level", "p.*", F.lit(True).alias("moving")), "best")
    names = ("start", "total", "center", "inverse", "log_det")
    for k in range(most_steps):
        seen = Observation()
        after = concentrate(rows, state.where("moving").drop("moving"), share, few).select("level", F.struct(*names).alias("p"))
        falls = F.coalesce(F.col("p.log_det") < F.col("log_det") - TOLERANCE, F.lit(False))
        chosen = [F.when(falls, F.col(f"p.{c}")).otherwise(F.col(c)).alias(c) for c in names]
        moved = state.join(after, "level", "left").select("level", *chosen, falls.alias("moving"))
        state = run.table(moved.observe(seen, F.count_if("moving").alias("moving")), f"step-{k}")
        if not seen.get["moving"]:
            break
    return state.drop("moving"), few


def fit_mcd(vectors: DataFrame, *, share: float = 0.75, min_group: int = 200, trial_steps: int = 2, most_steps: int = 20) -> DataFrame:
    """Location and inverse scatter of every level that is large enough: (level, total, center, inverse).

    ``vectors`` has FEATURES and ``levels``. The subset of ``share`` of a group whose scatter has the least determinant is
    sought from three starts: after ``trial_steps`` concentration steps the start with the least determinant goes on until it
    no longer falls by over 0.1 % (or for ``most_steps``), each group for itself. The estimate is then taken once more from all rows
    within the 0.975 quantile of it. Scatter is regularised by adding FLOORS squared, under which concentration steps
    still never raise the determinant.
    """
    run = Scratch(vectors.sparkSession, "mcd", 1)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")
    rows = vectors.select(salt, F.explode("levels").alias("level"), *FEATURES)
    params, few = least_determinant(rows, run, share, min_group, trial_steps, most_steps)
    near = _measured(rows, params, few).where(F.col("distance") <= NEAR)
    return run.table(_moments(near, consistency(0.975, len(FEATURES))), "last").select("level", "total", "center", "inverse")


def consistency(share: float, p: int) -> float:
    """The factor that makes the scatter of the closest ``share`` of normal vectors unbiased, by simulation-free integration."""
    x = np.linspace(1e-6, 60.0, 600_001)
    density = x ** (p / 2 - 1) * np.exp(-x / 2)
    mass = np.cumsum(density)
    mass /= mass[-1]
    cut = int(np.searchsorted(mass, share))
    inner = float((x[:cut] * density[:cut]).sum() / density[:cut].sum())
    return p / inner


def _counted(documents: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return text_statistics(documents, keep).select("*", *features()).withColumn("levels", _levels())


def _estimates(counted: DataFrame, min_group: int) -> DataFrame:
    """Estimates of groups that are large enough. Documents that the counted rules reject would widen them."""
    return fit_mcd(counted.where(~base_failed()), min_group=min_group)


def _judge(counted: DataFrame, usable: DataFrame, cutoff: float) -> DataFrame:
    for k, name in enumerate(("own", "language", "all")):
        own = usable.select(F.col("level").alias("key"), F.struct("center", "inverse").alias(name))
        own = F.broadcast(own.where(F.col("key") == ALL)) if name == "all" else own.where(F.col("key") != ALL)  # one row
        counted = counted.join(own, F.col("levels")[k] == F.col("key"), "left").drop("key")
    best = F.coalesce("own", "language", "all")
    judged = counted.withColumn("center", best["center"]).withColumn("inverse", best["inverse"]).withColumn("distance", _distance()).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= cutoff))).drop("own", "language", "all", "center", "inverse", "levels", *FEATURES)


def score_outliers(documents: DataFrame, *, cutoff: float = CUTOFF, min_group: int = 200, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Counts, base_failed, squared distance, and kept for every document, beside the ``keep`` columns."""
    counted = materialize(_counted(documents, keep), "quality", files_for(documents))
    return _judge(counted, _estimates(counted, min_group), cutoff)


def keep_good(documents: DataFrame, *, cutoff: float = CUTOFF, min_group: int = 200) -> DataFrame:
    """Documents that are kept, columns as they are. Texts are read again instead of being shuffled or stored."""
    counted = materialize(_counted(documents, ("lang", "source")), "quality", files_for(documents))
    rows = documents.select("text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    judged = _judge(_counted(rows, ("lang", "source", "row")), _estimates(counted, min_group), cutoff)
    return judged.where("kept").select("row.*")
