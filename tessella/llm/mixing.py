"""Mixing sources to target weights, exactly and repeatably, in DataFrame operations only.

Every document gets a hash-random key (the MD5 of seed and doc_id). Its leading digits are a range of the key space, so
(source, range) is a range partition of each source in key order. Token counts are summed per (source, range) - combined before the shuffle -
and a window over these few sums gives where each range starts in its source; a second window inside each range
gives where each document starts. A document takes the part of the budget that falls on its interval, so each
source is cut exactly at its budget. A budget of several epochs takes every document that many times and cuts the
last epoch.

A hot source is spread over 16 ** ``digits`` ranges, so no task holds a source; rows without doc_id are placed by their
text. Only (source, range) sums and source totals are ever gathered by a key: a window over the sums of one source, and
one over one row per source.

Defined results: null text counts as empty (size 0, takes 0); null source is a source of its own, last in order;
repeated rows stand one after another in key order, each with its own interval; an empty table gives an empty
result; sources of size 0 get the target 0. Columns other than doc_id, text and source are ignored by
``mix_sources`` and kept by ``apply_mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.native_text import SPACE_WORD
from tessella.storage import files_for, materialize

WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code point order, null last, take the weights in turn and ``share`` of all sizes by weight. No target
    exceeds ``most`` times its source's size. In order of the level (size limit over weight) at which they fill up,
    a source is full if filling it and giving all later ones the same level stays within the total; what is left
    goes to the others by weight - the fixed point of resharing the excess until nobody is above.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = total.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    upto = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    ranked = ranked.withColumn("budget", share * F.sum("source_size").over(every)).withColumn("later", F.sum("weight").over(every) - F.sum("weight").over(upto))
    full = F.sum("limit").over(upto) + F.col("limit") / F.col("weight") * F.col("later") <= F.col("budget")
    ranked = ranked.withColumn("full", full)
    used = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("limit")).otherwise((F.col("budget") - used) * F.col("weight") / open_weight)
    return ranked.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def digits_for(documents: DataFrame) -> int:
    """Leading digits of a key that name its range: 3 (4,096 ranges of each source), more beyond 128 GB of input."""
    return max(3, math.ceil(math.log(files_for(documents), 16)))


def _sized(documents: DataFrame, size: Column | None, digits: int, seed: int, *carried: Column) -> DataFrame:
    """The carried columns, and source, size, key, range of every row."""
    size = F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long") if size is None else size
    # Without an id the text stands in, so that such rows spread over the ranges.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    key = F.md5(F.concat(F.lit(f"{seed}:"), name))
    rows = documents.select(*carried, F.col("source").alias("source"), size.alias("size"), key.alias("key"))
    rows = rows.withColumn("range", F.conv(F.substring("key", 1, digits), 16, 10).cast("int"))
    # One column names source and range, null included: the join with the plan and the window share one exchange.
    return rows.withColumn("spot", F.concat_ws(":", "range", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))))


def _range_sums(sized: DataFrame, files: int) -> DataFrame:
    return materialize(sized.groupBy("source", "range", "spot").agg(F.sum("size").alias("range_size")), "mix-sums", files)


def _placed(sized: DataFrame, sums: DataFrame, order: tuple[str, ...], weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Rows with source_size, target, taken, epochs and last_epoch, by the interval of each in its source."""
    targets = source_targets(sums.select("source", F.col("range_size").alias("size")), weights=weights, share=share, most=most)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    plan = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).select("spot", "range_start", "source_size", "target")
    placed = sized.join(plan, "spot")
    inside = Window.partitionBy("spot").orderBy("key", *order, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    last = F.least(F.greatest(budget - whole * F.col("source_size") - F.col("start"), F.lit(0)), F.col("size"))
    return placed.withColumn("epochs", whole).withColumn("last_epoch", last).withColumn("taken", F.col("epochs") * F.col("size") + F.col("last_epoch"))


def mix_sources(documents: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, digits: int | None = None, seed: int = 17, size: Column | None = None) -> DataFrame:
    """For each row: doc_id, source, size, source_size, target, taken, epochs, last_epoch.

    ``size`` is the token count of a document, by default its words.
    """
    files = files_for(documents)
    sized = materialize(_sized(documents, size, digits or digits_for(documents), seed, F.col("doc_id")), "mix", files)
    placed = _placed(sized, _range_sums(sized, files), ("doc_id",), weights, share, most)
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "epochs", "last_epoch")


def apply_mix(documents: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, digits: int | None = None, seed: int = 17, size: Column | None = None) -> DataFrame:
    """The mixed corpus: every document once for each whole epoch, and once more if at least half of it is inside the
    budget of the last one (documents stay whole, so a source may miss its budget by half a document). Documents of
    size 0 take no budget and are left out. Sizes are counted in one pass, and rows placed in a second that carries them
    to their range; every row has an interval of its own, repeated rows too."""
    digits = digits or digits_for(documents)
    sums = _range_sums(_sized(documents, size, digits, seed), files_for(documents))
    # Rows travel as one struct, so none of their columns clashes with those of the plan.
    whole_row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = _sized(documents, size, digits, seed, F.col("doc_id").alias("mix_id"), F.xxhash64("text").alias("mix_text"), whole_row).where("size > 0")
    placed = _placed(rows, sums, ("mix_id", "mix_text"), weights, share, most)
    copies = (F.col("epochs") + F.when(2 * F.col("last_epoch") >= F.col("size"), 1).otherwise(0)).cast("int")
    return placed.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
