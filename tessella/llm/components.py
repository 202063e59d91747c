"""Connected components by alternating large and small stars, in DataFrame joins and aggregations.

Each round is two aggregations (a minimum, combined before the shuffle) and two joins that adaptive execution can
split for hub nodes; edges are written to the shared folder after each, and only a count and a checksum reach the
driver. The number of rounds grows with the logarithm of the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessella.storage import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, run: Scratch | None = None, tag: str = "cc") -> DataFrame:
    """(u, v) rows to (node, component): the least node of each component, for every node of a link that isn't its own least.

    The table of the result is the only one that stays, under ``tag`` in ``run``."""
    run = run or Scratch(links.sparkSession, "components")
    edges, before, k = run.table(links.where("u <> v").select("u", "v").distinct(), f"{tag}-0"), None, 0
    while True:
        # What is written is counted in the same job.
        seen = Observation()
        stars = _small_star(_large_star(edges)).observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        edges = run.table(stars, f"{tag}-{k + 1}")
        run.drop(f"{tag}-{k}")
        now, k = (seen.get["rows"], seen.get["sum"]), k + 1
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
