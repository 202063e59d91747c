"""Shared intermediate storage: tables that survive the loss of an executor."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local one only in a local session where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        # Local sessions (tests, bench) have one machine, so its temporary folder is shared by all tasks.
        where = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


FILE_BYTES = 32 << 20


def files_for(df: DataFrame) -> int:
    """How many files intermediate tables of an operator on ``df`` get at most: one per core, or per ``FILE_BYTES`` of the
    input as the optimizer estimates it. Writing many small ones costs more than what is in them."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, min(math.ceil(estimate / FILE_BYTES), 1 << 24))


class Scratch:
    """Tables of one run of an operator, in a folder of their own, of ``files`` files each at most."""

    def __init__(self, spark: SparkSession, tag: str, files: int | None = None):
        self.spark, self.root, self.paths, self.files = spark, f"{shared_dir(spark)}/tessella/{tag}-{uuid.uuid4().hex}", {}, files

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: cuts the lineage, keeps column pruning."""
        path = self.paths[tag] = f"{self.root}/{tag}"
        (df.coalesce(self.files) if self.files else df).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        """Delete tables that nothing reads any more."""
        for tag in tags:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(tag))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialize(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """One table of its own, for as long as the shared folder is kept."""
    return Scratch(df.sparkSession, tag, files).table(df, "table")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
