"""Encoded blocks as a stream: decoding is narrow, so the same program decodes each micro-batch as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import compile
from tessella.sources.store import open_program


def read_stream(spark: SparkSession, path: str, *, columns: list[str] | None = None, blocks_per_file: int = 1) -> DataFrame:
    """A streaming DataFrame of the rows of an encoded table: files of blocks that are added later are decoded too."""
    decision, program = open_program(spark, path)
    if program is None:
        raise ValueError(f"{decision.reason}: {decision.diagnostics}")
    schema = spark.read.parquet(f"{path}/blocks").schema
    blocks = spark.readStream.schema(schema).option("maxFilesPerTrigger", blocks_per_file).parquet(f"{path}/blocks")
    return compile.decode_blocks(blocks, program, columns=columns)
